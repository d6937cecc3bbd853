"""Program text (SRC24, SRC8, E4, E6), made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lexer
from ..operators import source as S
from .registry import pick, query, spread, sql_pick

# Pieces of text in which comments and literals are open, and what stays of each.
PIECES = (
    ("int a; /* x", "int a;     "), ("y */ b // 'c", "     b      "), ("d\ne \"q*/", "  \ne \"   "), ("\"; '\\'' f\\ /", "\"; '  ' f\\ /"),
    ("/ z\n\"\\", "  z\n\""), ("\"//\n\" g;\n", "     \n\" g;\n"),
)


def _expected() -> list[str]:
    """Each piece blanked where it stands in the round, worked out by hand."""
    return ["int a;     ", "     b      ", " \ne \"   ", "\"; '  ' f\\  ", "   \n\" ", "   \n\" g;\n"]


@query(
    "SRC24_blanked",
    f"""with p as (select l_suppkey as k, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 as piece from lineitem)
 select 's' || k || '.c' as file, piece, case when piece % 6 = 3 and piece = max(piece) over (partition by k) then '"; ''  '' f\\ /' else replace({sql_pick('piece', [e.replace(chr(10), '@') for e in _expected()])}, '@', chr(10)) end as text from p""",
)
def src24(t):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    pieces = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey", F.lit(".c")).alias("file"), (F.row_number().over(order) - 1).cast("long").alias("piece"))
    return lexer.blanked(pieces.withColumn("text", pick(F.col("piece"), [p for p, _ in PIECES])))


def program(t):
    """A file a part: a namespace with a class that has a method, and two functions, one of which calls."""
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("#define X {\nnamespace n"), k % 3, F.lit(" {\n// class Not {\nclass K"), k, F.lit(" : public B"), k % 5, F.lit(", private virtual C {\n  virtual int get"), k,
        F.lit("(int a) const { return run"), k, F.lit("(a) + other(1); }\n};\n}\nstatic void run"), k, F.lit("(void)\n{ /* } */ HAL_x(\"go(\"); run"), k,
        F.lit("(1); if (a) { get"), k, F.lit("(2); get"), k, F.lit("(3); } }\n"),
    )
    return spread(t.part.select(k)).select(F.concat(F.lit("f"), k, F.lit(".cpp")).alias("file"), text.alias("text"))


@query(
    "E4_outlines",
    """with p as (select p_partkey k, 'f' || p_partkey || '.cpp' as file, '#define X {' || chr(10) || 'namespace n' || p_partkey % 3 || ' {' || chr(10) || '// class Not {' || chr(10) || 'class K' || p_partkey || ' : public B' || p_partkey % 5 || ', private virtual C {' || chr(10)
  || '  virtual int get' || p_partkey || '(int a) const { return run' || p_partkey || '(a) + other(1); }' || chr(10) || '};' || chr(10) || '}' || chr(10) || 'static void run' || p_partkey || '(void)' || chr(10) || '{ /* } */ HAL_x("go("); run' || p_partkey || '(1); if (a) { get' || p_partkey || '(2); get' || p_partkey || '(3); } }' || chr(10) as t from part)
 select file, 'namespace' as kind, 'n' || k % 3 as name, null as class, null as namespace, instr(t, 'namespace n') - 1 as start, instr(t, ' {' || chr(10) || '//') as body_start, instr(t, 'static') - 2 as body_end, 2 as first_line, 7 as last_line, false as is_static, false as is_virtual, '' as bases, null as signature from p
 union all select file, 'class', 'K' || k, null, 'n' || k % 3, instr(t, 'class K') - 1, instr(t, ' C {') + 2, instr(t, '};'), 4, 6, false, false, 'B' || k % 5 || ',C', null from p
 union all select file, 'function', 'get' || k, 'K' || k, 'n' || k % 3, instr(t, 'virtual int') - 1, instr(t, '{ return') - 1, instr(t, '1); }' || chr(10)) + 4, 5, 5, false, true, '', 'virtual int get' || k || '(int a)' from p
 union all select file, 'function', 'run' || k, null, null, instr(t, 'static') - 1, instr(t, '{ /*') - 1, length(t) - 1, 8, 9, true, false, '', 'static void run' || k || '(void)' from p""",
)
def e4(t):
    return S.outlines(program(t)).withColumn("bases", F.array_join("bases", ","))


@query(
    "E6_calls",
    """with p as (select p_partkey k, 'f' || p_partkey || '.cpp' as file from part)
 select file, 'get' || k as caller, 'run' || k as callee, false as is_extern from p union all select file, 'run' || k, 'HAL_x', true from p union all select file, 'run' || k, 'get' || k, false from p""",
)
def e6(t):
    return S.calls(program(t), ["HAL_"]).drop("at")


@query(
    "SRC8_documented",
    """select 'ld' || p_partkey % 7 as file, '.sec' || p_partkey as name, case when p_partkey % 5 in (0, 1) then 'Holds ' || p_partkey || case when p_partkey % 2 = 0 then chr(10) || 'and more' else '' end else '' end as comment from part""",
)
def src8(t):
    k = F.col("p_partkey")
    note = F.when(k % 2 == 0, F.array(F.concat(F.lit("  /* Holds "), k), F.lit("   * and more */"))).otherwise(F.array(F.concat(F.lit("/** Holds "), k, F.lit(" */"))))
    gap = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array_repeat(F.lit(" "), 4)).when(k % 5 == 2, F.array_repeat(F.lit(""), 5)).otherwise(F.array(F.lit("KEEP(*(.x))")))
    lines = F.concat(note, gap, F.array(F.concat(F.lit("  .sec"), k, F.lit(" :"))), F.array(F.lit("  { *(.a) }")))
    rows = t.part.select(F.concat(F.lit("ld"), k % 7).alias("file"), F.posexplode(lines).alias("at", "line"), k.alias("k"))
    return S.comments_of(rows.select("file", (F.col("k") * 16 + F.col("at")).alias("line_no"), "line"), r"^\s*(\.\w+)\s*:").select("file", "name", "comment")
