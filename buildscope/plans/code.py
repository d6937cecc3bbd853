"""Program text, instructions and compiler output (SRC17, E, M), made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as R
from ..operators import code as C
from .registry import pick, query, spread, sql_pick


def key():
    return F.col("p_partkey")


NAMES = ("extension", "composition", "weird", "friendship")


@query("SRC17_relations", f"select 'c' || p_partkey as source, case when p_partkey % 5 = 0 then '' else 'c' || (p_partkey // 2) end as target, case when p_partkey % 7 = 0 then 'other' else {sql_pick('p_partkey', ('inheritance', 'composition', 'other', 'friendship'))} end as kind from part")
def src17(t):
    field = F.when(key() % 7 == 0, "").otherwise(F.concat(F.lit('"type":"'), pick(key(), NAMES), F.lit('",')))
    target = F.when(key() % 5 == 0, "").otherwise(F.format_string('"destination":"c%d",', F.floor(key() / 2)))
    rows = t.part.select(F.from_json(F.concat(F.lit("{"), field, target, F.format_string('"source":"c%d"}', key())), "type string, source string, destination string").alias("r"))
    return rows.select(F.coalesce("r.source", F.lit("")).alias("source"), F.coalesce("r.destination", F.lit("")).alias("target"), R.relation_kind(F.col("r.type")).alias("kind"))


# mnemonic, operands, and what it does: l, s, b or -
INSTRUCTIONS = (
    ("movl", "%eax,0x8(%rbp)", "s"), ("movq", "0x0(%rax,%rbx,4),%rcx", "l"), ("leaq", "0x8(%rip),%rax", "-"), ("incl", "(%rax)", "ls"), ("push", "%rbp", "s"),
    ("popq", "%rbx", "l"), ("jmp", "0x400", "b"), ("addl", "%eax,%ebx", "-"), ("callq", "*0x8(%rax)", "b"), ("nop", "0x0(%rax)", "-"),
    ("movl", "%fs:0x28,%eax # 0x8(%rip)", "l"), ("shlb", "$1,(%rdi)", "s"), ("movq", "%rcx,0x0(%rax,%rbx,4)", "s"),
)


@query("M31_operand_direction", f"select p_partkey, contains(w, 'l') is_load, contains(w, 's') is_store, contains(w, 'b') is_branch from (select p_partkey, {sql_pick('p_partkey', [x[2] for x in INSTRUCTIONS])} w from part)")
def m31(t):
    does = R.x86_access(pick(key(), [x[0] for x in INSTRUCTIONS]), pick(key(), [x[1] for x in INSTRUCTIONS]))
    return t.part.select("p_partkey", does.alias("does")).select("p_partkey", "does.*")


HEADERS = (("limits.h", "builtin"), ("limits", "standard-library"), ("hal/gpio.h", "project"), ("bits/vector.tcc", "standard-library"), ("board.h", "project"), ("cstdint", "standard-library"))


@query("M30_missing_header", f"select p_partkey, case when p_partkey % 11 > 0 then {sql_pick('p_partkey', [h for h, _ in HEADERS])} end header, case when p_partkey % 11 > 0 then {sql_pick('p_partkey', [k for _, k in HEADERS])} end kind from part")
def m30(t):
    said = F.when(key() % 11 == 0, F.lit("a.c:1: error: expected ';'")).otherwise(F.concat(F.lit("a.c:1:10: fatal error: '"), pick(key(), [h for h, _ in HEADERS]), F.lit("' file not found")))
    rows = t.part.select("p_partkey", R.missing_header(said).alias("header"))
    return rows.withColumn("kind", F.when(F.col("header").isNotNull(), R.header_kind(F.col("header"))))


@query("M38_compile_entry", "select p_partkey, array_to_string(list_concat(list_concat(['gcc', '-Wall', 'include'], case when p_partkey % 2 = 0 then ['-O2'] else ['src/f' || p_partkey || '.c', '-O2'] end), ['-Iinc', '-isystem/sys', '-DON=1', '-c', '/w/src/f' || p_partkey || '.c']), ' ') as command from part")
def m38(t):
    name = F.concat(F.lit("src/f"), key(), F.lit(".c"))
    given = F.when(key() % 2 == 0, F.concat(F.lit("/w/./SRC/x/../f"), key(), F.lit(".c"))).otherwise(name)
    flags = [F.lit(x) for x in ("gcc", "-Iold", "-Wall", "-DX", "-isystem", "include", "-o", "-DY", "-c")]
    arguments = F.array(*flags, given, F.lit("-O2"))
    out = R.compile_arguments(arguments, F.lit("/w/lib/.."), name, F.array(F.lit("-Iinc"), F.lit("-isystem/sys")), F.array(F.lit("-DON=1")), "cc")
    return spread(t.part.select("p_partkey")).select("p_partkey", F.array_join(out, " ").alias("command"))


@query("M39_include_paths", """with v as (select l_orderkey % 50 project, min((l_orderkey, l_linenumber, l_partkey, l_suppkey)) first, case l_linenumber % 5 when 0 then '/w/app/inc' || l_partkey % 9 when 1 then '/w/app' when 2 then '/opt/sdk/lib' || l_partkey % 4 when 3 then 'a&b' else '/w/app/app' end path from lineitem group by 1, 3)
 select project, string_agg(path, ';' order by first) as paths from v group by 1""")
def m39(t):
    k, part = F.col("l_linenumber") % 5, F.col("l_partkey")
    text = F.when(k == 0, F.format_string("&quot;${workspace_loc:/app/x/../inc%d}&quot;", part % 9)).when(k == 1, F.lit("${workspace_loc:/app}")).when(k == 2, F.format_string(" ${SDK}/./lib%d ", part % 4)).when(k == 3, F.lit("a&amp;b")).otherwise(F.lit("${ProjDirPath}//${ProjName}"))
    rows = t.lineitem.select((F.col("l_orderkey") % 50).alias("project"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.path_value(text, {"SDK": "/opt/sdk"}, "/w/app").alias("path"))
    first = rows.groupBy("project", "path").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("first"))  # each path once before a project's are gathered
    return first.groupBy("project").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "path"))), lambda x: x["path"]), ";").alias("paths"))


@query("M40_participants", """with a as (select 'f' || (p_partkey % 40) as file, 'fn' || (p_partkey % 400) as name, 0 part, p_size::bigint place from part union all select 'f' || (l_partkey % 40), case when l_suppkey % 5 = 0 then 'HAL_' || (l_suppkey % 7) else 'fn' || (l_suppkey % 60) end, 1, l_orderkey * 8 + l_linenumber from lineitem),
 g as (select file, name, min((part, place)) first from a group by 1, 2) select file, name, first[1] = 1 or name like 'HAL\\_%' escape '\\' as extern, row_number() over (partition by file order by first, name) - 1 as pos from g""")
def m40(t):
    symbols = t.part.select(F.concat(F.lit("f"), key() % 40).alias("file"), F.concat(F.lit("fn"), key() % 400).alias("name"), F.col("p_size").alias("line"))
    supplier = F.col("l_suppkey")
    callee = F.when(supplier % 5 == 0, F.concat(F.lit("HAL_"), supplier % 7)).otherwise(F.concat(F.lit("fn"), supplier % 60))
    calls = t.lineitem.select(F.concat(F.lit("f"), F.col("l_partkey") % 40).alias("file"), callee.alias("callee"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    return C.participants(symbols, calls, ["HAL_"])


@query("M23_context", "with f as (select p_partkey % 40 as file, 'fn' || (p_partkey % 400) as name, p_partkey ord from part where p_partkey % 400 > 9) select name from (select name, min((file <> 7, ord)) first from f where file = 7 or contains('why does fn123 call fn45?', name) group by 1 order by 2, 1 limit 30)")
def m23(t):
    rows = t.part.where("p_partkey % 400 > 9").select(F.concat(F.lit("f"), key() % 40).alias("file"), F.concat(F.lit("fn"), key() % 400).alias("name"), key().alias("ord"))
    return C.context(rows, "f7", "Why does FN123 call fn45?", 30)


@query("M7_interrupts", "select p_partkey, p_name, p_size from part where contains(lower(p_name), 'ring') and p_brand = 'Brand#2' and p_partkey % 3 = 1")
def m7(t):
    severities = F.when(key() % 3 == 0, F.array().cast("array<string>")).when(key() % 3 == 1, F.array(F.lit("warn"), F.lit("error"))).otherwise(F.array(F.lit("warn")))
    keep = R.matches_interrupt(F.col("p_name"), F.col("p_brand"), severities, "ring", "Brand#2", "error")
    return t.part.where(keep).select("p_partkey", "p_name", "p_size").orderBy(F.desc(F.coalesce("p_size", F.lit(-1))))


@query("M33_source_rows", """with i as (select l_suppkey file, l_orderkey * 8 + l_linenumber pos, max(l_quantity::bigint % 6) src_line from lineitem group by 1, 2), k as (select *, lag(src_line) over (partition by file order by pos) before from i where src_line in (1, 2, 4))
 select file, pos, 'insn' kind, src_line, 'i' || pos as text, 1 part from i union all select file, pos, 'source_code', src_line, 'line ' || src_line, 0 from k where before is null or before <> src_line""")
def m33(t):
    keys = t.lineitem.select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), (F.col("l_quantity").cast("long") % 6).alias("src_line"))
    rows = keys.groupBy("file", "pos").agg(F.max("src_line").alias("src_line")).select("file", "pos", F.lit("insn").alias("kind"), "src_line", F.concat(F.lit("i"), "pos").alias("text"))
    lines = t.supplier.select(F.col("s_suppkey").alias("file"), F.explode(F.array(*(F.lit(x).cast("long") for x in (1, 2, 4)))).alias("line"))
    return C.with_source(rows, lines.withColumn("source", F.concat(F.lit("line "), "line")))


@query("E12_type_usage", "with p as (select p_partkey k, 'f' || (p_partkey % 90) as file from part) select distinct type, file from (select 'Base' || (k % 13) as type, file from p union all select 'IFace', file from p union all select 'struct', file from p where k % 3 = 0 union all select 'Arg' || (k % 5), file from p where k % 2 = 0)")
def e12(t):
    inherits = F.concat(F.lit("Base"), key() % 13, F.lit(", IFace,"))
    signature = F.when(key() % 2 == 0, F.concat(F.lit("(const Arg"), key() % 5, F.lit(" &x, int y, T z)")))
    return C.type_usage(t.part.select(F.concat(F.lit("f"), key() % 90).alias("file"), inherits.alias("inherits"), F.when(key() % 3 == 0, "struct:Node").alias("typeref"), signature.alias("signature")))


NODES = ("IfStmt", "BinaryOperator", "CXXThrowExpr", "ReturnStmt", "ForStmt", "DeclRefExpr")


@query("E7_complexity", f"""with n as (select l_suppkey as function, {sql_pick('l_linenumber', NODES)} kind, case when l_partkey % 2 = 0 then '&&' else '+' end opcode, l_partkey % 4 above from lineitem), s as (select *, kind in ('IfStmt', 'ForStmt') or (kind = 'BinaryOperator' and opcode = '&&') seen from n)
 select function, 1 + count(*) filter (seen or kind = 'CXXThrowExpr') cyclomatic, count(*) filter (seen) visible, count(*) filter (kind = 'CXXThrowExpr') hidden, coalesce(max(above + 1) filter (seen), 0)::bigint max_depth, count(*) filter (kind like '%Stmt') statements from s group by 1""")
def e7(t):
    ancestor = F.struct(F.lit("WhileStmt").alias("kind"), F.lit(None).cast("string").alias("opcode"))
    block = F.struct(F.lit("CompoundStmt").alias("kind"), F.lit(None).cast("string").alias("opcode"))
    above = F.concat(F.array(block), F.array_repeat(ancestor, (F.col("l_partkey") % 4).cast("int")))
    return C.complexity(t.lineitem.select(F.col("l_suppkey").alias("function"), pick(F.col("l_linenumber"), NODES).alias("kind"), F.when(F.col("l_partkey") % 2 == 0, "&&").otherwise("+").alias("opcode"), above.alias("ancestors")))


@query("M6_interrupt_stack", "select p_partkey as name, size, worst_case, 32 + coalesce(worst_case, size) total, depth, coalesce(depth > 5, false) deep from (select p_partkey, case when p_partkey % 3 > 0 then p_size::bigint end size, case when p_partkey % 4 = 0 then p_size * 10::bigint end worst_case, case when p_partkey % 4 = 0 and p_partkey % 8 > 0 then (p_partkey % 9)::int end depth from part)")
def m6(t):
    handlers = t.part.select(key().alias("name"))
    frames = t.part.where("p_partkey % 3 > 0").select(key().alias("name"), F.col("p_size").cast("long").alias("size"))
    path = F.when(key() % 8 > 0, F.array_repeat(F.lit("f"), (key() % 9 + 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    return C.interrupt_stack(handlers, frames, t.part.where("p_partkey % 4 = 0").select(key().alias("name"), (F.col("p_size") * 10).cast("long").alias("worst_case"), path.alias("path")), 32)


@query("E5_bindings", "with p as (select p_partkey k, 'f' || p_partkey as file from part) select file, 'field' as form, 'Enable' as name, 'fn' || (k % 50) as function from p where k % 50 < 40 union all select file, 'field', 'Off', 'fn1' from p union all select file, 'pointer', 'cb', 'fn' || (k % 45) from p where k % 45 < 40")
def e5(t):
    text = F.concat(F.lit("struct Ops o = { .Enable = &fn"), key() % 50, F.lit(", .Off=fn1 };\nvoid (*cb)(int) = fn"), key() % 45, F.lit(";\nint x = 3; o.n = 4;\n"))
    names = t.part.where("p_partkey < 40").select(F.concat(F.lit("fn"), key()).alias("name"))
    return C.bindings(t.part.select(F.concat(F.lit("f"), key()).alias("file"), text.alias("text")), names)


@query("M17_conditional_ranges", "with p as (select 'f' || p_partkey as file, 7 + length(p_partkey::varchar) n from part) select file, true inactive, null::varchar macro, 19 + n as start, 32 + n as \"end\" from p union all select file, true, null, 39 + n, 47 + n from p union all select file, false, 'B', 54 + n, 65 + n from p union all select file, false, 'B', 65 + n, 75 + n from p")
def m17(t):
    text = F.concat(F.lit("#define A\n#ifdef A\nint x"), key(), F.lit(";\n#else\nint y;\n#endif\n#if 0\nz\n#endif\n#ifdef B\nq\n#elif C\nr\n#endif\n"))
    return C.conditional_ranges(t.part.select(F.concat(F.lit("f"), key()).alias("file"), text.alias("text")))
