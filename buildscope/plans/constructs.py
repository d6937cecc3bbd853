"""Class diagrams, layouts and constructs (SRC14, SRC17, E8, E9, M4), made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constructs as C
from ..sources import debug, diagrams
from .registry import pick, query, spread, sql_pick
from .texts import lined


def diagram(t):
    """A file a part with one class: bases by halves of the key, methods, members and relations by what the key leaves."""
    k = F.col("p_partkey")
    text = lambda x: F.lit(x)
    some = lambda c, *x: F.when(c, F.concat(*x)).otherwise("")
    method = lambda name, **flags: '{"name":"' + name + '","display_name":"' + name + '()"' + "".join(f',"{f}":true' for f in flags) + "}"
    methods = F.concat_ws(
        ",",
        F.when(k % 2 == 0, text(method("run", is_virtual=1))), F.when(k % 6 == 0, text(method("stop", is_virtual=1, is_pure_virtual=1))),
        F.when(k % 10 == 4, text(method("~C", is_virtual=1))), F.when(k % 10 == 8, text(method("~C"))),
        F.when(k % 7 == 1, text(method("C", is_deleted=1) + "," + method("operator==", is_operator=1))), F.when(k % 7 == 2, text(method("operator=", is_operator=1, is_move_assignment=1))),
        F.when(k % 9 == 1, text(method("co", is_coroutine=1) + "," + method("k", is_constexpr=1))),
    )
    base = lambda at, extra="": F.concat(F.lit('{"id":"c'), at.cast("long"), F.lit(f'"{extra}}}'))
    bases = F.concat_ws(",", F.when(k > 0, base(F.floor(k / 2))), F.when(k % 5 == 3, base(F.floor(k / 3), ',"is_virtual":true')), F.when(k % 11 == 5, text('{"id":"gone"}')))
    member = some(k % 3 == 1, text('{"name":"count","type":"int","is_static":true},{"name":""}'))
    flags = F.concat(some(k % 6 == 0, text(',"is_abstract":true')), some(k % 13 == 0, text(',"is_template":true')), some(k % 17 == 3, text(',"is_union":true')), some(k % 17 == 4, text(',"is_struct":true')))
    element = F.concat(text('{"id":"c'), k, text('","name":"C'), k, text('","namespace":"'), some(k % 4 > 0, text("n"), k % 4), text('","type":"class"'), flags, text(',"bases":['), bases, text('],"members":['), member, text('],"methods":['), methods, text('],"source_location":{"file":"f.h","line":'), k + 1, text("}}"))
    relation = F.concat(text('{"source":"c'), k, text('","destination":"c'), F.floor(k / 2).cast("long"), text('","type":"extension"'), some(k % 8 == 1, text(',"access":"private"')), text("}"))
    return spread(t.part.select(k)).select(F.concat(text("d"), k, text(".json")).alias("file"), F.concat(text('{"elements":['), element, text('],"relationships":['), relation, text("]}")).alias("text"))


TYPES = """with recursive p as (select p_partkey k from part),
types as (select 'c' || k as id, k, case when k % 4 > 0 then 'n' || k % 4 || '::' else '' end || 'C' || k as qualified, case when k % 17 = 3 then 'union' when k % 17 = 4 then 'struct' else 'class' end as kind, k % 6 = 0 as is_abstract, k % 13 = 0 as is_template from p),
bases as (select k, k // 2 as b, false as is_virtual from p where k > 0 union all select k, k // 3, true from p where k % 5 = 3 union all select k, null, false from p where k % 11 = 5),
known as (select bases.*, p.k is not null as known from bases left join p on p.k = b),
safe as (select distinct k from known where not known union select x.k from known x join p on x.b = p.k where p.k % 10 = 4 union select x.k from known x join safe on x.b = safe.k),
facts as (select t.*, (k % 2 = 0)::int + (k % 6 = 0)::int + (k % 10 = 4)::int as virtuals, (k % 6 = 0)::int as pures, (select count(*) from bases b where b.k = t.k) as bases, (select count(*) from bases b where b.k = t.k and b.is_virtual) as vbases,
  exists (select 1 from bases b where b.k = t.k and b.b % 6 = 0 and b.b in (select k from p)) as abstract_base, case when k % 10 = 4 then true when k % 10 = 8 then false end as dtor,
  (k % 2 = 0)::int + (k % 6 = 0)::int + (k % 10 = 4)::int + (k % 10 = 8)::int + 2 * (k % 7 = 1)::int + (k % 7 = 2)::int + 2 * (k % 9 = 1)::int as methods, k in (select k from safe) as safe from types t)"""
RULES = (
    ("virtual_dispatch", "new", "virtuals > 0", "virtuals", "null"), ("abstract_interface", "new", "is_abstract or pures > 0", "pures", "null"), ("multiple_inheritance", "new", "bases > 1", "bases", "null"),
    ("virtual_inheritance", "trap", "vbases > 0", "vbases", "null"), ("non_virtual_destructor", "trap", "(virtuals > 0 or abstract_base) and not safe and dtor = false", "0", "null"),
    ("implicit_non_virtual_destructor", "trap", "(virtuals > 0 or abstract_base) and not safe and dtor is null", "0", "null"), ("deleted_special_member", "new", "k % 7 = 1", "1", "'C()'"),
    ("move_semantics", "new", "k % 7 = 2", "1", "null"), ("coroutine", "trap", "k % 9 = 1", "1", "null"), ("operator_overload", "new", "k % 7 = 1", "1", "'operator==()'"), ("template_class", "new", "is_template", "0", "null"),
    ("static_data_member", "new", "k % 3 = 1", "1", "null"), ("constexpr_method", "new", "k % 9 = 1", "1", "null"), ("union", "familiar", "kind = 'union'", "0", "null"),
    ("plain_data", "familiar", "kind <> 'union' and bases = 0 and methods = 0 and not is_template", "0", "null"), ("non_public_inheritance", "new", "k % 8 = 1 and k // 2 in (select k from p)", "0", "'private,C' || k // 2"),
)


@query("SRC17_types", TYPES + " select 'd' || k || '.json' as file, id, qualified, kind, is_abstract, is_template, 'f.h' as source, k + 1 as line, 0 as ord from types")
def src17_types(t):
    return diagrams.class_diagram(diagram(t)).types.select("file", "id", "qualified", "kind", "is_abstract", "is_template", "source", F.col("line").cast("long").alias("line"), "ord")


@query(
    "SRC17_methods",
    """with p as (select p_partkey k from part), m as (select k, 0 as o, 'run' as name, true as v, false as u, false as d from p where k % 2 = 0 union all select k, 1, 'stop', true, true, false from p where k % 6 = 0 union all select k, 2, '~C', k % 10 = 4, false, true from p where k % 10 in (4, 8)
 union all select k, 3, 'C', false, false, false from p where k % 7 = 1 union all select k, 4, 'operator==', false, false, false from p where k % 7 = 1 union all select k, 5, 'operator=', false, false, false from p where k % 7 = 2 union all select k, 6, 'co', false, false, false from p where k % 9 = 1 union all select k, 7, 'k', false, false, false from p where k % 9 = 1)
 select 'c' || k as type_id, row_number() over (partition by k order by o) - 1 as ord, name, name || '()' as display_name, v as is_virtual, u as is_pure, d as is_destructor from m""",
)
def src17_methods(t):
    return diagrams.class_diagram(diagram(t)).methods.select("type_id", F.col("ord").cast("long").alias("ord"), "name", "display_name", "is_virtual", "is_pure", "is_destructor")


@query("SRC17_bases", TYPES + " select 'c' || k as type_id, coalesce('c' || b, 'gone') as base, is_virtual from bases")
def src17_bases(t):
    return diagrams.class_diagram(diagram(t)).bases.select("type_id", "base", "is_virtual")


@query("E9_type_constructs", TYPES + " select * from (" + " union all ".join(f"select id as type, qualified, '{name}' as construct, '{how}' as severity, ({n})::bigint as n, {names} as names from facts where {c}" for name, how, c, n, names in RULES) + ")")
def e9(t):
    return C.type_constructs(*diagrams.class_diagram(diagram(t))).withColumn("names", F.array_join("names", ",")).drop("source", "line")


KINDS = (
    ("CXXConstructExpr", "object_construction", "new"), ("ExprWithCleanups", "temporary_destroyed", "trap"), ("MaterializeTemporaryExpr", "materialised_temporary", "new"), ("VarDecl", "function_local_static", "trap"),
    ("CXXOperatorCallExpr", "operator_call", "new"), ("CXXNewExpr", "heap_allocation", "trap"), ("CXXDeleteExpr", "heap_release", "new"), ("CXXThrowExpr", "throw", "trap"), ("CXXTryStmt", "try_block", "new"),
    ("CXXDynamicCastExpr", "rtti_use", "trap"), ("CXXTypeidExpr", "rtti_use", "trap"), ("LambdaExpr", "lambda", "new"), ("CXXForRangeStmt", "range_for", "familiar"), ("DecompositionDecl", "structured_binding", "familiar"),
    ("CoawaitExpr", "coroutine_suspend", "trap"), ("ImplicitCastExpr", "implicit_conversion", "trap"), ("IfStmt", None, None), ("CoreturnStmt", "coroutine_suspend", "trap"),
)


@query(
    "E8_node_constructs",
    f"""with n as (select l_suppkey as file, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey as pos, l_orderkey as line, l_partkey as k from lineitem),
 c as (select *, {sql_pick('k', [k[1] or '' for k in KINDS])} as construct, {sql_pick('k', [k[2] or '' for k in KINDS])} as severity from n),
 d as (select * from c where construct <> '' and not (construct = 'temporary_destroyed' and line % 2 = 0) and not (construct = 'function_local_static' and line % 2 = 0) and not (construct = 'implicit_conversion' and line % 2 = 0)),
 m as (select file, pos, line, construct, severity, case when construct in ('function_local_static', 'heap_allocation') then 'v' || k when construct = 'lambda' then '0' when construct = 'heap_release' then case when line % 2 = 1 then 'array' else 'one' end else 'T' || k % 3 end as subject, case when construct = 'object_construction' then k % 3 = 1 end as certain from d)
 select 's' || file as file, line, construct, severity, subject, certain from m qualify row_number() over (partition by file, construct, line order by pos) = 1""",
)
def e8(t):
    k, line = F.col("l_partkey"), F.col("l_orderkey")
    odd = line % 2 == 1
    pos = (line * 8 + F.col("l_linenumber")) * 1000000 + k
    none = F.lit(None).cast("long")
    nodes = t.lineitem.select(
        F.concat(F.lit("s"), "l_suppkey").alias("file"), pos.alias("id"), none.alias("parent"), pos.alias("pos"), pick(k, [x[0] for x in KINDS]).alias("kind"), F.concat(F.lit("v"), k).alias("name"),
        F.concat(F.lit("const T"), k % 3, F.lit(" &")).alias("type"), line.alias("line"), F.lit(1).alias("col"), F.lit("static").alias("storage"), F.when(odd, "_ZZ1fvE1x").otherwise("_ZL1x").alias("mangled"),
        F.when(odd, "UserDefinedConversion").otherwise("NoOp").alias("cast"), odd.alias("cleanups"), odd.alias("array"),
    )
    return C.node_constructs(nodes, destructors=t.spark.createDataFrame([("ns::T1",)], "type string")).drop("col")


SYMBOLS = ("_ZTV{n}", "_ZTI{n}", "_ZTS{n}", "_ZN{n}C1Ev", "_ZN{n}D0Ev", "_Z{n}IiEvv", "main", "__cxa_throw", "_ZN{n}3runEv")
DEMANGLED = ("vtable for {k}", "typeinfo for {k}", "typeinfo name for {k}", "{k}::{k}()", "{k}::~{k}()", "void Vec{m}<int>()", "main", "__cxa_throw", "std::List<{k}>::run()")


@query(
    "M4_cpp_summary",
    """with s as (select p_partkey k, p_partkey % 9 as m, p_size::bigint as size, p_partkey // 9 as c from part), g as (select * from s where m not in (6, 7)),
 f as (select case m when 5 then 'Vec' || k % 70 else 'std::List' end as family, count(*) n, sum(size) total, min(k) first from s where m in (5, 8) group by 1 order by total desc, first limit 50)
 select true as is_cpp, (select count(*) from g) as mangled_count, (select count(distinct c) from s where m < 2) as class_count, (select sum(size)::bigint from s where m = 0) as vtable_bytes,
 (select sum(p_size)::bigint from part where p_partkey % 4 = 0) as exception_bytes, (select sum(p_size)::bigint from part where p_partkey % 4 = 1) as dynamic_bytes, (select count(*) from s where m = 3) as ctor_count, (select count(*) from s where m = 4) as dtor_count,
 (select sum(n)::bigint from f) as template_instantiations, (select sum(greatest(0, (p_size - 16) // 16))::bigint from part where p_partkey % 4 = 1) as plt_imports""",
)
def m4(t):
    k = F.col("p_partkey")
    c = F.concat(F.lit("c"), F.floor(k / 9).cast("string"))
    filled = lambda texts: pick(k, texts)
    name = F.regexp_replace(filled(SYMBOLS), r"\{n\}", F.concat(F.length(c), c))
    shown = F.regexp_replace(F.regexp_replace(filled(DEMANGLED), r"\{k\}", c), r"\{m\}", (k % 70).cast("string"))
    symbols = t.part.select(k.alias("ord"), name.alias("name"), shown.alias("demangled"), F.col("p_size").cast("long").alias("size"))
    sections = t.part.select(pick(k, (".eh_frame_hdr", ".plt", ".text", ".data")).alias("name"), F.col("p_size").cast("long").alias("size"))
    return C.cpp_summary(symbols, sections)


def layout_text(t):
    """A record a part in the text of a layout tool, in three files; every fifth is not found."""
    k = F.col("p_partkey")
    found = k % 5 > 0
    when = lambda c, *x: F.when(found & c, F.concat(*x))
    yes = F.lit(True)
    return lined(
        t.part, k,
        F.when(~found, F.concat(F.lit("pahole: type 'R"), k, F.lit("' not found"))),
        when(k % 2 == 0, F.lit("struct R"), k, F.lit(" {")), when(k % 2 == 1, F.lit("class R"), k, F.lit(" : public Tag {")),
        when(k % 2 == 1, F.lit("\t/* struct Tag                 <ancestor>; */     /*     0     0 */")),
        when(yes, F.lit("\tuint8_t                    a;                    /*     0     1 */")), when(yes, F.lit("\t/* XXX "), k % 7 + 1, F.lit(" bytes hole, try to pack */")),
        when(k % 3 == 0, F.lit("\tunsigned int               b:3;                  /*     8: 2  4 */")), when(k % 3 == 0, F.lit("\t/* XXX 5 bits hole, try to pack */")), when(k % 3 == 0, F.lit("\tint                        :4;")),
        when(yes, F.lit("\t/* size: "), F.col("p_size"), F.lit(", cachelines: 1, members: 2 */")), when(k % 3 == 0, F.lit("\t/* sum bitfield members: 7 bits, bit holes: 1, sum bit holes: 5 bits */")),
        when(yes, F.lit("\t/* sum members: 5, holes: 1, sum holes: "), k % 7 + 1, F.lit(" */")), when(k % 4 == 0, F.lit("\t/* padding: 3 */")), when(yes, F.lit("};")),
        file=F.concat(F.lit("p"), k % 3),
    )


@query("SRC14_records", "select 'p' || p_partkey % 3 as file, 'R' || p_partkey as name, case when p_partkey % 2 = 0 then 'struct' else 'class' end as kind, p_size::bigint as size_of, 5::bigint as sum_members, 1::bigint as holes, p_partkey % 7 + 1 as sum_holes, case when p_partkey % 3 = 0 then 1::bigint end as bit_holes, case when p_partkey % 3 = 0 then 5::bigint end as sum_bit_holes, case when p_partkey % 4 = 0 then 3::bigint end as padding from part where p_partkey % 5 > 0")
def src14(t):
    return debug.layouts(layout_text(t))[0].drop("place")


@query(
    "SRC14_members",
    """with p as (select p_partkey k, 'R' || p_partkey as record from part where p_partkey % 5 > 0), m as (select k, record, 0 as o, 'Tag' as name, 'struct Tag' as type, 0::bigint as "offset", 0::bigint as size, true as is_ancestor, null::bigint as bit_first, null::bigint as bit_width, null::bigint as hole_after, null::bigint as bit_hole_after from p where k % 2 = 1
 union all select k, record, 1, 'a', 'uint8_t', 0, 1, false, null, null, k % 7 + 1, null from p union all select k, record, 2, 'b', 'unsigned int', 8, 4, false, 2, 3, null, 5 from p where k % 3 = 0 union all select k, record, 3, '', 'int', 0, 0, false, 0, 4, null, null from p where k % 3 = 0)
 select record, row_number() over (partition by k order by o) - 1 as pos, name, type, "offset", size, is_ancestor, bit_first, bit_width, hole_after, bit_hole_after from m""",
)
def src14_members(t):
    return debug.layouts(layout_text(t))[1].drop("file", "place", "bit_unit")


@query("SRC14_not_found", "select 'p' || p_partkey % 3 as file, 'R' || p_partkey as name from part where p_partkey % 5 = 0")
def src14_not_found(t):
    return debug.layouts(layout_text(t))[2]
