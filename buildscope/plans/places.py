"""Joins by address, line, file and partial name (J, parts of M) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import core as O
from ..operators import located as L
from .registry import n_rows, pick, query, sql_pick


@query("J1_unique_key", "with o as (select o_custkey c, arg_max(o_totalprice, o_orderkey) last from orders group by 1) select c_custkey, c_name, last from customer join o on c = c_custkey")
def j1(t):
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", "o_orderkey").alias("last"))  # of equal keys the last counts
    return t.customer.select("c_custkey", "c_name").join(last, "c_custkey")


MARKS = "m as (select p_partkey id, p_partkey * 251.0 lo, 40.0 * (p_partkey % 4) size from part), x as (select o_orderkey, floor(o_totalprice / 251) * 251 + case when o_orderkey % 3 = 0 then 0 else o_orderkey % 251 end x from orders)"


def marks(t):
    k = F.col("p_partkey")
    m = t.part.select(k.alias("id"), (k * F.lit(251.0)).alias("lo"), (F.lit(40.0) * (k % 4)).alias("size"))
    o = F.col("o_orderkey")
    return m, t.orders.select("o_orderkey", (F.floor(F.col("o_totalprice") / 251) * 251 + F.when(o % 3 == 0, 0).otherwise(o % 251)).cast("double").alias("x"))


@query("J5_asof_fallback", f"""with {MARKS}, c as (select o_orderkey, x, id, lo, row_number() over (partition by o_orderkey order by size, id) r from x join m on x >= lo and x < lo + size),
h as (select o_orderkey, id, x - lo as off, case when x = lo then 'exact' else 'contained' end reason from c where r = 1), rest as (select * from x where o_orderkey not in (select o_orderkey from h)),
n as (select o_orderkey, m.id, (x - m.lo) as off, case when m.id is null then 'not_found' else 'nearest' end reason from rest asof left join m on x >= m.lo) select o_orderkey, id, off::double as "offset", reason from h union all select o_orderkey, id, off::double, reason from n""")
def j5(t):
    m, x = marks(t)
    return L.located(x, m, "o_orderkey", "x", "lo", "size", "id", 1000.0)


@query("J6_innermost", """with p as (select distinct l_orderkey f, l_linenumber * 10 + l_partkey line from lineitem), r as (select l_orderkey f, l_partkey lo, l_partkey + l_quantity::bigint * 3 hi, l_linenumber * 100000 + l_partkey name from lineitem)
 select p.f || ':' || line as id, arg_min(r.name, (line - lo, r.name)) as name from p left join r on p.f = r.f and line >= lo and line <= hi group by 1""")
def j6(t):
    points = t.lineitem.select(F.col("l_orderkey").alias("f"), (F.col("l_linenumber") * 10 + F.col("l_partkey")).alias("line")).distinct().withColumn("id", F.concat("f", F.lit(":"), "line"))
    ranges = t.lineitem.select(F.col("l_orderkey").alias("f"), F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity").cast("long") * 3).alias("hi"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("name"))
    return L.enclosing(points, ranges, "id", "f", "line", "lo", "hi", "name")


@query("J7_asof_elsewhere", """with e as (select event_id id, user_id f, event_id // 50 var, event_type = 'signup' mark from events), s as (select * from e where mark), p as (select * from e where not mark),
o as (select p.id, max(s.id) own from p left join s on s.f = p.f and s.var = p.var and s.id <= p.id group by 1), g as (select p.id, min(s.id) other from p left join s on s.var = p.var and s.f <> p.f group by 1)
select o.id event_id, coalesce(own, other) as binding, own is null and other is not null as "cross" from o join g using (id)""")
def j7(t):
    e = t.events.select("event_id", "user_id", F.floor(F.col("event_id") / 50).alias("var"), F.col("event_id").alias("pos"), "event_type")
    marks = e.where("event_type = 'signup'").select("var", "user_id", "pos", F.col("event_id").alias("binding"))
    return L.asof_or_elsewhere(e.where("event_type <> 'signup'").drop("event_type"), marks, "event_id", "var", "user_id", "pos", "binding")


NAMES = "replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/', '::')"


def names(t):
    url = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return F.regexp_replace(url, "/", "::")


@query("J10_suffix_match", f"with n as (select distinct {NAMES} a from pages), s as (select distinct regexp_extract(a, '[^:]+::[^:]+$') b from n where length(a) % 3 > 0) select a, b from n, s where a = b or ends_with(a, '::' || b) or ends_with(b, '::' || a)")
def j10(t):
    a = t.pages.select(names(t).alias("a")).distinct()
    b = a.where(F.length("a") % 3 > 0).select(F.regexp_extract("a", "[^:]+::[^:]+$", 0).alias("b")).distinct()
    return L.suffix_match(a, b, "a", "b")


@query("J12_layout_compare", """with p as (select p_partkey, p_size size, p_size % 8 * 4 "offset" from part), o as (select p_partkey, size + (p_partkey % 5 = 0)::int size, "offset" + (p_partkey % 7 = 0)::int "offset" from p where p_partkey % 3 <> 0)
select p.p_partkey, o.p_partkey is not null as observed, coalesce(concat_ws('; ', case when p.size <> o.size then 'size: predicted ' || p.size || ', observed ' || o.size end, case when p."offset" <> o."offset" then 'offset: predicted ' || p."offset" || ', observed ' || o."offset" end), '') as said from p left join o on p.p_partkey = o.p_partkey""")
def j12(t):
    p = t.part.select("p_partkey", F.col("p_size").alias("size"), (F.col("p_size") % 8 * 4).alias("offset"))
    k = F.col("p_partkey")
    o = p.where(k % 3 != 0).select("p_partkey", (F.col("size") + (k % 5 == 0).cast("int")).alias("size"), (F.col("offset") + (k % 7 == 0).cast("int")).alias("offset"))
    return L.compared_layouts(p, o, "p_partkey", ["size", "offset"]).select("p_partkey", "observed", F.array_join("disagreements", "; ").alias("said"))


@query("J14_stepped", """with u as (select p_partkey ord, p_partkey * 32 a, p_size z, p_brand f from part), s as (select o_orderkey, o_orderkey % 5000 * 2 a, case when o_orderkey % 4 = 0 then 'own.c' when o_orderkey % 4 = 1 then '' end f from orders)
, h as (select o_orderkey, arg_max(u.f, u.ord) uf from s join u on s.a >= u.a and s.a < u.a + u.z and (s.a - u.a) % 4 = 0 group by 1) select s.o_orderkey, case when f is not null and f <> '' then f else coalesce(uf, f) end as file from s left join h on h.o_orderkey = s.o_orderkey""")
def j14(t):
    units = t.part.select(F.col("p_partkey").alias("ord"), (F.col("p_partkey") * 32).alias("a"), F.col("p_size").alias("z"), F.col("p_brand").alias("file"))
    k = F.col("o_orderkey")
    symbols = t.orders.select("o_orderkey", (k % 5000 * 2).alias("addr"), F.when(k % 4 == 0, "own.c").when(k % 4 == 1, "").alias("file"))
    return L.stepped(symbols, units, "o_orderkey", "addr", "a", "z", "file", "ord", 4, 64.0).select("o_orderkey", "file")


@query("J15_cross_reference", "with r as (select l_suppkey file, l_partkey as name, min(l_orderkey) pos from lineitem group by 1, 2), d as (select distinct p_partkey % 100 file, p_partkey as name from part union select p_partkey % 37, p_partkey from part where p_size > 20) select r.file, r.name, r.pos, d.file def_file from r join d on r.name = d.name where r.file <> d.file")
def j15(t):
    refs = t.lineitem.select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("pos"))
    k = F.col("p_partkey")
    defs = t.part.select((k % 100).alias("file"), k.alias("name")).unionByName(t.part.where("p_size > 20").select((k % 37).alias("file"), k.alias("name")))
    return L.cross_reference(refs, defs, "file", "name", "pos")


@query("J16_file_pairs", """with s as (select p_partkey k, 'src/d' || p_partkey % 5 || '/' d from part)
select d || 'm' || k || '.h' header, d || 'm' || k || case k % 6 when 0 then '.c' else '.cpp' end impl from s where k % 6 in (0, 1) union all select d || 'm' || k || '.h', d || 'm' || k || '_driver.c' from s where k % 6 = 2
 union all select d || 'm' || k || '_api.h', d || 'm' || k || '.c' from s where k % 6 = 3 union all select d || 'm' || k || '.h', d || 'm' || k || '.c' from s where k % 6 = 5""")
def j16(t):
    k = F.col("p_partkey")
    base = F.concat(F.lit("src/d"), k % 5, F.lit("/m"), k)
    made = {0: (".h", ".c", ".cpp"), 1: (".h", ".cpp"), 2: (".h", "_driver.c"), 3: ("_api.h", ".c"), 4: (".h", "x.c"), 5: (".h", "_api.h", ".c", "_zz.c")}
    kinds = F.create_map(*(x for n, ends in made.items() for x in (F.lit(n), F.array(*map(F.lit, ends)))))
    files = t.part.select(base.alias("base"), F.explode(kinds[(k % 6).cast("int")]).alias("end")).select(F.concat("base", "end").alias("path"))
    return L.file_pairs(files, "path")


@query("J17_includes", """with f as (select 'lib/d' || p_partkey % 7 || '/h' || p_partkey % 40 || '.h' path from part group by 1), i as (select case when p_partkey % 3 = 0 then 'd' || p_partkey % 9 || '/' else '' end || 'H' || p_partkey % 45 || '.h' header from part group by 1),
i2 as (select replace(header, 'H', 'h') header from i group by 1), g as (select header, path, ends_with(path, header) e from i2 join f on split_part(header, '/', -1) = split_part(path, '/', -1)) select header, path from (select *, bool_or(e) over (partition by header) a from g) where e or not a""")
def j17(t):
    k = F.col("p_partkey")
    files = t.part.select(F.concat(F.lit("lib/d"), k % 7, F.lit("/h"), k % 40, F.lit(".h")).alias("path")).distinct()
    includes = t.part.select(F.concat(F.when(k % 3 == 0, F.concat(F.lit("d"), k % 9, F.lit("/"))).otherwise(""), F.lit("h"), k % 45, F.lit(".h")).alias("header"))
    return L.resolved_includes(includes, files, "header", "path")


@query("J20_override_fanout", "with c as (select distinct l_suppkey caller, l_partkey % 50 class from lineitem), m as (select p_partkey % 50 class, p_partkey method from part where p_size > 45) select class, caller, method from c join m using (class)")
def j20(t):
    callers = t.lineitem.select(F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % 50).alias("class")).distinct()
    methods = t.part.where("p_size > 45").select((F.col("p_partkey") % 50).alias("class"), F.col("p_partkey").alias("method"))
    return L.every_pair(callers, methods, "class", "caller", "method")


@query("M9_drill_down", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey = 11) order by l_quantity desc, l_orderkey, l_linenumber, l_partkey limit 40")
def m9(t):
    own = t.orders.where("o_custkey = 11").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(own, "l_orderkey", "left_semi").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey").limit(40).select("l_orderkey", "l_linenumber", "l_quantity")


@query("M12_line_of_offset", "with d as (select doc_id, text, doc_id % 97 * 11 o from documents where length(text) > doc_id % 97 * 11), p as (select doc_id, left(text, o) head from d) select doc_id, length(head) - length(replace(head, chr(10), '')) + 1 as line, length(split_part(head, chr(10), -1)) as col from p")
def m12(t):
    d = t.documents.withColumn("o", F.col("doc_id") % 97 * 11).where(F.length("text") > F.col("o"))
    head = F.expr("substring(text, 1, cast(o as int))")
    return d.select("doc_id", (F.length(head) - F.length(F.regexp_replace(head, "\n", "")) + 1).cast("long").alias("line"), F.length(F.substring_index(head, "\n", -1)).cast("long").alias("col"))


MEMBERS = ("std::unique_ptr<Foo>", "Foo*", "Foo&", "std::shared_ptr<Bar>", "Foo", "std::weak_ptr<Baz>", "const Bar *")


@query("M13_member_relation", f"with s as (select p_partkey, {sql_pick('p_partkey', MEMBERS)} m from part) select p_partkey, case when contains(m, 'unique_ptr') then 'composition' when contains(m, 'shared_ptr') or contains(m, 'weak_ptr') or contains(m, '*') or contains(m, '&') then 'aggregation' else 'composition' end kind, regexp_extract(m, '(Foo|Bar|Baz)') target from s")
def m13(t):
    m = pick(F.col("p_partkey"), MEMBERS)
    kind = F.when(m.contains("unique_ptr"), "composition").when(m.rlike("shared_ptr|weak_ptr|[*&]"), "aggregation").otherwise("composition")
    return t.part.select("p_partkey", kind.alias("kind"), F.regexp_extract(m, "(Foo|Bar|Baz)", 1).alias("target"))


@query("M14_class_edges", "with e as (select distinct l_suppkey a, l_partkey b, l_returnflag kind from lineitem), n as (select p_partkey k from part where p_size > 15) select a, b, kind from e where a <> b and kind in ('A', 'R') and a in (select k from n) and b in (select k from n)")
def m14(t):
    e = t.lineitem.where("l_returnflag in ('A', 'R') and l_suppkey <> l_partkey").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_returnflag").alias("kind")).distinct()
    return O.induced(e, t.part.where("p_size > 15"), "a", "b", "p_partkey")


@query("M25_row_at_cursor", """with p as (select o_orderkey, o_orderkey % 8 line from orders), r as (select l_orderkey f, l_linenumber lo, l_linenumber + l_quantity::bigint % 3 hi, l_linenumber * 100000 + l_partkey as name, l_quantity q from lineitem), i as (select o_orderkey, arg_min(name, (line - lo, name)) a from p join r on f = o_orderkey and line between lo and hi group by 1),
m as (select f, arg_max(name, (q, name)) b from r group by 1) select p.o_orderkey, coalesce(a, b) as name from p left join i on i.o_orderkey = p.o_orderkey left join m on m.f = p.o_orderkey""")
def m25(t):
    p = t.orders.select("o_orderkey", (F.col("o_orderkey") % 8).alias("line"))
    r = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + F.col("l_quantity").cast("long") % 3).alias("hi"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("name"), F.col("l_quantity").alias("q"))
    here = L.enclosing(p, r, "o_orderkey", "o_orderkey", "line", "lo", "hi", "name")
    most = r.groupBy("o_orderkey").agg(F.max_by("name", F.struct("q", "name")).alias("most"))
    return here.join(most, "o_orderkey", "left").select("o_orderkey", F.coalesce("name", "most").alias("name"))


@query("M27_touching", "select o_orderkey from orders where o_custkey = 5 union select l_orderkey from lineitem where l_suppkey = 3")
def m27(t):
    return t.orders.where("o_custkey = 5").select("o_orderkey").unionByName(t.lineitem.where("l_suppkey = 3").select(F.col("l_orderkey").alias("o_orderkey"))).distinct()


@query("M32_function_by_label", f"with {MARKS}, f as (select id, lo, coalesce(lead(lo) over (order by lo), 1e18) hi from m where id % 10 = 0) select o_orderkey, id from x left join f on x >= lo and x < hi")
def m32(t):
    m, x = marks(t)
    return L.nearest_below(x, m.where("id % 10 = 0"), "x", "lo", "id", ["id"], 5000.0).select("o_orderkey", F.col("asof_id").alias("id"))


@query("J9_waterfall_labelled", """with n as (select c_custkey, c_nationkey, n_regionkey from customer join nation on c_nationkey = n_nationkey), s as (select s_suppkey, s_nationkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey where s_nationkey % 3 > 0 and n_regionkey < 4),
c as (select c_custkey, s_suppkey, 1 priority from n join s on c_nationkey = s_nationkey union all select c_custkey, s_suppkey, 2 from n join s on n.n_regionkey = s.n_regionkey union all select c_custkey, s_suppkey, 3 from n, s),
r as (select *, rank() over (partition by c_custkey order by priority) r from c), k as (select *, count(*) over (partition by c_custkey) n from r where r = 1) select c_custkey, s_suppkey, priority, case when n = 1 then 'direct' else 'virtualCandidate' end kind from k where n <= 12""")
def j9(t):
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(t.nation.select("n_nationkey", "n_regionkey"), "n_nationkey").withColumn("every", F.lit(1))
    s = t.supplier.where("s_nationkey % 3 > 0").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(t.nation.where("n_regionkey < 4").select("n_nationkey", "n_regionkey"), "n_nationkey").withColumn("every", F.lit(1))
    return L.capped_tiers(c, s, "c_custkey", "s_suppkey", ["n_nationkey", "n_regionkey", "every"], 12)
