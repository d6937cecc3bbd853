"""Virtual dispatch (G9, G10, M35) on a class model made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dispatch as D
from .registry import pick, query, sql_pick

KINDS = ("composition", "dependency", "aggregation", "friendship", "association")

# The model in SQL: a tree of classes by thirds, second bases by halves, holders, members and methods.
MODEL = f"""with recursive k as (select p_partkey k from part),
types as (select 'c' || k as id, 'C' || k || case when k % 9 = 4 then '<int>' else '' end as name, 'n' || k % 5 || '::C' || k || case when k % 9 = 4 then '<int>' else '' end as qualified, k % 4 = 0 as is_abstract, k as ord from k),
up as (select 'c' || k as src, 'c' || (k // 3) as dst from k where k > 2 union select 'c' || k, 'c' || (k // 2) from k where k % 5 = 0 and k > 3),
holds as (select 'c' || k as src, 'c' || (k * 7 % 97 + 1) as dst, {sql_pick('k', KINDS)} as kind, k + 1000000 as ord from k),
members as (select 'c' || k as type_id, 0 as ord, 'm' as name, case k % 4 when 1 then 'const C' || (k * 11 % 601) || ' &' when 2 then 'std::map<int, C' || (k % 50) || ' *>' when 3 then 'C' || k % 7 || '<int> x' else 'int' end as type from k),
methods as (select 'c' || k as type_id, 0 as ord, 'draw' as name, k % 3 as n_params, k % 10 <> 7 as is_virtual, k % 4 = 0 and k % 10 <> 7 as is_pure from k
  union all select 'c' || k, 1, 'draw', 1, true, false from k where k % 6 = 1
  union all select 'c' || k, 2, 'size', 0, k % 2 = 0, false from k where k % 3 = 1),
words as (select t.ord as at, m.ord as place, t.qualified as holder, m.name as member, m.type as text, unnest(list_distinct(regexp_extract_all(m.type, '\\w+'))) as word from members m join types t on t.id = m.type_id),
said as (select t.id, min((w.at, w.place, w.holder, w.member)) as mention from types t join words w on w.word = regexp_extract(t.name, '\\w+') and (t.name = w.word or regexp_matches(w.text, '\\b' || replace(replace(t.name, '<', '[<]'), '>', '[>]') || '\\b')) group by 1),
held as (select dst as id, arg_min(src, ord) as src, arg_min(kind, ord) as kind from holds where kind in ('composition', 'aggregation', 'association') group by 1),
evidence as (select t.id, case when t.is_abstract then 'abstract' when mention is not null then 'member' when held.kind is not null then 'held' else 'none' end as reason,
  case when t.is_abstract then null when mention is not null then mention[3] when held.kind is not null then coalesce(o.qualified, 'another type') end as holder,
  case when t.is_abstract then null when mention is not null then mention[4] else held.kind end as member
  from types t left join said using (id) left join held using (id) left join types o on o.id = held.src)"""

RESOLVED = (
    MODEL
    + """,
asked as (select distinct static_type, method, arity from requests),
below as (select distinct t.id as root, t.id as type from asked join types t on t.qualified = static_type union select root, src from below join up on dst = type),
chosen as (select a.*, b.root, b.type, arg_min(m.is_virtual, m.ord) as is_virtual, arg_min(m.is_pure, m.ord) as is_pure
  from asked a join types t on t.qualified = a.static_type join below b on b.root = t.id join methods m on m.type_id = b.type and m.name = a.method and (a.arity is null or m.n_params = 0 or m.n_params = a.arity) group by all),
exact as (select static_type, method, arity from chosen where type = root and not is_virtual),
found as (select c.static_type, c.method, c.arity, t.qualified as type, case when x.method is not null then 'not virtual' else reason end as reason, case when x.method is not null or reason in ('member', 'held') then 'strong' else 'none' end as strength, x.method is not null as exact
  from chosen c left join exact x on x.static_type = c.static_type and x.method = c.method and x.arity is not distinct from c.arity join evidence e on e.id = c.type join types t on t.id = c.type
  where (x.method is not null and c.type = c.root) or (x.method is null and not is_pure and reason <> 'abstract')),
counts as (select static_type, method, arity, count(*) as n, count(*) filter (strength = 'strong') as strong, bool_or(exact) as exact from found group by all),
calls as (select a.static_type, a.method, a.arity, case when exact then 'exact' when n is null then 'unresolved' when n = 1 then 'devirtualised' when strong > 0 and strong < n then 'rta' else 'cha' end as resolution, coalesce(n, 0) as n
  from asked a left join counts c on c.static_type = a.static_type and c.method = a.method and c.arity is not distinct from a.arity)"""
)

REQUESTS = "requests as (select case when l_partkey % 50 = 49 then 'x::Unknown' else 'n' || l_partkey % 5 || '::C' || l_partkey || case when l_partkey % 9 = 4 then '<int>' else '' end end as static_type, ['draw', 'size', 'area'][l_linenumber % 3 + 1] as method, case when l_linenumber < 5 then l_suppkey % 3 end as arity from lineitem)"
GRAPH = "nodes as (select distinct 'f' || l_suppkey as node from lineitem union select distinct 'n' || l_partkey % 5 || '::C' || l_partkey || case when l_partkey % 9 = 4 then '<int>' else '' end || '::draw' from lineitem where l_linenumber = 1), edges as (select distinct 'f' || l_suppkey as src, 'n' || l_partkey % 5 || '::C' || l_partkey || case when l_partkey % 9 = 4 then '<int>' else '' end || '::draw' as dst, 'direct' as resolution from lineitem where l_linenumber = 1)"


def asked(ctes: str) -> str:
    """The model and the resolution with the requests (and what they are made of) put first."""
    return RESOLVED.replace(",\nasked as", ", " + ctes + ",\nasked as", 1)


def name(k, with_space=True):
    own = F.concat(F.lit("C"), k, F.when(k % 9 == 4, "<int>").otherwise(""))
    return F.concat(F.lit("n"), k % 5, F.lit("::"), own) if with_space else own


def identity(k):
    return F.concat(F.lit("c"), k.cast("long"))


def model(t) -> D.Model:
    k, parts = F.col("p_partkey"), t.part
    types = parts.select(identity(k).alias("id"), name(k, False).alias("name"), name(k).alias("qualified"), (k % 4 == 0).alias("is_abstract"), k.alias("ord"))
    up = lambda n: (identity(k).alias("src"), identity(F.floor(k / n)).alias("dst"), F.lit("inheritance").alias("kind"), k.alias("ord"))
    holds = parts.select(identity(k).alias("src"), identity(k * 7 % 97 + 1).alias("dst"), pick(k, KINDS).alias("kind"), (k + 1000000).alias("ord"))
    relations = parts.where("p_partkey > 2").select(*up(3)).unionByName(parts.where("p_partkey % 5 = 0 and p_partkey > 3").select(*up(2))).unionByName(holds)
    mentions = F.when(k % 4 == 1, F.format_string("const C%d &", k * 11 % 601)).when(k % 4 == 2, F.format_string("std::map<int, C%d *>", k % 50)).when(k % 4 == 3, F.format_string("C%d<int> x", k % 7)).otherwise("int")
    members = parts.select(identity(k).alias("type_id"), F.lit(0).alias("ord"), F.lit("m").alias("name"), mentions.alias("type"))
    row = lambda ord_, name_, n, virtual, pure: (identity(k).alias("type_id"), F.lit(ord_).alias("ord"), F.lit(name_).alias("name"), n.cast("long").alias("n_params"), virtual.alias("is_virtual"), pure.alias("is_pure"))
    draw = parts.select(*row(0, "draw", k % 3, k % 10 != 7, (k % 4 == 0) & (k % 10 != 7)))
    more = parts.where("p_partkey % 6 = 1").select(*row(1, "draw", F.lit(1), F.lit(True), F.lit(False)))
    size = parts.where("p_partkey % 3 = 1").select(*row(2, "size", F.lit(0), k % 2 == 0, F.lit(False)))
    return D.Model(types, relations, members, draw.unionByName(more).unionByName(size))


def requests(t):
    part = F.col("l_partkey")
    static = F.when(part % 50 == 49, "x::Unknown").otherwise(name(part))
    return t.lineitem.select(static.alias("static_type"), pick(F.col("l_linenumber"), ("draw", "size", "area")).alias("method"), F.when(F.col("l_linenumber") < 5, F.col("l_suppkey") % 3).alias("arity"))


@query("G10_evidence", MODEL + " select * from evidence")
def g10(t):
    return D.evidence(model(t))


@query("G9_resolution", asked(REQUESTS) + " select static_type, method, arity, resolution, case when resolution in ('exact', 'devirtualised') then 'certain' when resolution = 'unresolved' then 'unknown' else 'bounded' end as certainty, n from calls")
def g9(t):
    return D.resolve(model(t), requests(t))[0]


@query("G9_candidates", asked(REQUESTS) + " select static_type, method, arity, row_number() over (partition by static_type, method, arity order by strength desc, type) as rank, type || '::' || method as target, type, reason, strength from found")
def g9_candidates(t):
    return D.resolve(model(t), requests(t))[1]


SLOTS = "slots as (select t.qualified || '::' || m.name as dst, t.qualified as static_type, m.name as method from methods m join types t on t.id = m.type_id group by all having arg_max(m.is_virtual, m.ord) and t.qualified || '::' || m.name in (select dst from edges)), requests as (select static_type, method, null::bigint as arity from slots)"
NEW = "new as (select distinct s.dst as src, f.type || '::' || f.method as dst, case when c.resolution = 'devirtualised' then 'devirtualised' else 'rta' end as resolution from slots s join calls c using (static_type, method) join found f using (static_type, method) where c.resolution <> 'exact' and f.type || '::' || f.method <> s.dst)"


@query("M35_expanded_edges", asked(GRAPH + ", " + SLOTS) + ", " + NEW + " select e.src, e.dst, case when c.resolution = 'unresolved' then c.resolution when c.resolution <> 'exact' then 'cha' else e.resolution end as resolution from edges e left join slots s on s.dst = e.dst left join calls c on c.static_type = s.static_type and c.method = s.method union all select * from new where (src, dst) not in (select (src, dst) from edges)")
def m35(t):
    return D.expand(model(t), *graph(t))[1]


@query("M35_expanded_nodes", asked(GRAPH + ", " + SLOTS) + ", " + NEW + " select node from nodes union select dst from new")
def m35_nodes(t):
    return D.expand(model(t), *graph(t))[0]


def graph(t):
    edges = t.lineitem.where("l_linenumber = 1").select(F.concat(F.lit("f"), "l_suppkey").alias("src"), F.concat(name(F.col("l_partkey")), F.lit("::draw")).alias("dst"), F.lit("direct").alias("resolution")).distinct()
    return t.lineitem.select(F.concat(F.lit("f"), "l_suppkey").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct(), edges


@query("G9_live_types")
def g9_live(t):
    """No SQL: two relations that grow together; tests/test_dispatch.py holds live() against brute force."""
    own, calls = model(t), t.lineitem.where("l_linenumber < 3")
    function = lambda c: F.concat(F.lit("f"), c)
    direct = calls.select(function(F.col("l_suppkey")).alias("src"), F.concat(name(F.col("l_partkey")), F.lit("::draw")).alias("dst")).where("l_partkey % 7 = 0")
    inside = t.part.select(F.concat(name(F.col("p_partkey")), F.lit("::draw")).alias("src"), identity(F.col("p_partkey") * 5 % 199 + 1).alias("static_type"), F.lit("draw").alias("method"))
    virtual = calls.select(function(F.col("l_suppkey")).alias("src"), identity(F.col("l_partkey")).alias("static_type"), F.lit("size").alias("method")).unionByName(inside)
    makes = t.part.select(F.concat(name(F.col("p_partkey")), F.lit("::draw")).alias("src"), identity(F.col("p_partkey") * 3 % 211 + 1).alias("type"))
    creates = calls.where("l_partkey % 11 = 0").select(function(F.col("l_suppkey")).alias("src"), identity(F.col("l_partkey")).alias("type")).unionByName(makes)
    functions, types = D.live(own, direct, virtual, creates, t.supplier.where("s_nationkey = 3").select(function(F.col("s_suppkey")).alias("node")))
    return functions.select(F.lit("function").alias("kind"), F.col("node").alias("name")).unionByName(types.select(F.lit("type").alias("kind"), F.col("type").alias("name")))
