"""Graph operators on trees and small graphs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import longest as L
from .registry import n_rows, query

HEAP = "with recursive e as (select p_partkey src, p_partkey // 2 dst from part where p_partkey > 1), "


def heap(t):
    """Each part's key to half of it."""
    return t.part.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"))


def node(t, *keys):
    return t.spark.createDataFrame([(k,) for k in keys], "node long")


@query("G1_slice", HEAP + "o as (select 12::bigint node, 0 d union all select dst, d + 1 from o join e on node = src where d < 3), i as (select 12::bigint node, 0 d union all select src, d + 1 from i join e on node = dst where d < 3), n as (select node, min(d)::bigint depth from (from o union all from i) group by 1) select node, depth, (select count(*) from n) > 10 truncated from n order by depth, node limit 10")
def g1(t):
    return G.sliced(heap(t), node(t, 12), 3, 10)[0]


@query("G1_slice_edges", HEAP + "o as (select 12::bigint node, 0 d union all select dst, d + 1 from o join e on node = src where d < 3), i as (select 12::bigint node, 0 d union all select src, d + 1 from i join e on node = dst where d < 3), n as (select distinct node from (from o union all from i)) select distinct src, dst from e where src in (select node from n) and dst in (select node from n) and (src in (select node from o where d < 3) or dst in (select node from i where d < 3))")
def g1_edges(t):
    return G.sliced(heap(t), node(t, 12), 3, 1000)[1]


@query("G4_reach", HEAP + "w as (select 37::bigint node union select 90::bigint union select dst from w join e on node = src) select node from w")
def g4(t):
    return G.reachable(heap(t), node(t, 37, 90))


RING = "e as (select distinct p_partkey % 97 src, ((p_partkey % 97) * (p_partkey % 97) + 1) % 97 dst from part union select distinct p_partkey % 13 + 200, (p_partkey % 13 + 1) % 13 + 200 from part where p_partkey % 13 < 5 or p_partkey % 13 = 12)"


def ring(t):
    k, m = F.col("p_partkey") % 97, F.col("p_partkey") % 13
    return t.part.select(k.alias("src"), ((k * k + 1) % 97).alias("dst")).unionByName(t.part.where((m < 5) | (m == 12)).select((m + 200).alias("src"), ((m + 1) % 13 + 200).alias("dst"))).distinct()


@query("G5_cycles", f"with recursive {RING}, w as (select src start, [src] path, dst nxt from e where dst >= src union all select start, list_append(path, nxt), dst from w join e on e.src = nxt where nxt <> start and not list_contains(path, nxt) and dst >= start and len(path) < 9) select array_to_string(path, '>') as cycle from w where nxt = start")
def g5(t):
    return G.cycles(ring(t), 9).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("cycle"))


@query("G6_deepest_path", HEAP + "w as (select 1::bigint node, ['1'] path union all select src, list_append(path, src::varchar) from w join e on node = dst), d as (select path from w order by len(path) desc, path[-1]::bigint limit 1) select array_to_string(path, '>') as path from d")
def g6(t):
    every = G.simple_paths(G.backwards(heap(t)), node(t, 1), 64)
    top = every.orderBy(F.desc(F.size("path")), F.element_at("path", -1)).limit(1)  # one path is the answer
    return top.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("G7_longest_path_way", HEAP + "w as (select p_partkey node, p_partkey pos, p_size::bigint total, p_partkey::varchar path from part union all select node, dst, total + p_size, path || '>' || dst from w join e on pos = src join part on p_partkey = dst) select node, max(total) worst, arg_max(path, len(path)) path from w group by 1")
def g7(t):
    out = G.cut(L.longest(heap(t), t.part.select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("weight"))))
    return out.join(L.ways(out), "node").select("node", "worst", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("G11_shortest_path", HEAP + "u as (select src, dst from e union select dst, src from e), w as (select 11::bigint node, ['11'] path union all select dst, list_append(path, dst::varchar) from w join u on node = src where not list_contains(path, dst::varchar) and len(path) < 14), p as (select path from w where node = 29 order by len(path) limit 1) select unnest(range(len(path))) as place, unnest(path)::bigint as node from p")
def g11(t):
    return G.shortest_path(heap(t), 11, 29)


@query("G12_class_depths", HEAP + "u as (select src, dst from e union select dst, src from e), w as (select 6::bigint node, 0 depth union select dst, depth + 1 from w join u on node = src where depth < 4) select node, min(depth)::bigint depth from w group by 1")
def g12(t):
    return G.hops(G.both_ways(heap(t)), node(t, 6), 4)


@query("M19_columns", HEAP + "w as (select 2::bigint node, 0 d union all select src, d + 1 from w join e on node = dst), m as (select max(d) + 1 last from w) select p_partkey as node, coalesce(d, (select last from m))::bigint as col from part left join w on node = p_partkey")
def m19(t):
    depth = G.hops(G.backwards(heap(t)), node(t, 2))
    last = depth.agg((F.max("depth") + 1).alias("last"))
    return t.part.select(F.col("p_partkey").alias("node")).join(depth, "node", "left").crossJoin(F.broadcast(last)).select("node", F.coalesce("depth", "last").alias("col"))  # last is one row


@query("G17_layers", HEAP + "w as (select p_partkey node, p_partkey pos, 0::bigint layer from part union all select node, dst, layer + 1 from w join e on pos = src join part on p_partkey = dst) select node, max(layer) as layer from w group by 1")
def g17(t):
    out = L.longest(heap(t), t.part.select(F.col("p_partkey").alias("node"), F.lit(1).cast("long").alias("weight")))
    return out.select("node", (F.col("worst") - 1).alias("layer"))


@query("G15_ancestors", "with p as (select page_id, list_filter(string_split(url, '/'), lambda x: x <> '') l from pages), a as (select page_id, l, unnest(range(len(l) - 1, -1, -1)) i from p) select page_id, len(l) - 1 - i as place, array_to_string(l[1:i], '/') as folder from a")
def g15(t):
    return t.pages.select("page_id", F.posexplode(G.ancestors(F.col("url"))).alias("place", "folder")).withColumn("place", F.col("place").cast("long"))


KIND = "case event_type when 'click' then 'enter' when 'signup' then 'exit' when 'purchase' then 'exit' else 'leaf' end"


@query("G14_call_tree", f"""with k as (select event_id, user_id, {KIND} kind from events), s as (select *, sum(case kind when 'enter' then 1 when 'exit' then -1 else 0 end) over (partition by user_id order by event_id) s from k),
l as (select *, s - least(0, min(s) over (partition by user_id order by event_id)) - (kind = 'enter')::int as level from s), c as (select * from l where kind <> 'exit')
select a.event_id, a.level::bigint as level, max(b.event_id) as parent from c a left join c b on b.kind = 'enter' and b.user_id = a.user_id and b.level = a.level - 1 and b.event_id < a.event_id group by 1, 2""")
def g14(t):
    kind = F.when(F.col("event_type") == "click", "enter").when(F.col("event_type").isin("signup", "purchase"), "exit").otherwise("leaf")
    return G.call_tree(t.events.select("event_id", "user_id", kind.alias("kind")), "user_id", "event_id", "kind").select("event_id", "level", "parent")


@query("M36_unexpanded", "select l_partkey node, count(*) n from lineitem where l_partkey not in (select l_suppkey * 7 from lineitem) and l_partkey % 2 = 0 group by 1")
def m36(t):
    out = t.lineitem.select((F.col("l_suppkey") * 7).alias("l_partkey"))
    return t.lineitem.where("l_partkey % 2 = 0").join(out, "l_partkey", "left_anti").groupBy(F.col("l_partkey").alias("node")).agg(n_rows().alias("n"))


@query("M37_bounded_out", HEAP + "o as (select 45::bigint node, 0 d union all select dst, d + 1 from o join e on node = src where d < 2) select node, min(d)::bigint as depth, (select count(*) from o join e on node = src where d = 2) > 0 as truncated from o group by 1")
def m37(t):
    edges = heap(t)
    found = G.cut(G.hops(edges, node(t, 45), 2))
    more = not found.where("depth = 2").join(edges.select(F.col("src").alias("node")), "node", "left_semi").isEmpty()
    return found.withColumn("truncated", F.lit(more))
