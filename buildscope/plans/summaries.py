"""Ledgers, ranks, pairs and streams with state (A3, A12, A19, A23, J13, T1, M26, W8, SRC7, SRC23, ST9, ST10), made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import longest as L
from ..operators import summaries as Z
from ..sources import builds as B
from ..streaming import telemetry as S
from .registry import pick, query
from .texts import through_texts


@query(
    "A3_reconciled",
    """with s as (select o_orderstatus g, o_orderkey n, o_totalprice::decimal(18,4) size, o_orderkey % 4 = 0 linking from orders), c as (select l_orderkey n, sum(l_extendedprice::decimal(18,4)) claimed from lineitem group by 1),
 p as (select g, size, linking, coalesce(claimed, 0) claimed, greatest(size - coalesce(claimed, 0), 0) gap from s left join c using (n))
 select g as o_orderstatus, sum(size)::double as section_total, sum(claimed)::double as symbol_total, greatest(sum(size) - sum(claimed), 0)::double as unclaimed, coalesce(sum(gap) filter (linking), 0)::double as linking_gap, coalesce(sum(gap) filter (not linking), 0)::double as other_gap,
 round((sum(size) - coalesce(sum(gap) filter (not linking), 0))::double / sum(size)::double, 9) as coverage from p group by 1""",
)
def a3(t):
    money = lambda c: F.col(c).cast("decimal(18,4)")
    sections = t.orders.select("o_orderstatus", F.col("o_orderkey").alias("name"), money("o_totalprice").alias("size"), (F.col("o_orderkey") % 4 == 0).alias("linking"))
    claims = t.lineitem.select(F.col("l_orderkey").alias("name"), money("l_extendedprice").alias("size")).join(sections.select("name", "o_orderstatus"), "name")
    out = Z.reconciled(sections, claims, ["o_orderstatus"])
    return out.select("o_orderstatus", *(F.col(c).cast("double").alias(c) for c in ("section_total", "symbol_total", "unclaimed", "linking_gap", "other_gap")), F.round("coverage", 9).alias("coverage"))


KINDS = ("wtf", "quirk", "idiom", "learned", "never")


@query(
    "A12_ramp_up",
    """with e as (select event_id id, ['wtf', 'quirk', 'idiom', 'learned'][event_id % 4 + 1] as kind, case when event_id % 9 > 0 then 'src/m' || user_id % 20 || '/f' || event_id || '.c' end as file, ts, event_id % 3 = 0 as gone from events),
 z as (select count(*) as total, count(*) filter (kind <> 'learned' and gone) as retired, count(distinct split_part(file, '/', 1) || '/' || split_part(file, '/', 2)) as modules, floor((epoch_ms(timestamp '2024-03-01 12:00:00') - epoch_ms(min(ts) filter (kind = 'wtf'))) / 86400000)::bigint as oldest_days from e)
 select k.kind, coalesce(n, 0) as n, z.* from (select unnest(['wtf', 'quirk', 'idiom', 'learned', 'never']) as kind) k left join (select kind, count(*) n from e group by 1) using (kind), z""",
)
def a12(t):
    k = F.col("event_id")
    file = F.when(k % 9 > 0, F.concat(F.lit("src/m"), F.col("user_id") % 20, F.lit("/f"), k, F.lit(".c")))
    entries = t.events.select(pick(k, KINDS[:4]).alias("kind"), file.alias("file"), F.col("ts").cast("timestamp").alias("created"), F.when(k % 3 > 0, F.col("ts").cast("timestamp")).alias("revisit_at"))
    return Z.ramp_up(entries, KINDS, ("wtf", "quirk", "idiom"), "wtf", F.lit("2024-03-01 12:00:00").cast("timestamp"))


@query(
    "A19_promoted",
    """with e as (select l_suppkey a, l_partkey % 50 b, l_orderkey * 8 + l_linenumber o, l_quantity q, ['direct', 'virtual', 'pointer', 'virtualCandidate', 'odd'][l_orderkey % 5 + 1] kind, l_extendedprice x from lineitem),
 f as (select a, b, kind, case q::bigint % 7 when 0 then true when 1 then false end confirmed, case when q::bigint % 2 = 0 then 'v' || q::bigint end via, (o, q::bigint, x) as o, case kind when 'pointer' then 3 when 'direct' then 1 when 'odd' then 0 else 2 end r from e)
 select a, b, arg_min(kind, (-r, o)) as kind, case when bool_or(confirmed) then true else arg_min_null(confirmed, o) end as confirmed, arg_min_null(via, o) as via, count(*) as sites from f group by 1, 2""",
)
def a19(t):
    q = F.col("l_quantity").cast("long")
    edges = t.lineitem.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b"), F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o"), q.alias("q"), F.col("l_extendedprice").alias("x")).alias("o"), pick(F.col("l_orderkey"), ("direct", "virtual", "pointer", "virtualCandidate", "odd")).alias("kind"), F.when(q % 7 == 0, True).when(q % 7 == 1, False).alias("confirmed"), F.when(q % 2 == 0, F.concat(F.lit("v"), q)).alias("via"))
    return Z.promoted(edges, "a", "b", "o")


@query(
    "A23_collapsed",
    """with k as (select event_type, user_id, min((ts, event_id)) first from events group by 1, 2), r as (select event_type, user_id, row_number() over (partition by event_type order by first) r from k)
 select e.event_type, e.n, e.first_id, string_agg(r.user_id::varchar, ',' order by r.r) places, e.n > 8 as more from r join (select event_type, count(*) n, arg_min(event_id, (ts, event_id)) first_id from events group by 1) e using (event_type) where r.r <= 8 group by all""",
)
def a23(t):
    out = Z.collapsed(t.events, "event_type", "user_id", ["ts", "event_id"])
    return out.select("event_type", "n", F.col("representative.event_id").alias("first_id"), F.array_join(F.col("places").cast("array<string>"), ",").alias("places"), "more")


@query(
    "J13_two_planes",
    """with p as (select distinct 'n' || l_partkey % 3 || '::C' || l_partkey % 90 || '::run' as name from lineitem), o as (select distinct case when l_suppkey % 2 = 0 then 'C' || l_suppkey || '::run' else 'x' || l_suppkey end as name from lineitem),
 m as (select p.name as p, o.name as o from p join o on p.name = o.name or ends_with(p.name, '::' || o.name) or ends_with(o.name, '::' || p.name)),
 r as (select name, case when name in (select p from m) then 'confirmed' else 'never_ran' end as outcome from p)
 select *, (select round(count(*) filter (outcome = 'confirmed') / count(*), 9) from r) as coverage from (from r union all select name, 'unpredicted' from o where name not in (select o from m))""",
)
def j13(t):
    predicted = t.lineitem.select(F.concat(F.lit("n"), F.col("l_partkey") % 3, F.lit("::C"), F.col("l_partkey") % 90, F.lit("::run")).alias("name"))
    observed = t.lineitem.select(F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("C"), "l_suppkey", F.lit("::run"))).otherwise(F.concat(F.lit("x"), "l_suppkey")).alias("name"))
    return Z.two_planes(predicted, observed).withColumn("coverage", F.round("coverage", 9))


@query("T1_sorted_text", "select p_partkey, p_name, row_number() over (order by lower(p_name), p_partkey) as place from part qualify place <= 100")
def t1_text(t):
    return Z.sorted_rows(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey", False, False, 100)


@query("T1_sorted_numbers", "with p as (select p_partkey, case when p_partkey % 4 = 0 then 'none' else p_retailprice::varchar end as shown from part) select p_partkey, shown, row_number() over (order by coalesce(try_cast(shown as double), 0) desc, p_partkey) as place from p qualify place <= 3000")
def t1_numbers(t):
    shown = F.when(F.col("p_partkey") % 4 == 0, "none").otherwise(F.col("p_retailprice").cast("string"))
    return Z.sorted_rows(t.part.select("p_partkey", shown.alias("shown")), "shown", "p_partkey", True, True, 3000)


@query("M26_bands", "select p_partkey, case when p_size / 50.0 >= 0.7 then 'high' when p_size / 50.0 >= 0.4 then 'medium' else 'low' end as band from part")
def m26(t):
    return t.part.select("p_partkey", R.confidence_band(F.col("p_size") / 50.0).alias("band"))


@query("W8_ranks", "with recursive up as (select p_partkey k, p_partkey // 3 as b from part where p_partkey > 2 union select p_partkey, p_partkey // 2 from part where p_partkey % 5 = 0 and p_partkey > 3), r as (select p_partkey k, 0 as rank from part union select up.k, rank + 1 from r join up on up.b = r.k) select k, max(rank)::bigint as rank from r group by 1")
def w8(t):
    k = F.col("p_partkey")
    up = lambda n: (k.alias("src"), F.floor(k / n).cast("long").alias("dst"))
    edges = t.part.where("p_partkey > 2").select(*up(3)).unionByName(t.part.where("p_partkey % 5 = 0 and p_partkey > 3").select(*up(2)))
    found = L.longest(edges, t.part.select(k.alias("node"), F.lit(1).alias("weight")))
    return found.select(F.col("node").alias("k"), (F.col("worst") - 1).alias("rank"))


@query(
    "SRC7_sections",
    """with p as (select p_partkey k, 's' || p_partkey // 20 as file from part) select file, '.text' || k as name, k % 3 = 0 as noload, 'RAM' || k % 4 as vma, case when k % 2 = 0 then 'FLASH' end as lma from p where k % 5 > 0""",
)
def src7(t):
    k = F.col("p_partkey")
    one = F.concat(F.lit("  .text"), k, F.when(k % 3 == 0, " (NOLOAD) : {").otherwise(" : AT (0x100) {"), F.lit(" *(.a) { inner } /* > NO } */ }"), F.when(k % 5 > 0, F.concat(F.lit(" > RAM"), k % 4, F.when(k % 2 == 0, " AT > FLASH").otherwise(""))).otherwise(""), F.lit("\n"))
    texts = t.part.select(F.floor(k / 20).alias("f"), k.alias("k"), one.alias("one")).groupBy("f").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "one"))), lambda x: x["one"]), "").alias("body"))
    files = texts.select(F.concat(F.lit("s"), "f").alias("file"), F.concat(F.lit("MEMORY { }\nSECTIONS\n{\n"), "body", F.lit("}\n")).alias("text"))
    return B.linker_sections(through_texts(files)).drop("place")


@query(
    "SRC23_stem_pairs",
    """with p as (select case p_partkey % 3 when 0 then 'a/b/' when 1 then 'a/' else '' end || 'm' || p_partkey % 41 || case when p_partkey % 4 = 0 then '.su' when p_partkey % 4 = 1 then '.ci' else '.o' end as path, p_partkey % 4 as k, 'm' || p_partkey % 41 as stem from part), d as (select k, stem, arg_min(path, (len(string_split(path, '/')), path)) as path from p group by 1, 2)
 select s.stem, s.path as first, c.path as second from d s join d c on c.stem = s.stem and s.k = 0 and c.k = 1""",
)
def src23(t):
    k = F.col("p_partkey")
    path = F.concat(pick(k, ("a/b/", "a/", "")), F.lit("m"), k % 41, F.when(k % 4 == 0, ".su").when(k % 4 == 1, ".ci").otherwise(".o"))
    return Z.stem_pairs(t.part.select(path.alias("path")), "path", ".su", ".ci")


@query("ST9_monitor", "select user_id, event_id, max(value) over w as peak, value > 80 or event_id % 25 > 20 as alarm, count(*) over v = 30 and first_value(value) over v > 0 and value > 1.15 * first_value(value) over v as growing from events window w as (partition by user_id order by event_id), v as (partition by user_id order by event_id rows between 29 preceding and current row)")
def st9(t):
    stream = S.opened(t.spark, f"{t.folder}/events.parquet").withColumn("threads", F.col("event_id") % 25)
    return S.drained(S.monitored(stream, "user_id", "event_id", "value", "threads"))


@query("ST10_rewrites", "with e as (select user_id % 50 as key, event_id, case when event_id % 6 > 0 then (floor(value)::bigint % 3)::varchar end as d from events), l as (select *, lag(d) over (partition by key order by event_id) as b from e) select key, event_id, case when d is null then 'prune' else 'rewrite' end as action from l where d is distinct from b")
def st10(t):
    k = F.col("event_id")
    stream = S.opened(t.spark, f"{t.folder}/events.parquet").select((F.col("user_id") % 50).alias("key"), "event_id", F.when(k % 6 > 0, (F.floor("value").cast("long") % 3).cast("string")).alias("digest"))
    return S.drained(S.rewrites(stream, "key", "event_id", "digest"))
