"""One query for each operator, on the driver's tables, beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import core as O
from ..operators import graph as G
from ..operators import located as L
from ..operators.longest import longest
from ..streaming import telemetry
from .graphs import HEAP, heap
from .registry import ORACLE, QUERIES, as_double, money, n_rows, query


@query("A1_conditional_rollup", """
select l_partkey, sum(case when l_returnflag in ('A','R') then l_quantity::decimal(18,4) else 0 end)::double flash,
 sum(case when l_returnflag in ('N','R') then l_quantity::decimal(18,4) else 0 end)::double ram, sum(l_quantity::decimal(18,4))::double total
from lineitem group by 1 order by flash + ram desc, l_partkey limit 500""")
def a1(t):
    q = money("l_quantity")
    out = t.lineitem.groupBy("l_partkey").agg(as_double(F.sum(F.when(F.col("l_returnflag").isin("A", "R"), q).otherwise(0))).alias("flash"), as_double(F.sum(F.when(F.col("l_returnflag").isin("N", "R"), q).otherwise(0))).alias("ram"), as_double(F.sum(q)).alias("total"))
    return out.orderBy((F.col("flash") + F.col("ram")).desc(), "l_partkey").limit(500)  # a ranking of 500 is the operator


@query("A2_ledger_topk", """
select p_type, n, size, rank, p_partkey, p_retailprice from (
 select p_type, count(*) over (partition by p_type) n, (sum(p_retailprice::decimal(18,4)) over (partition by p_type))::double size,
 row_number() over (partition by p_type order by p_retailprice desc, p_partkey) rank, p_partkey, p_retailprice from part) where rank <= 8""")
def a2(t):
    sums = t.part.groupBy("p_type").agg(n_rows().alias("n"), as_double(F.sum(money("p_retailprice"))).alias("size"))
    top = O.top_k(t.part.select("p_type", "p_partkey", "p_retailprice"), ["p_type"], [F.desc("p_retailprice"), "p_partkey"], 8)
    return sums.join(top, "p_type").select("p_type", "n", "size", "rank", "p_partkey", "p_retailprice")


@query("A3_reconcile_gap", """
with c as (select l_orderkey k, sum(l_extendedprice::decimal(18,4)) claimed from lineitem group by 1),
j as (select o_orderstatus, o_totalprice::decimal(18,4) total, coalesce(claimed, 0) claimed from orders left join c on o_orderkey = k)
select o_orderstatus, sum(total)::double total, sum(claimed)::double claimed, sum(greatest(0, total - claimed))::double gap,
 case when sum(total) = 0 then 0 else round((sum(total) - sum(greatest(0, total - claimed)))::double / sum(total)::double, 9) end coverage from j group by 1""")
def a3(t):
    claimed = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice")).alias("claimed"))
    j = t.orders.select("o_orderkey", "o_orderstatus", money("o_totalprice").alias("total")).join(claimed, "o_orderkey", "left").withColumn("claimed", F.coalesce("claimed", F.lit(0)))
    j = j.withColumn("gap", O.waste(F.col("total"), F.col("claimed")))
    out = j.groupBy("o_orderstatus").agg(*(as_double(F.sum(c)).alias(c) for c in ("total", "claimed", "gap")))
    return out.withColumn("coverage", F.coalesce(F.round(F.try_divide(F.col("total") - F.col("gap"), F.col("total")), 9), F.lit(0.0)))


@query("A4_owner_rollup", """
select o_custkey, sum(o_totalprice::decimal(18,4))::double total, string_agg(distinct o_orderstatus, '+' order by o_orderstatus) kinds
from orders where o_custkey is not null group by 1""")
def a4(t):
    return t.orders.where("o_custkey is not null").groupBy("o_custkey").agg(as_double(F.sum(money("o_totalprice"))).alias("total"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "+").alias("kinds"))


PREFIXES = (("STANDARD", "code"), ("SMALL", "data"), ("MEDIUM", "data"), ("PROMO", "debug"))


@query("A5_prefix_rollup", """
select case when starts_with(p_type,'STANDARD') then 'code' when starts_with(p_type,'SMALL') then 'data' when starts_with(p_type,'MEDIUM') then 'data'
 when starts_with(p_type,'PROMO') then 'debug' else 'other' end class, count(*) n, sum(p_size)::bigint size from part group by 1""")
def a5(t):
    return t.part.groupBy(S.first_prefix(F.col("p_type"), PREFIXES, "other").alias("class")).agg(n_rows().alias("n"), F.sum("p_size").alias("size"))


@query("A6_hotspots", "select event_type, sum(coalesce(value,0)::decimal(18,4))::double total, count(*) n from events group by 1")
def a6(t):
    return t.events.groupBy("event_type").agg(as_double(F.sum(money(F.coalesce("value", F.lit(0.0))))).alias("total"), n_rows().alias("n"))


@query("A7_duplicates", """
select p_name, count(*) n, count(distinct p_brand) brands from part group by 1 having count(*) > 1 order by n desc, p_name limit 30""")
def a7(t):
    out = t.part.groupBy("p_name").agg(n_rows().alias("n"), F.countDistinct("p_brand").alias("brands")).where("n > 1")
    return out.orderBy(F.desc("n"), "p_name").limit(30)


@query("A8_families", """
with f as (select split_part(p_name, ' ', 1) family, p_partkey, p_size, row_number() over (partition by split_part(p_name,' ',1) order by p_size desc, p_partkey) r from part)
select family, count(*) n, sum(p_size)::bigint total, string_agg(case when r <= 20 then p_partkey::varchar end, ',' order by r) parts from f group by 1 order by total desc, family limit 50""")
def a8(t):
    rows = t.part.select(F.substring_index("p_name", " ", 1).alias("family"), "p_partkey", "p_size")
    top = O.top_k(rows, ["family"], [F.desc("p_size"), "p_partkey"], 20).groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p_partkey"))), lambda x: x["p_partkey"].cast("string")), ",").alias("parts"))
    return rows.groupBy("family").agg(n_rows().alias("n"), F.sum("p_size").alias("total")).join(top, "family").orderBy(F.desc("total"), "family").limit(50)


RANKS = {"error": 0, "purchase": 1, "signup": 2}


@query("A9_severity_summary", """
select event_type, case event_type when 'error' then 0 when 'purchase' then 1 when 'signup' then 2 else 3 end severity, count(*) n,
 min_by(event_id, ts::varchar || lpad(event_id::varchar, 20, '0')) first_id from events group by 1""")
def a9(t):
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    return t.events.groupBy("event_type").agg(F.first(rank).alias("severity"), n_rows().alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))


@query("A12_zero_filled_counts", """
with s as (select distinct o_orderstatus from orders), g as (select r_name, o_orderstatus from region, s),
o as (select r_name, o_orderstatus, count(*) n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2)
select g.r_name, g.o_orderstatus, coalesce(n, 0) n from g left join o using (r_name, o_orderstatus)""")
def a12(t):
    kinds = t.region.select("r_name", "r_regionkey").crossJoin(t.orders.select("o_orderstatus").distinct())  # 5 regions by 3 states
    per = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey").join(t.nation, "n_nationkey")
    n = per.groupBy(F.col("n_regionkey").alias("r_regionkey"), "o_orderstatus").agg(n_rows().alias("n"))
    return kinds.join(n, ["r_regionkey", "o_orderstatus"], "left").select("r_name", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n"))


STATS = """select user_id, event_type, count(*) n, min(value) min_value, max(value) max_value, arg_max(value, (ts, event_id)) last_value,
 case when max(ts) = min(ts) then null else round((count(*) - 1) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts)))::double, 9) end rate from events group by 1, 2"""


@query("A14_series_stats", STATS)
def a14(t):
    return telemetry.series_stats(t.events)


@query("ST4_stream_stats", STATS)
def st4(t):
    stream = telemetry.opened(t.spark, f"{t.folder}/events.parquet")
    return telemetry.with_rate(telemetry.drained(telemetry.series_state(stream), ["user_id", "event_type"]))


NATIONS = """with e as (select c.c_nationkey src, s.s_nationkey dst, l_partkey from lineitem join orders on l_orderkey = o_orderkey
 join customer c on o_custkey = c_custkey join supplier s on l_suppkey = s_suppkey) """


def trade(t) -> DataFrame:
    """Edges (src, dst, l_partkey) from customers' to suppliers' nations."""
    orders = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src")), "o_custkey")
    own = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"), "l_partkey")
    return own.join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("dst")), "s_suppkey").join(orders, "o_orderkey").select("src", "dst", "l_partkey")


@query("A15_edge_agg", NATIONS + "select src, dst, count(*) n, count(distinct l_partkey) parts from e group by 1, 2")
def a15(t):
    return trade(t).groupBy("src", "dst").agg(n_rows().alias("n"), F.countDistinct("l_partkey").alias("parts"))


@query("A16_cross_group", NATIONS + "select n_regionkey region, count(*) n from e join nation on src = n_nationkey where n_regionkey <> (select n2.n_regionkey from nation n2 where n2.n_nationkey = dst) group by 1")
def a16(t):
    a, b = (t.nation.select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias(r)) for k, r in (("src", "region"), ("dst", "other")))
    return trade(t).groupBy("src", "dst").agg(n_rows().alias("k")).join(a, "src").join(b, "dst").where("region <> other").groupBy("region").agg(F.sum("k").alias("n"))


@query("A17_degree", NATIONS + "select node, count(distinct other) degree from (select src node, dst other from e union all select dst, src from e) where node <> other group by 1")
def a17(t):
    return G.both_ways(trade(t).select("src", "dst").distinct()).where("src <> dst").groupBy(F.col("src").alias("node")).agg(n_rows().alias("degree"))


@query("A18_fanout", "select l_orderkey, count(distinct l_suppkey) fan from lineitem group by 1 having count(distinct l_suppkey) >= 3")
def a18(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("fan")).where("fan >= 3")


@query("A19_edge_promote", """
select o_custkey, arg_max(o_orderstatus, case o_orderstatus when 'P' then 2 when 'O' then 1 else 0 end) kind, bool_or(o_totalprice > 300000) confirmed, count(*) n from orders group by 1""")
def a19(t):
    rank = F.when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderstatus", rank).alias("kind"), F.bool_or(F.col("o_totalprice") > 300000).alias("confirmed"), n_rows().alias("n"))


@query("A21_merkle", "select n_regionkey, left(sha256(string_agg(n_name || ':' || n_nationkey, '|' order by n_name)), 16) fingerprint from nation group by 1")
def a21(t):
    parts = F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey")))
    return t.nation.groupBy("n_regionkey").agg(F.substring(F.sha2(F.array_join(F.transform(parts, lambda x: F.concat(x["n_name"], F.lit(":"), x["n_nationkey"])), "|"), 256), 1, 16).alias("fingerprint"))


@query("A22_conditional_sums", "select sum(case when l_linestatus='F' then l_quantity::decimal(18,4) end)::double zeroed, sum(case when l_returnflag='R' then l_quantity::decimal(18,4) end)::double copied from lineitem")
def a22(t):
    q = money("l_quantity")
    return t.lineitem.agg(as_double(F.sum(F.when(F.col("l_linestatus") == "F", q))).alias("zeroed"), as_double(F.sum(F.when(F.col("l_returnflag") == "R", q))).alias("copied"))


@query("A23_collapse", """
with k as (select event_type, user_id, min((ts, event_id)) first from events group by 1, 2),
r as (select event_type, user_id, row_number() over (partition by event_type order by first) r from k)
select e.event_type, e.n, string_agg(r.user_id::varchar, ',' order by r.r) places from r join (select event_type, count(*) n from events group by 1) e using (event_type) where r.r <= 8 group by 1, 2""")
def a23(t):
    first = t.events.groupBy("event_type", "user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    top = O.top_k(first, ["event_type"], ["first"], 8).groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "user_id"))), lambda x: x["user_id"].cast("string")), ",").alias("places"))
    return t.events.groupBy("event_type").agg(n_rows().alias("n")).join(top, "event_type")


@query("A26_distinct_menu", "select distinct p_brand from part where p_brand <> ''")
def a26(t):
    return t.part.where("p_brand <> ''").select("p_brand").distinct()


@query("FIL1_optional_filters", "select c_custkey, c_name, c_mktsegment from customer where contains(lower(c_name), '00') and c_mktsegment = 'BUILDING'")
def fil1(t):
    return t.customer.where(O.optional(O.contains("c_name", "00"), F.col("c_mktsegment") == "BUILDING", O.contains("c_mktsegment", ""))).select("c_custkey", "c_name", "c_mktsegment")


@query("FIL2_either_contains", "select p_partkey from part where (contains(lower(p_name),'red') or contains(lower(p_brand),'3')) and contains(p_type,'MALL')")
def fil2(t):
    return t.part.where((O.contains("p_name", "red") | O.contains("p_brand", "3")) & F.col("p_type").contains("MALL")).select("p_partkey")


@query("FIL6_induced_subgraph", NATIONS + "select distinct src, dst from e where src in (select n_nationkey from nation where n_regionkey <= 1) and dst in (select n_nationkey from nation where n_regionkey <= 1)")
def fil6(t):
    return O.induced(trade(t).select("src", "dst").distinct(), t.nation.where("n_regionkey <= 1"), "src", "dst", "n_nationkey")


@query("FIL9_keyword_list", "select p_partkey, p_size from part where (contains(lower(p_name),'blue') or contains(lower(p_name),'green')) and p_size >= 4")
def fil9(t):
    words = F.array(F.lit("blue"), F.lit("green"))
    return t.part.where(F.exists(words, lambda k: F.contains(F.lower("p_name"), k)) & (F.col("p_size") >= 4)).select("p_partkey", "p_size")


@query("FIL10_alive_at", """
select o_orderkey from orders left join (select l_orderkey, max(l_shipdate) e from lineitem group by 1) on l_orderkey = o_orderkey
where o_orderdate <= timestamp '1997-01-01' and (e is null or timestamp '1997-01-01' <= e)""")
def fil10(t):
    ends = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("e"))
    at = F.lit("1997-01-01").cast("timestamp")
    return t.orders.where(F.col("o_orderdate") <= at).join(ends, "o_orderkey", "left").where(F.col("e").isNull() | (at <= F.col("e"))).select("o_orderkey")


BANDS = "b as (select p_partkey id, p_size * 1000.0 lo, p_size * 1000.0 + 500.0 * (1 + p_partkey % 7) hi, 500.0 * (1 + p_partkey % 7) size from part), x as (select o_orderkey, o_totalprice from orders) "


def bands(t):
    """Intervals of parts and the orders to place; of parts with one interval the least id stands for all, as both orders take it first."""
    size = F.lit(500.0) * (1 + F.col("p_partkey") % 7)
    b = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") * F.lit(1000.0)).alias("lo"), (F.col("p_size") * F.lit(1000.0) + size).alias("hi"), size.alias("size"))
    return b.groupBy("lo", "hi", "size").agg(F.min("id").alias("id")), t.orders.select("o_orderkey", "o_totalprice")


@query("J2_containment_smallest", "with " + BANDS + "select o_orderkey, id from (select o_orderkey, id, row_number() over (partition by o_orderkey order by size, id) r from x join b on o_totalprice >= lo and o_totalprice < hi) where r = 1")
def j2(t):
    b, x = bands(t)
    return O.dedupe_first(O.range_join(x, b, "o_totalprice", "lo", "hi", 2000.0), ["o_orderkey"], ["size", "id"]).select("o_orderkey", "id")


@query("J3_containment_first", "with " + BANDS + ", m as (select o_orderkey k, arg_min(id, (lo, hi, id)) id from x join b on o_totalprice >= lo and o_totalprice < hi group by 1) select o_orderkey, id from x left join m on k = o_orderkey")
def j3(t):
    b, x = bands(t)
    hit = O.range_join(x, b, "o_totalprice", "lo", "hi", 2000.0).groupBy("o_orderkey").agg(F.min_by("id", F.struct("lo", "hi", "id")).alias("id"))
    return x.select("o_orderkey").join(hit, "o_orderkey", "left")


@query("J4_asof_backward", """
with s as (select user_id, ts, max(event_id) id from events where event_type = 'signup' group by 1, 2)
select e.event_id, s.id as signup_id from events e asof left join s on e.user_id = s.user_id and e.ts >= s.ts""")
def j4(t):
    e = t.events.select("event_id", "user_id", "ts")
    s = t.events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("id"))
    return O.asof(e, s, ["user_id"], "ts", "id", ["id"]).select("event_id", F.col("asof_id").alias("signup_id"))


@query("J8_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def j8(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("J9_waterfall", """
with n as (select c_custkey, c_nationkey, n_regionkey from customer join nation on c_nationkey = n_nationkey), s as (select s_suppkey, s_nationkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey),
c as (select c_custkey, s_suppkey, 1 priority from n join s on c_nationkey = s_nationkey union all select c_custkey, s_suppkey, 2 from n join s on n.n_regionkey = s.n_regionkey),
r as (select *, rank() over (partition by c_custkey order by priority) r from c) select c_custkey, s_suppkey, priority from (select *, count(*) over (partition by c_custkey) n from r where r = 1) where n <= 12""")
def j9(t):
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(t.nation.select("n_nationkey", "n_regionkey"), "n_nationkey")
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(t.nation.select("n_nationkey", "n_regionkey"), "n_nationkey")
    return L.capped_tiers(c, s, "c_custkey", "s_suppkey", ["n_nationkey", "n_regionkey"], 12).drop("kind")


@query("J11_prefer_human", "select doc_id, coalesce(quality, case when n_chars > 100 then 1 else 0 end) quality, quality is not null corrected from documents left join labels using (doc_id)")
def j11(t):
    return t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.when(F.col("n_chars") > 100, 1).otherwise(0)).alias("quality"), F.col("quality").isNotNull().alias("corrected"))


@query("J13_two_plane", """select count(*) filter (where d.doc_id is not null and l.doc_id is not null) confirmed, count(*) filter (where l.doc_id is null) predicted_only,
 count(*) filter (where d.doc_id is null) observed_only from documents d full join labels l on d.doc_id = l.doc_id""")
def j13(t):
    d, l = t.documents.select("doc_id", F.lit(1).alias("a")), t.labels.select("doc_id", F.lit(1).alias("b"))
    return d.join(l, "doc_id", "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("confirmed"), F.count_if(F.col("b").isNull()).alias("predicted_only"), F.count_if(F.col("a").isNull()).alias("observed_only"))


@query("J18_region_usage", "select r_name, sum(coalesce(c_acctbal,0)::decimal(18,4))::double used from region left join nation on r_regionkey = n_regionkey left join customer on c_nationkey = n_nationkey group by 1")
def j18(t):
    own = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum(money("c_acctbal")).alias("used"))
    per = t.nation.join(own, "n_nationkey", "left").select(F.col("n_regionkey").alias("r_regionkey"), "used")
    return t.region.join(per, "r_regionkey", "left").groupBy("r_name").agg(as_double(F.coalesce(F.sum("used"), F.lit(0))).alias("used"))


MATCHERS = (("digits", "[0-9]{4}"), ("mail", "[a-z0-9.]+@[a-z0-9.]+"), ("shout", "[A-Z]{6}"))


@query("J19_matcher_cross", "select m, count(*) n from documents, (values ('digits','[0-9]{4}'),('mail','[a-z0-9.]+@[a-z0-9.]+'),('shout','[A-Z]{6}')) v(m, p) where regexp_matches(text, p) group by 1")
def j19(t):
    hit = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(m)) for m, p in MATCHERS)))
    return t.documents.select(F.explode(hit).alias("m")).groupBy("m").agg(n_rows().alias("n"))


@query("W1_ring", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 5")
def w1(t):
    return O.ring(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


@query("W2_trend", """with f as (select user_id, arg_min(value, (ts, event_id)) a, arg_max(value, (ts, event_id)) b from events group by 1)
select user_id, round(b - a, 6) delta, case when abs(b - a) < 0.5 then 'flat' when b > a then 'up' else 'down' end arrow from f""")
def w2(t):
    key = F.struct("ts", "event_id")
    d = F.col("b") - F.col("a")
    return t.events.groupBy("user_id").agg(F.min_by("value", key).alias("a"), F.max_by("value", key).alias("b")).select("user_id", F.round(d, 6).alias("delta"), F.when(F.abs(d) < 0.5, "flat").when(d > 0, "up").otherwise("down").alias("arrow"))


@query("W3_growth_alarm", """select event_id, n = 30 and first > 0 and (value - first) / first > 0.15 alarm from (select event_id, value, count(*) over w n, first_value(value) over w first
 from events window w as (partition by user_id order by ts, event_id rows between 29 preceding and current row))""")
def w3(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-29, 0)
    out = t.events.select("event_id", "value", n_rows().over(w).alias("n"), F.first("value").over(w).alias("first"))
    return out.select("event_id", ((F.col("n") == 30) & (F.col("first") > 0) & F.coalesce(F.try_divide(F.col("value") - F.col("first"), F.col("first")) > 0.15, F.lit(False))).alias("alarm"))


@query("W4_reverse_rank", "select l_orderkey, l_linenumber, count(*) over (partition by l_orderkey) - row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as rank from lineitem")
def w4(t):
    w = Window.partitionBy("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", (n_rows().over(w) - F.row_number().over(w.orderBy("l_linenumber", "l_partkey"))).alias("rank"))


@query("W5_gap_segments", "select event_id, (epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) gap_us from events")
def w5(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("gap_us"))


@query("T1_stable_topk", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 3000")
def t1(t):
    return t.part.select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(3000)


@query("T4_topk_group", "select p_brand, p_partkey, rank from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) rank from part) where rank <= 3")
def t4(t):
    return O.top_k(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 3).drop("p_retailprice")


@query("U2_dedupe_first", "select user_id, event_type, arg_min(event_id, (ts, event_id)) event_id from events group by 1, 2")
def u2(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("U4_intersect", "select c_nationkey k from customer intersect select s_nationkey from supplier")
def u4(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("U6_except", "select l_orderkey from lineitem where l_returnflag = 'R' except select l_orderkey from lineitem where l_returnflag = 'A'")
def u6(t):
    return t.lineitem.where("l_returnflag = 'R'").select("l_orderkey").subtract(t.lineitem.where("l_returnflag = 'A'").select("l_orderkey"))


@query("U5_snapshot_diff", """
with r as (select l_partkey, year(l_shipdate) y, sum(l_quantity::decimal(18,4)) v from lineitem where year(l_shipdate) in (1995, 1996) group by 1, 2), a as (select l_partkey, v from r where y = 1995), b as (select l_partkey, v from r where y = 1996)
select a.l_partkey, a.v::double as before, coalesce(b.v, 0)::double as after, (coalesce(b.v, 0) - a.v)::double delta from a left join b using (l_partkey) where b.v is null or a.v <> b.v""")
def u5(t):
    r = t.lineitem.where(F.year("l_shipdate").isin(1995, 1996)).groupBy("l_partkey", F.year("l_shipdate").alias("y")).agg(F.sum(money("l_quantity")).alias("v"))
    out = O.snapshot_diff(r.where("y = 1995"), r.where("y = 1996"), "l_partkey", "v")
    return out.select("l_partkey", *(F.col(c).cast("double").alias(c) for c in ("before", "after", "delta")))


@query("F1_banding", "select l_orderkey, l_linenumber, (l_quantity > 5)::bigint + (l_quantity > 10)::bigint + (l_quantity > 20)::bigint + (l_quantity > 40)::bigint band from lineitem")
def f1(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.banding(F.col("l_quantity"), (5, 10, 20, 40)).alias("band"))


@query("F2_threshold", "select case when l_quantity <= 15 then 'none' when l_quantity <= 20 then 'info' when l_quantity <= 40 then 'warn' else 'error' end severity, count(*) n from lineitem group by 1")
def f2(t):
    return t.lineitem.groupBy(S.severity(F.col("l_quantity"), 20).alias("severity")).agg(n_rows().alias("n"))


@query("F13_stable_id", "select p_partkey, 'lens:' || left(sha1(p_name || '|' || p_brand), 16) id from part")
def f13(t):
    return t.part.select("p_partkey", S.stable_id(F.col("p_name"), F.col("p_brand")).alias("id"))


@query("F15_path_tail", "with p as (select page_id, url, list_filter(string_split(replace(url, '\\\\', '/'), '/'), lambda x: x <> '') l from pages) select page_id, case when len(l) > 2 then l[-2] || '/' || l[-1] else url end tail from p")
def f15(t):
    return t.pages.select("page_id", S.path_tail(F.col("url")).alias("tail"))


@query("F17_next_review", "select o_orderkey, case o_orderkey % 4 when 0 then (o_orderdate::date + 7)::date when 1 then (o_orderdate::date + 30)::date when 2 then (o_orderdate::date + 90)::date end review from orders")
def f17(t):
    return t.orders.select("o_orderkey", S.next_review(F.to_date("o_orderdate"), (F.col("o_orderkey") % 4).cast("int")).alias("review"))


@query("F26_template_extract", "select event_id, try_cast(nullif(regexp_extract(props, '\"k\":\\s*(-?[0-9.]+)', 1), '') as double) k from events")
def f26(t):
    return t.events.select("event_id", F.expr("try_cast(nullif(regexp_extract(props, '\"k\":\\\\s*(-?[0-9.]+)', 1), '') as double)").alias("k"))


@query("G2_khop", HEAP + "u as (select src, dst from e union select dst, src from e), w as (select 5::bigint node, 0 depth union select dst, depth + 1 from w join u on node = src where depth < 3) select node, min(depth)::bigint depth from w group by 1")
def g2(t):
    return G.hops(G.both_ways(heap(t)), t.spark.createDataFrame([(5,)], "node long"), 3)


@query("G3_depth", HEAP + "w as (select 1::bigint node, 0 depth union all select src, depth + 1 from w join e on node = dst) select node, min(depth)::bigint depth from w group by 1")
def g3(t):
    return G.hops(heap(t).select(F.col("dst").alias("src"), F.col("src").alias("dst")), t.spark.createDataFrame([(1,)], "node long"))


@query("G8_subtree", HEAP + "w as (select 3::bigint node union all select src from w join e on node = dst) select node from w")
def g8(t):
    return G.hops(heap(t).select(F.col("dst").alias("src"), F.col("src").alias("dst")), t.spark.createDataFrame([(3,)], "node long")).select("node")


@query("G7_longest_path", HEAP + "w as (select p_partkey node, p_partkey pos, p_size::bigint total from part union all select node, dst, total + p_size from w join e on pos = src join part on p_partkey = dst) select node, max(total) worst from w group by 1")
def g7(t):
    return longest(heap(t), t.part.select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("weight"))).select("node", "worst")


@query("G13_alias_chain", HEAP + "w as (select src node, dst target, 1::bigint hops from e union all select node, dst, hops + 1 from w join e on target = src where hops < 8) select node, arg_max(target, hops) target, max(hops) hops from w group by 1")
def g13(t):
    return G.chase(heap(t).withColumnsRenamed({"src": "node", "dst": "next"}))


from . import binary, code, constructs, debug, dispatch, files, flow, graphs, machines, places, rollups, rules, source, summaries, texts  # noqa: E402, F401  they register their queries

__all__ = ["ORACLE", "QUERIES"]
