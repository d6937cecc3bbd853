"""Aggregations, windows, rankings, set operations and summaries (A, W, T, U, M) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import core as O
from .registry import as_double, money, n_rows, pick, query, sql_pick
from .rules import CALLED, HANDLERS, MANGLED, SECTIONS

RECORDS = """r as (select p_partkey, p_brand, p_size::bigint * 4 size, greatest(0, (p_partkey % 13) * 2 - 3) tail, case when p_partkey % 4 = 0 then null else p_partkey % 9 end internal, p_partkey % 5 = 0 poly from part)"""


def records(t):
    k = F.col("p_partkey")
    return t.part.select("p_partkey", "p_brand", (F.col("p_size").cast("long") * 4).alias("size"), F.greatest(F.lit(0), (k % 13) * 2 - 3).alias("tail"), F.when(k % 4 != 0, k % 9).alias("internal"), (k % 5 == 0).alias("poly"))


@query("A10_layout_summary", f"with {RECORDS} select count(*) records, sum(size)::bigint total_size, sum(tail + coalesce(internal, 0))::bigint wasted, count(*) filter (where poly) polymorphic, count(*) filter (where internal is null) uncomputed from r")
def a10(t):
    return records(t).agg(n_rows().alias("records"), F.sum("size").alias("total_size"), F.sum(F.col("tail") + F.coalesce("internal", F.lit(0))).alias("wasted"), F.count_if("poly").alias("polymorphic"), F.count_if(F.col("internal").isNull()).alias("uncomputed"))


RES = tuple(R.CERTAINTY)


@query("A11_flow_summary", f"with e as (select l_orderkey, l_linenumber depth, {sql_pick('l_partkey', RES)} r, {sql_pick('l_suppkey', HANDLERS)} as f from lineitem) select count(*) filter (where r in ('exact','devirtualised','observed')) certain, count(*) filter (where r in ('cha','rta')) bounded, count(*) filter (where r in ('fn_ptr','unresolved')) as unknown, max(depth)::bigint max_depth, count(distinct f) filter (where " + " or ".join(f"regexp_matches(f, '{p}')" for p in (*R.ARM_ISR, *R.ANY_ISR)) + ") isrs from e")
def a11(t):
    e = t.lineitem.select(F.col("l_linenumber").alias("depth"), R.looked_up(pick(F.col("l_partkey"), RES), R.CERTAINTY).alias("c"), pick(F.col("l_suppkey"), HANDLERS).alias("f"))
    return e.agg(*(F.count_if(F.col("c") == c).alias(c) for c in ("certain", "bounded", "unknown")), F.max("depth").cast("long").alias("max_depth"), F.countDistinct(F.when(R.is_isr(F.col("f")), F.col("f"))).alias("isrs"))


@query("A13_isr_summary", f"""with c as (select l_orderkey isr, {sql_pick('l_partkey', CALLED)} as func from lineitem), h as (select isr, func, case when func in ({', '.join(repr(n) for n, (_, s) in R.HAZARDS.items() if s == 'error')}) then 'error'
 when func in ({', '.join(repr(n) for n, (_, s) in R.HAZARDS.items() if s == 'info')}) then 'info' when func in ({', '.join(repr(n) for n, (_, s) in R.HAZARDS.items() if s == 'warn')}) then 'warn'
 when {" or ".join(f"starts_with(func, '{p}')" for p in R.HAZARD_PREFIXES)} then case when not ({" or ".join(f"contains(func, '{p}')" for p in R.ISR_SAFE)}) then 'warn' end end s from c),
i as (select isr, count(*) n, count(*) filter (where s = 'error') e, count(*) filter (where s = 'warn') w, count(s) h from h group by 1)
select count(*) total_isrs, count(*) filter (where h > 0) with_hazards, max(n * 8 + 32) max_total_stack, sum(e)::bigint n_errors, sum(w)::bigint n_warns from i""")
def a13(t):
    calls = t.lineitem.select(F.col("l_orderkey").alias("isr"), R.hazard(pick(F.col("l_partkey"), CALLED)).alias("h"))
    per = calls.groupBy("isr").agg(n_rows().alias("n"), F.collect_list("h.severity").alias("hazards"))  # a few calls a handler
    many = lambda s: F.sum(F.size(F.filter("hazards", lambda x: x == s))).cast("long")
    return per.agg(n_rows().alias("total_isrs"), F.count_if(F.size("hazards") > 0).alias("with_hazards"), F.max(F.col("n") * 8 + 32).alias("max_total_stack"), many("error").alias("n_errors"), many("warn").alias("n_warns"))


@query("A20_dead_by_file", "select p_brand file, count(*) n, 0::bigint size from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 25) group by 1")
def a20(t):
    used = t.lineitem.where("l_quantity > 25").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(used, "p_partkey", "left_anti").groupBy(F.col("p_brand").alias("file")).agg(n_rows().alias("n"), F.lit(0).cast("long").alias("size"))


EH = " or ".join(f"starts_with(name, '{p}')" for p in R.EXCEPTION_SECTIONS)
DYN = ", ".join(f"'{p}'" for p in R.DYNAMIC_SECTIONS)
OVERHEAD = (*R.EXCEPTION_SECTIONS, *R.DYNAMIC_SECTIONS, ".text", ".eh_frame.x")


@query("A24_overhead", f"with s as (select {sql_pick('p_partkey', OVERHEAD)} as name, p_size::bigint * 8 size from part) select coalesce(sum(size) filter (where {EH}), 0)::bigint exception_bytes, coalesce(sum(size) filter (where name in ({DYN})), 0)::bigint dynamic_bytes, coalesce(sum(greatest(0, (size - 16) // 16)) filter (where name = '.plt'), 0)::bigint plt_entries, bool_or(name in ('.plt', '.dynamic')) is_dynamic from s")
def a24(t):
    s = t.part.select(pick(F.col("p_partkey"), OVERHEAD).alias("name"), (F.col("p_size").cast("long") * 8).alias("size"))
    of = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0)).cast("long")
    name, size = F.col("name"), F.col("size")
    return s.agg(of(R.any_prefix(name, R.EXCEPTION_SECTIONS), size).alias("exception_bytes"), of(name.isin(*R.DYNAMIC_SECTIONS), size).alias("dynamic_bytes"), of(name == ".plt", F.greatest(F.lit(0), F.floor((size - 16) / 16))).alias("plt_entries"), F.bool_or(name.isin(".plt", ".dynamic")).alias("is_dynamic"))


@query("A25_totals_top50", "with s as (select p_partkey, p_type in ('SMALL', 'LARGE', 'PROMO') fn, p_size, p_retailprice from part), r as (select *, row_number() over (partition by fn order by p_size desc, p_partkey) r, count(*) over (partition by fn) n, (sum(p_size) over (partition by fn))::bigint total from s) select fn as is_function, p_partkey, p_size, r as rank, n, total from r where r <= 50")
def a25(t):
    s = t.part.select("p_partkey", "p_size", F.col("p_type").isin("SMALL", "LARGE", "PROMO").alias("is_function"))
    sums = s.groupBy("is_function").agg(n_rows().alias("n"), F.sum("p_size").alias("total"))
    return O.top_k(s, ["is_function"], [F.desc("p_size"), "p_partkey"], 50).join(sums, "is_function")


@query("W7_lookback", "select event_id, coalesce(max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding), 0) = 1 as recent from events")
def w7(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", O.seen_before(F.col("event_type") == "error", w, 5).alias("recent"))


@query("W9_renumber", "select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as position from lineitem")
def w9(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w) - 1).cast("long").alias("position"))


@query("W10_context_window", "with r as (select event_id, user_id, event_type, row_number() over (partition by user_id order by ts, event_id) n from events), g as (select user_id, n from r where event_type = 'error') select distinct r.event_id from r join g on r.user_id = g.user_id and r.n between g.n - 3 and g.n + 3")
def w10(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("near", O.near(F.col("event_type") == "error", w, 3)).where("near").select("event_id")


@query("T2_worst_paths", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def t2(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("T3_large_symbols", "(select 'ram' kind, p_partkey, p_size from part where p_size > 30 and p_type = 'SMALL' order by p_size desc, p_partkey limit 5) union all (select 'function', p_partkey, p_size from part where p_size > 40 and p_type <> 'SMALL' order by p_size desc, p_partkey limit 5)")
def t3(t):
    top = lambda kind, cond: t.part.where(cond).select(F.lit(kind).alias("kind"), "p_partkey", "p_size").orderBy(F.desc("p_size"), "p_partkey").limit(5)
    return top("ram", "p_size > 30 and p_type = 'SMALL'").unionByName(top("function", "p_size > 40 and p_type <> 'SMALL'"))


@query("T5_waste_ranking", f"with {RECORDS} select p_partkey, tail + coalesce(internal, 0) waste, row_number() over (order by tail + coalesce(internal, 0) desc, p_partkey) as rank from r where tail + coalesce(internal, 0) > 0 order by waste desc, p_partkey limit 200")
def t5(t):
    waste = F.col("tail") + F.coalesce("internal", F.lit(0))
    top = records(t).select("p_partkey", waste.alias("waste")).where("waste > 0").orderBy(F.desc("waste"), "p_partkey").limit(200)  # the report's length
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("waste"), "p_partkey")).cast("long"))


@query("T6_fallback_order", "select o_orderkey, k from (select o_orderkey, coalesce(case when o_orderkey % 3 > 0 then o_totalprice end, o_custkey::double) k from orders) order by k desc, o_orderkey limit 100")
def t6(t):
    key = F.coalesce(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")), F.col("o_custkey").cast("double"))
    return t.orders.select("o_orderkey", key.alias("k")).orderBy(F.desc("k"), "o_orderkey").limit(100)


@query("T7_metric_tiers", "select l_orderkey, l_linenumber, l_quantity, (l_quantity > 5)::bigint + (l_quantity > 10)::bigint + (l_quantity > 20)::bigint + (l_quantity > 40)::bigint tier from lineitem order by l_quantity desc, l_orderkey, l_linenumber, l_partkey limit 500")
def t7(t):
    from ..functions import scalars as S

    return t.lineitem.orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey").limit(500).select("l_orderkey", "l_linenumber", "l_quantity", S.banding(F.col("l_quantity"), (5, 10, 20, 40)).alias("tier"))


EVIDENCE = ("member", "relation", "abstract", "none")


@query("T8_evidence_order", f"select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by case {sql_pick('l_partkey', EVIDENCE)} when 'member' then 0 when 'relation' then 1 when 'abstract' then 3 else 2 end, l_partkey, l_linenumber, l_suppkey) as place from lineitem")
def t8(t):
    evidence = pick(F.col("l_partkey"), EVIDENCE)
    rank = F.when(evidence == "member", 0).when(evidence == "relation", 1).when(evidence == "abstract", 3).otherwise(2)
    w = Window.partitionBy("l_orderkey").orderBy(rank, "l_partkey", "l_linenumber", "l_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("U1_findings", """select 'large_order' as construct, 'warn' as severity, o_orderkey::varchar as name, null::bigint as line from orders where o_totalprice > 450000
 union all select 'late_line', 'info', l_orderkey::varchar, l_linenumber::bigint from lineitem where l_quantity >= 49
 union all select 'error_event', 'error', event_id::varchar, null from events where event_type = 'error' and value > 20""")
def u1(t):
    return O.findings(
        t.orders.where("o_totalprice > 450000").select(F.lit("large_order").alias("construct"), F.lit("warn").alias("severity"), F.col("o_orderkey").cast("string").alias("name")),
        t.lineitem.where("l_quantity >= 49").select(F.lit("late_line").alias("construct"), F.lit("info").alias("severity"), F.col("l_orderkey").cast("string").alias("name"), F.col("l_linenumber").cast("long").alias("line")),
        t.events.where("event_type = 'error' and value > 20").select(F.lit("error_event").alias("construct"), F.lit("error").alias("severity"), F.col("event_id").cast("string").alias("name")),
    )


ALL_HINTS = (*R.ESP32_SECTIONS, ".text", *R.ARM_HINTS, ".data", *R.X86_SECTIONS)
FAMILIES = {"esp32": R.ESP32_SECTIONS, "arm": R.ARM_HINTS, "x86": R.X86_SECTIONS}


@query("U3_target_family", f"with s as (select l_orderkey image, {sql_pick('l_partkey', ALL_HINTS)} as name from lineitem), c as (select image, " + ", ".join(f"count(distinct case when name in ({', '.join(repr(n) for n in names)}) then name end) {k}" for k, names in FAMILIES.items()) + " from s group by 1) select image, case when esp32 > arm and esp32 > x86 then 'esp32' when x86 >= 2 then 'x86-64' else 'arm' end family from c")
def u3(t):
    s = t.lineitem.select(F.col("l_orderkey").alias("image"), pick(F.col("l_partkey"), ALL_HINTS).alias("name"))
    hits = s.groupBy("image").agg(*(F.countDistinct(F.when(F.col("name").isin(*names), F.col("name"))).alias(k) for k, names in FAMILIES.items()))
    return hits.select("image", R.target_family(F.col("esp32"), F.col("arm"), F.col("x86")).alias("family"))


@query("U7_distinct_names", "select o_custkey, string_agg(distinct name, ',' order by name) as names from (select o_custkey, o_orderstatus as name from orders union all select o_custkey, o_orderpriority from orders) group by 1")
def u7(t):
    lists = t.orders.select("o_custkey", F.array("o_orderstatus", "o_orderpriority").alias("l"))
    return lists.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("l")))), ",").alias("names"))


SYMBOLS = f"s as (select p_partkey, {sql_pick('p_partkey', ('rx_buffer', 'counter', 'DmaFrame', 'msgq', 'state', 'spi_tx', 'table'))} as name, p_size::bigint size, p_retailprice::bigint * 7 % 4000 as addr, p_partkey % 3 > 0 as variable from part)"


@query("M1_dma_hazard", f"""with {SYMBOLS}, g as (select * from (values (0, 0, 900, '.data'), (1, 700, 1500, '.bss'), (2, 2000, 2600, '.dtcm_data')) v(i, lo, hi, section))
select p_partkey, arg_min(section, i) as section from s join g on addr >= lo and addr < hi where size >= 4 and variable and ({' or '.join(f"contains(lower(name), '{w}')" for w in R.DMA_WORDS)}) group by 1""")
def m1(t):
    name = pick(F.col("p_partkey"), ("rx_buffer", "counter", "DmaFrame", "msgq", "state", "spi_tx", "table"))
    s = t.part.select("p_partkey", name.alias("name"), F.col("p_size").alias("size"), (F.bround("p_retailprice", 0).cast("long") * 7 % 4000).alias("addr"), (F.col("p_partkey") % 3 > 0).alias("variable"))
    ranges = t.spark.createDataFrame([(0, 0, 900, ".data"), (1, 700, 1500, ".bss"), (2, 2000, 2600, ".dtcm_data")], "i int, lo long, hi long, section string")
    own = s.where((F.col("size") >= 4) & F.col("variable") & R.any_of(F.lower("name"), R.DMA_WORDS))
    return O.range_join(own, ranges, "addr", "lo", "hi", 500.0).groupBy("p_partkey").agg(F.min_by("section", "i").alias("section"))


@query("M2_vtables", """with s as (select p_partkey // 3 c, p_partkey % 3 k, p_size::bigint size, p_partkey from part), c as (select c, max(case when k = 0 then size end) vsize, bool_or(k = 1) has_typeinfo, max(case when k = 2 then 'N' || p_partkey end) tname from s where not (k = 1 and c % 4 = 0) group by 1)
select c class, coalesce(vsize, 0) vtable_size, case when vsize >= 16 then (vsize - 16) // 8 else 0 end slots, has_typeinfo, vsize is not null polymorphic, tname typeinfo_name from c where vsize is not null or has_typeinfo""")
def m2(t):
    k = F.col("p_partkey") % 3
    rows = t.part.select(F.floor(F.col("p_partkey") / 3).alias("class"), k.alias("k"), F.col("p_size").cast("long").alias("size"), F.concat(F.lit("N"), "p_partkey").alias("name")).where(~((F.col("k") == 1) & (F.col("class") % 4 == 0)))
    got = rows.groupBy("class").agg(F.max(F.when(F.col("k") == 0, F.col("size"))).alias("v"), F.bool_or(F.col("k") == 1).alias("has_typeinfo"), F.max(F.when(F.col("k") == 2, F.col("name"))).alias("typeinfo_name"))
    return got.where("v is not null or has_typeinfo").select("class", F.coalesce("v", F.lit(0)).alias("vtable_size"), F.when(F.col("v") >= 16, F.floor((F.col("v") - 16) / 8)).otherwise(0).alias("slots"), "has_typeinfo", F.col("v").isNotNull().alias("polymorphic"), "typeinfo_name")


INITS = ("_GLOBAL__sub_I_main", "plain", "_GLOBAL__I_a", "_GLOBAL__D_b", "other")
ORIGINS = (".init_array", ".text", ".ctors", ".fini_array", ".dtors", ".text", "my__init_array")


@query("M3_init_order", f"with s as (select p_partkey addr, {sql_pick('p_partkey', INITS)} as name, {sql_pick('p_partkey', ORIGINS)} as section from part) select addr, 'init' as phase from s where section in ('.init_array', '.ctors') or contains(section, '__init_array') union all select addr, 'fini' from s where section in ('.fini_array', '.dtors') or contains(section, '__fini_array') union all select addr, 'init' from s where contains(name, '_GLOBAL__I_') or contains(name, '_GLOBAL__sub_I_') union all select addr, 'fini' from s where contains(name, '_GLOBAL__D_')")
def m3(t):
    s = t.part.select(F.col("p_partkey").alias("addr"), pick(F.col("p_partkey"), INITS).alias("name"), pick(F.col("p_partkey"), ORIGINS).alias("section"))
    init, fini = F.lit("init").alias("phase"), F.lit("fini").alias("phase")
    by_section = F.when(F.col("section").isin(".init_array", ".ctors") | F.col("section").contains("__init_array"), "init").when(F.col("section").isin(".fini_array", ".dtors") | F.col("section").contains("__fini_array"), "fini")
    by_name = F.when(R.any_of(F.col("name"), ("_GLOBAL__I_", "_GLOBAL__sub_I_")), "init").when(F.col("name").contains("_GLOBAL__D_"), "fini")
    return s.select("addr", F.explode(F.array_compact(F.array(by_section, by_name))).alias("phase"))  # one scan; a symbol of both counts twice


@query("M5_isr_detect", f"""with s as (select p_partkey addr, {sql_pick('p_partkey', HANDLERS)} || '_' || (p_partkey // 30) as base, {sql_pick('p_partkey', HANDLERS)} as h, p_partkey // 30 as k, {sql_pick('p_partkey // 2', ('.text', '.isr_vector', '.iram0.text', '.vectors2', '.itcm', '.data'))} as section from part),
n as (select addr, case when k % 2 = 0 then h else base end as name, section from s), f as (select addr, name, section, ({' or '.join(f"regexp_matches(name, '{p}')" for p in (*R.ARM_ISR, *R.ANY_ISR))}) by_name, (section in ({', '.join(repr(x) for x in R.VECTOR_SECTIONS)}) or contains(section, 'vector')) in_vector, (section in ('.isr_vector', '.itcm', '.iram0.text') or contains(section, 'iram') or contains(section, 'itcm')) in_fast from n where section <> '.data'),
d as (select *, row_number() over (partition by name order by addr) r from f where by_name or in_vector) select name, addr, concat_ws(' + ', case when by_name then 'naming convention' end, case when in_vector then 'vector section' end, case when in_fast then 'fast memory' end) as reason from d where r = 1""")
def m5(t):
    k = F.col("p_partkey")
    part = F.floor(k / 30)
    name = F.when(part % 2 == 0, pick(k, HANDLERS)).otherwise(F.concat(pick(k, HANDLERS), F.lit("_"), part))
    s = t.part.select(k.alias("addr"), name.alias("name"), pick(F.floor(k / 2), (".text", ".isr_vector", ".iram0.text", ".vectors2", ".itcm", ".data")).alias("section")).where("section <> '.data'")
    return O.isrs(s).select("name", "addr", "reason")


@query("M8_shares", "select p_partkey, p_retailprice, round(p_retailprice / (select sum(p_retailprice::decimal(18,4))::double from part), 12) of_total, round(p_retailprice / (select max(p_retailprice) from part), 12) of_max from part order by p_retailprice desc, p_partkey limit 40")
def m8(t):
    sums = t.part.agg(as_double(F.sum(money("p_retailprice"))).alias("total"), F.max("p_retailprice").alias("most"))
    top = t.part.select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(40)
    return top.crossJoin(F.broadcast(sums)).select("p_partkey", "p_retailprice", F.round(F.col("p_retailprice") / F.col("total"), 12).alias("of_total"), F.round(F.col("p_retailprice") / F.col("most"), 12).alias("of_max"))  # sums is one row


@query("M10_region_bands", "with u as (select n_regionkey r, count(*) * 250 used from customer join nation on c_nationkey = n_nationkey group by 1), b as (select r_regionkey r, (r_regionkey + 1) * 60000 length from region) select b.r region, coalesce(used, 0) used, greatest(0, length - coalesce(used, 0)) free, round(coalesce(used, 0) * 100.0 / length, 6)::double pct, case when coalesce(used, 0) / length > 0.95 then 'error' when coalesce(used, 0) / length > 0.8 then 'warn' end level from b left join u on b.r = u.r")
def m10(t):
    used = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(n_rows().alias("k")).join(t.nation, "n_nationkey").groupBy(F.col("n_regionkey").alias("region")).agg((F.sum("k") * 250).alias("used"))
    b = t.region.select(F.col("r_regionkey").alias("region"), ((F.col("r_regionkey") + 1) * 60000).alias("length")).join(used, "region", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return b.select("region", "used", F.greatest(F.lit(0), F.col("length") - F.col("used")).alias("free"), F.round(F.col("used") * F.lit(100.0) / F.col("length"), 6).alias("pct"), R.pressure(F.col("used"), F.col("length")).alias("level"))


@query("M11_bits", "with b as (select * from (values (0, 'ready'), (3, 'error'), (5, 'full')) v(pos, name)) select event_id, string_agg(name, '|' order by pos) as flags from events join b on (event_id >> pos) & 1 = 1 group by 1")
def m11(t):
    bits = {0: "ready", 3: "error", 5: "full"}
    flags = F.array_compact(F.array(*(F.when(F.shiftright("event_id", p).bitwiseAND(F.lit(1)) == 1, F.lit(n)) for p, n in bits.items())))
    return t.events.select("event_id", F.array_join(flags, "|").alias("flags")).where("flags <> ''")


@query("M18_confirm_edges", "select l_orderkey src, l_suppkey dst, case when l_orderkey = 7 then bool_or(l_quantity > 25) end confirmed from lineitem group by 1, 2")
def m18(t):
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    said = t.lineitem.where("l_orderkey = 7").groupBy(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.bool_or(F.col("l_quantity") > 25).alias("confirmed"))
    return edges.join(said, ["src", "dst"], "left")


@query("M20_grouped_notes", "select event_type, string_agg(event_id::varchar, ',' order by ts, event_id) as members from events where value > 30 group by 1")
def m20(t):
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    return t.events.where("value > 30").groupBy("event_type").agg(F.array_join(F.transform(rows, lambda x: x["event_id"].cast("string")), ",").alias("members"))


@query("M21_journal_order", "select o_orderkey, row_number() over (partition by o_custkey order by case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end, o_orderpriority, o_orderkey) as place from orders")
def m21(t):
    w = Window.partitionBy("o_custkey").orderBy(O.rank_of(F.col("o_orderstatus"), ("P", "O", "F")), "o_orderpriority", "o_orderkey")
    return t.orders.select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("M22_public_internal", "with c as (select l_partkey f, count(*) n, count(*) filter (where l_suppkey % 5 <> l_partkey % 5) outside from lineitem group by 1) select p_partkey, case when coalesce(n - outside, 0) = 0 or outside > 0 then 'public' else 'internal' end kind from part left join c on f = p_partkey")
def m22(t):
    outside = F.count_if(F.col("l_suppkey") % 5 != F.col("l_partkey") % 5)
    calls = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(n_rows().alias("n"), outside.alias("outside"))
    return t.part.select("p_partkey").join(calls, "p_partkey", "left").select("p_partkey", F.when((F.coalesce(F.col("n") - F.col("outside"), F.lit(0)) == 0) | (F.col("outside") > 0), "public").otherwise("internal").alias("kind"))


@query("M24_store_statistics", "select d.lang, count(*) n, count(*) filter (where l.doc_id is null or left(sha256(d.text), 1) <> '0') stale from documents d left join labels l on d.doc_id = l.doc_id group by 1")
def m24(t):
    known = t.labels.select("doc_id", F.lit(True).alias("known"))
    d = t.documents.select("doc_id", "lang", R.content_hash(F.col("text"), 1).alias("h")).join(known, "doc_id", "left")
    return d.groupBy("lang").agg(n_rows().alias("n"), F.count_if(F.col("known").isNull() | (F.col("h") != "0")).alias("stale"))


@query("M28_scrollback", "select event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 2000 and contains(lower(props), '7')")
def m28(t):
    return O.ring(t.events, ["user_id"], ["ts", "event_id"], 2000).where(O.contains("props", "7")).select("event_id")


@query("M29_history", "select event_id, r as place from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 30")
def m29(t):
    return O.top_k(t.events.select("event_id", "user_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 30, "place").select("event_id", "place")


@query("M41_shallow_first", "with d as (select page_id, url, len(list_filter(string_split(url, '/'), lambda x: x <> '')) depth from pages) select page_id, depth::bigint as depth, row_number() over (partition by depth order by url, page_id) as place from d")
def m41(t):
    depth = F.size(F.filter(F.split("url", "/"), lambda x: x != "")).cast("long")
    d = t.pages.select("page_id", "url", depth.alias("depth"))
    return d.select("page_id", "depth", F.row_number().over(Window.partitionBy("depth").orderBy("url", "page_id")).cast("long").alias("place"))


@query("M16_orphans", "with e as (select p_partkey src, p_partkey // 7 dst from part where p_size > 25) select p_partkey from part where p_partkey = 1 or p_partkey in (select src from e union select dst from e)")
def m16(t):
    e = t.part.where("p_size > 25").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 7).cast("long").alias("dst"))
    return O.without_orphans(t.part.select("p_partkey"), e, "p_partkey", root=1)


@query("M15_relevel", "select l_suppkey % 10 a, l_partkey % 10 b, count(*) n, string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar) sites from lineitem group by 1, 2")
def m15(t):
    e = t.lineitem.select((F.col("l_suppkey") % 10).alias("a"), (F.col("l_partkey") % 10).alias("b"), F.col("l_linenumber").cast("string").alias("site"))
    return e.groupBy("a", "b").agg(n_rows().alias("n"), F.array_join(F.array_sort(F.collect_set("site")), ",").alias("sites"))
