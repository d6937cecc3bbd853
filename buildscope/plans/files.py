"""Sinks written to files of the shared folder and read again (SNK1-SNK3, SNK5-SNK9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks import text as K
from ..sources import builds as B
from ..streaming import telemetry as S
from .registry import n_rows, query


def written(rows, line, order, eol="\r\n", header=None):
    """The lines of rows in order, as they come back from the files that write_lines leaves."""
    path = S.shared(rows.sparkSession, "sink")
    K.write_lines(rows, line, path, order, eol, header=header)
    return B.lines(rows.sparkSession, path).select("line")


STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::varchar, 3, '0')"


@query("SNK1_csv_file", f"""select {STAMP} || ',' || epoch_us(ts) // 1000 || ',rx,,,,,"' || replace(props, '"', '""') || '"' as line from events union all select 'iso_time,epoch_ms,kind,command,channel,series,value,text'""")
def snk1(t):
    return written(t.events, K.log_csv(F.col("ts").cast("timestamp"), F.lit("rx"), F.col("props")), ["ts", "event_id"], header=K.LOG_HEADER)


@query("SNK2_json_file", "select event_id::bigint as event, event_type as kind, value as value from events")
def snk2(t):
    path = S.shared(t.spark, "sink")
    K.write_lines(t.events, K.json_line(event=F.col("event_id"), kind=F.col("event_type"), value=F.col("value")), path, ["event_id"])
    return t.spark.read.schema("event long, kind string, value double").json(path)


@query("SNK3_log_file", f"select {STAMP} || case event_type when 'click' then ' << ' when 'view' then ' >> ' when 'error' then ' !! ' else ' -- ' end || props as line from events")
def snk3(t):
    d = F.when(F.col("event_type") == "click", "rx").when(F.col("event_type") == "view", "tx").when(F.col("event_type") == "error", "err").otherwise("info")
    return written(t.events, K.log_text(F.col("ts").cast("timestamp"), d, F.col("props")), ["ts", "event_id"])


@query("SNK5_quoted_file", "select p_name as name, p_size::varchar as size from part")
def snk5(t):
    path = S.shared(t.spark, "sink")
    K.write_lines(t.part, K.quoted_line(F.col("p_name"), F.col("p_size")), path, ["p_partkey"])
    return t.spark.read.schema("name string, size string").csv(path)


@query("SNK6_index_file", "select o_custkey as customer, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by 1")
def snk6(t):
    keys = t.orders.groupBy("o_custkey").agg(n_rows().alias("n"), F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    path = S.shared(t.spark, "sink")
    K.write_lines(keys, K.json_line(c=F.col("o_custkey"), n=F.col("n"), o=F.col("o")), path, ["o_custkey"], eol="\n")
    back = t.spark.read.schema("c long, n long, o array<long>").json(path)
    return back.select(F.col("c").alias("customer"), "n", F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x).alias("keys"))


EDGES = "select n_name, r_name from nation join region on n_regionkey = r_regionkey"


@query("SNK7_dot_file", f"""select unnest(['digraph CallGraph {{', '  rankdir=LR;', '}}']) as line union all select '  ' || replace(n_name, '#', '_') || ' [label="' || n_name || '"];' from nation union all select '  ' || replace(n_name, '#', '_') || ' -> ' || replace(r_name, ' ', '_') || ';' from ({EDGES})""")
def snk7(t):
    edges = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    rows = K.dot_lines(t.nation, edges, "n_name", "n_name", "n_name", "r_name")
    return written(rows, F.col("line"), ["part", "line"], eol="\n")


@query("SNK8_block_file", "with b as (select p_partkey // 25 f, p_partkey b from part) select 'f' || f as file, count(*) as blocks, string_agg('i' || b, ',' order by b) as firsts from b group by 1")
def snk8(t):
    key = F.col("p_partkey")
    rows = t.part.select(F.concat(F.lit("f"), F.floor(key / 25)).alias("file"), key.alias("block_no"), F.lit("SEND").alias("keyword"), F.array(F.concat(F.lit("i"), key), F.lit("0A")).alias("lines"))
    path = S.shared(t.spark, "sink")
    K.write_whole(B.block_text(rows), path)
    got = B.blocks(B.lines(t.spark, path).withColumn("file", B.name_in(F.col("file"))))
    return got.groupBy("file").agg(n_rows().alias("blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", F.col("lines")[0].alias("l")))), lambda x: x["l"]), ",").alias("firsts"))


@query("SNK9_store_files", "select s_suppkey::varchar as key, 'N' || s_nationkey as symbol, case when s_suppkey % 3 = 0 then 'fixed ' || s_suppkey end as correction, 'About ' || s_name as body from supplier")
def snk9(t):
    """Notes with a head of fields, a file each; a correction by hand outlives a new write."""
    k = F.col("s_suppkey")
    first = t.supplier.where("s_suppkey % 3 = 0").select(k.cast("string").alias("key"), F.lit("old").alias("symbol"), F.lit("old").alias("body"), F.concat(F.lit("fixed "), k).alias("correction"))
    at = S.shared(t.spark, "sink")
    K.write_whole(K.notes(first, "key", ["symbol"], ["correction"], "body"), f"{at}/1")
    held = B.front_matter(B.whole(t.spark, f"{at}/1"))
    field = lambda name: F.try_element_at(F.col("fields"), F.lit(name))
    store = held.select(B.name_in(F.col("file")).alias("key"), field("symbol").alias("symbol"), "body", field("correction").alias("correction"))
    new = t.supplier.select(k.cast("string").alias("key"), F.concat(F.lit("N"), "s_nationkey").alias("symbol"), F.concat(F.lit("About "), "s_name").alias("body"))
    K.write_whole(K.notes(K.upserted(store, new, "key", ["symbol", "body"], ["correction"]), "key", ["symbol"], ["correction"], "body"), f"{at}/2")
    back = B.front_matter(B.whole(t.spark, f"{at}/2"))
    return back.select(B.name_in(F.col("file")).alias("key"), field("symbol").alias("symbol"), field("correction").alias("correction"), "body")
