"""Graph traversals as loops of frontier joins; lineage is cut by tables in the shared folder.

A round joins the frontier with the edges, both by node, and keeps what is new; it costs
the edges of the frontier. Rounds end when nothing is new, so cycles are harmless.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import asof

#: Rounds after which the frontiers seen so far are stored as one table.
COMPACT = 8


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, which spark.checkpoint.dir names."""
    sc = spark.sparkContext
    if not (base := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="buildscope-")  # a single machine, as in tests
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends, and its true size is known to what comes after."""
    path = shared(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """df stored in the shared folder with its partitions, and the order in them, as they are."""
    shared(df.sparkSession, "")  # sets the folder where it is not set
    return df.checkpoint()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def backwards(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def hops(edges: DataFrame, roots: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows (node, depth): least number of edges from any root, up to limit.

    Each frontier is stored once; what was seen is the union of them, rewritten as one
    table every COMPACT rounds only.
    """
    front = cut(roots.select("node").distinct().withColumn("depth", F.lit(0).cast("long")))
    parts, depth = [front], 0
    while limit is None or depth < limit:
        depth += 1
        new = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, parts)
        front = cut(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if front.isEmpty():
            break
        parts.append(front)
        if len(parts) > COMPACT:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that the roots reach, themselves included."""
    return hops(edges, roots).select("node")


def sliced(edges: DataFrame, roots: DataFrame, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    """G1: (nodes, edges) within depth of the roots, out and then in; nodes have their least depth and whether some were cut.

    If there are more than most, those of least depth stay, by node where depths are equal.
    """
    out, into = hops(edges, roots, depth), hops(backwards(edges), roots, depth)
    every = cut(out.unionByName(into).groupBy("node").agg(F.min("depth").alias("depth")))
    n = every.count()
    kept = every.orderBy("depth", "node").limit(most).withColumn("truncated", F.lit(n > most))
    walked = edges.join(out.where(F.col("depth") < depth).select(F.col("node").alias("src")), "src", "left_semi").unionByName(edges.join(into.where(F.col("depth") < depth).select(F.col("node").alias("dst")), "dst", "left_semi")).distinct()
    ends = kept.select("node")
    inside = walked.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, inside.select("src", "dst")


def shortest_path(edges: DataFrame, root, target) -> DataFrame:
    """Rows (place, node) of a shortest undirected path; of equal ones that with the least nodes, from the target back. Empty if there is none."""
    spark, ways = edges.sparkSession, both_ways(edges)
    kind = edges.schema["src"].dataType.simpleString()
    depths = cut(hops(ways, spark.createDataFrame([(root,)], f"node {kind}")))
    at = depths.where(F.col("node") == F.lit(target)).first()
    path = [] if at is None else [target]
    for d in range(at.depth - 1, -1, -1) if at is not None else ():  # a row a step
        before = ways.where(F.col("dst") == F.lit(path[-1])).select(F.col("src").alias("node")).join(depths.where(F.col("depth") == d), "node")
        path.append(before.agg(F.min("node")).first()[0])
    return spark.createDataFrame(list(enumerate(reversed(path))), f"place long, node {kind}")


def simple_paths(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """Rows (path): simple paths of up to most nodes from the starts. Their number can grow exponentially with most."""
    front = cut(starts.select(F.array("node").alias("path")).distinct())
    parts = [front]
    for _ in range(most - 1):
        step = front.withColumn("src", F.element_at("path", -1)).join(edges.select("src", "dst"), "src").where(~F.array_contains("path", F.col("dst")))
        front = cut(step.select(F.concat("path", F.array("dst")).alias("path")))
        if front.isEmpty():
            break
        parts.append(front)
    return reduce(DataFrame.unionByName, parts)


def cycles(edges: DataFrame, most: int) -> DataFrame:
    """Rows (path): simple cycles of up to most nodes, each once, from its least node on."""
    edges = edges.select("src", "dst").distinct()
    front = cut(edges.select(F.col("src").alias("node")).distinct().select(F.array("node").alias("path")))
    found = []
    for _ in range(most):
        step = cut(front.withColumn("src", F.element_at("path", -1)).join(edges, "src").where(F.col("dst") >= F.col("path")[0]))
        found.append(step.where(F.col("dst") == F.col("path")[0]).select("path"))
        front = step.where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def chase(links: DataFrame, most: int = 8) -> DataFrame:
    """Rows (node, target, hops): where chains of node -> next end, after at most so many steps.

    The first definition of a node (by `ord`, if there is one, else the least next) counts;
    a chain that would come back to a node that it has been at stops before that.
    """
    first = F.min_by("next", "ord") if "ord" in links.columns else F.min("next")
    links = cut(links.where("next is not null").groupBy("node").agg(first.alias("next")))
    now = links.select("node", F.col("node").alias("target"), F.array("node").alias("seen"))
    step = links.select(F.col("node").alias("target"), F.col("next").alias("_to"))
    for _ in range(most):
        moved = now.join(step, "target", "left").withColumn("_to", F.when(~F.array_contains("seen", F.col("_to")), F.col("_to")))
        now = moved.select("node", F.coalesce("_to", "target").alias("target"), F.when(F.col("_to").isNull(), F.col("seen")).otherwise(F.concat("seen", F.array("_to"))).alias("seen"))
    return now.select("node", "target", (F.size("seen") - 1).cast("long").alias("hops"))


def call_tree(events: DataFrame, thread: str, order: str, kind: str) -> DataFrame:
    """Calls (enter and leaf events) with their level and the `order` of the call that they are in (null for a root).

    What a stack does is done by windows: the level before an event is the running balance of
    enters and exits, lifted so that exits without an enter count for nothing; the caller is
    the last enter of the level above.
    """
    w = Window.partitionBy(thread).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    balance = F.sum(F.when(F.col(kind) == "enter", 1).when(F.col(kind) == "exit", -1).otherwise(0)).over(w)
    rows = events.withColumn("_s", balance).withColumn("_low", F.least(F.lit(0), F.min("_s").over(w)))
    after = F.col("_s") - F.col("_low")
    rows = rows.where(F.col(kind) != "exit").withColumn("level", F.when(F.col(kind) == "enter", after - 1).otherwise(after).cast("long")).drop("_s", "_low")
    calls = rows.withColumn("_up", F.col("level") - 1)
    enters = rows.where(F.col(kind) == "enter").select(thread, F.col("level").alias("_up"), order, F.col(order).alias("parent"))
    # by order, an enter stands at its own place; a call's own place is never a caller's, as levels differ
    return asof(calls, enters, [thread, "_up"], order, "parent", ["parent"]).withColumnRenamed("asof_parent", "parent").drop("_up")


def ancestors(path, separator: str = "/"):
    """The folders above a path, the nearest first, the root ('') last."""
    parts = F.filter(F.split(path, separator), lambda p: p != "")
    n = F.size(parts)
    inner = F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1)), lambda i: F.array_join(F.slice(parts, 1, i), separator))).otherwise(F.array().cast("array<string>"))
    return F.concat(inner, F.array(F.lit("")))
