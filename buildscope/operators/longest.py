"""Longest ways through graphs with weights on nodes (G7, G17, W8), circles and all.

A chain of nodes with one successor each is one step: such chains are followed at once, by doubling. What
is left are nodes with several successors; a round settles those all of whose successors' chains end in settled
nodes, so rounds grow with the branchings on a way, not with its nodes. Nodes on a circle, and before one, are left over;
only among these strongly connected components are made, and each is then one node with the sum of its weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import followed
from .graph import backwards, cut, hops


def strong(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node, component): the least node of those that reach a node and are reached by it.

    Colours go forward, the greatest winning; of each colour what reaches its own node without leaving the colour is
    a component, and goes. A round of colours takes as many steps as the longest way that one goes.
    """
    left, between, done = cut(nodes.select("node").distinct()), edges.select("src", "dst").distinct(), None
    while not left.isEmpty():
        inner = cut(between.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi"))
        colour = cut(left.withColumn("colour", F.col("node")))
        front = colour
        while not front.isEmpty():
            sent = inner.join(front.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
            front = cut(sent.join(colour, "node").where("new > colour").select("node", F.col("new").alias("colour")))
            colour = cut(colour.join(front.withColumnRenamed("colour", "new"), "node", "left").select("node", F.coalesce("new", "colour").alias("colour")))
        ends = inner.join(colour.withColumnsRenamed({"node": "src", "colour": "a"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "b"}), "dst").where("a = b").select("src", "dst")
        roots = colour.where("node = colour").select("node")
        found = hops(backwards(ends), roots).select("node").join(colour, "node")
        least = found.groupBy("colour").agg(F.min("node").alias("component"))
        now = cut(found.join(least, "colour").select("node", "component"))
        done = now if done is None else cut(done.unionByName(now))
        left = cut(left.join(now, "node", "left_anti"))
    return nodes.select("node", F.col("node").alias("component")).limit(0) if done is None else done


def settled(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows (node, worst, next): nodes from which no circle is reached; of equal successors next is the least, and null at an end.

    Joins are merges: what is settled grows with the nodes, and broadcasts of it, one or more a round, would go through the driver.
    """
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("only"))
    nodes = weights.join(out.hint("merge"), "node", "left")
    one = F.col("n") == 1
    rows = nodes.select(F.lit(0).alias("space"), "node", F.when(one, F.col("only")).alias("to"), F.when(one, F.col("weight")).otherwise(F.lit(0).cast("long")).alias("sum"), F.col("node").alias("end"))
    chains = followed(rows, ["space"], "node", "to", {"sum": lambda a, b: a + b, "end": lambda a, b: b}).where("to is null").select("node", "sum", "end")
    chains = cut(chains)
    # ways of the branching nodes: to the end of each successor's chain, and what lies on it
    hubs = nodes.where("n > 1").select(F.col("node").alias("src"))
    ways = cut(edges.join(hubs.hint("merge"), "src", "left_semi").join(chains.withColumnRenamed("node", "dst").hint("merge"), "dst", "left").select("src", "dst", "sum", "end"))
    done = cut(nodes.where("n is null").select("node", F.col("weight").alias("worst"), F.lit(None).cast(weights.schema["node"].dataType).alias("next")))
    new, waiting = done, cut(ways.groupBy("src").agg(F.count(F.lit(1)).alias("left")))
    best = None
    while not new.isEmpty():
        met = ways.join(new.select(F.col("node").alias("end"), "worst").hint("merge"), "end").select("src", "dst", (F.col("sum") + F.col("worst")).alias("value"))
        met = met.select("src", F.lit(1).alias("n"), F.struct("value", F.col("dst").alias("by")).alias("b"))
        both = met if best is None else met.unionByName(best)
        # of the greatest values the least successor
        most = both.groupBy("src").agg(F.sum("n").alias("n"), F.max("b.value").alias("value"))
        by = both.join(most.select("src", "value").hint("merge"), "src").where("b.value = value").groupBy("src").agg(F.min("b.by").alias("by"))
        best = cut(most.join(by.hint("merge"), "src").select("src", F.col("n").cast("int").alias("n"), F.struct("value", "by").alias("b")))
        ready = best.join(waiting.hint("merge"), "src").where("n = left")
        own = weights.select(F.col("node").alias("src"), "weight")
        new = cut(ready.join(own.hint("merge"), "src").select(F.col("src").alias("node"), (F.col("weight") + F.col("b.value")).alias("worst"), F.col("b.by").alias("next")))
        best = best.join(new.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti")
        done = done.unionByName(new)
    ends = cut(done)
    singles = nodes.where(one).select("node", "only").join(chains.hint("merge"), "node").join(ends.select(F.col("node").alias("end"), "worst").hint("merge"), "end")
    return ends.unionByName(singles.select("node", (F.col("sum") + F.col("worst")).alias("worst"), F.col("only").alias("next")))


def longest(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows (node, worst, next, component, recursive): a node's own weight with the greatest worst of its successors, which is next.

    Nodes that reach each other are one component, told by its least node, with the sum of their weights; all of
    them, and a node with an edge to itself, are recursive. next names a component. Edges to nodes without a weight do not count.
    """
    own = cut(weights.select("node", F.col("weight").cast("long").alias("weight")))
    known = own.select("node")
    every = edges.select("src", "dst").distinct().join(known.withColumnRenamed("node", "src").hint("merge"), "src", "left_semi").join(known.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_semi")
    every = cut(every)
    between, loops = every.where("src <> dst"), every.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    plain = cut(settled(between, own))
    left = cut(own.join(plain.hint("merge"), "node", "left_anti"))
    out = plain.withColumns({"component": F.col("node"), "circle": F.lit(False)})
    if not left.isEmpty():
        ways = cut(between.join(left.select(F.col("node").alias("src")), "src", "left_semi"))
        inner = ways.join(left.select(F.col("node").alias("dst")), "dst", "left_semi")
        component = cut(strong(inner, left))
        member = component.withColumnsRenamed({"node": "src", "component": "a"})
        into = component.withColumnsRenamed({"node": "dst", "component": "b"})
        joined = ways.join(member, "src").join(into, "dst", "left").select(F.col("a").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct()
        sums = left.join(component, "node").groupBy(F.col("component").alias("node")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("size"))
        below = plain.join(joined.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").select("node", F.col("worst").alias("weight"))
        got = settled(cut(joined), cut(sums.select("node", "weight").unionByName(below)))
        told = sums.select(F.col("node").alias("component"), (F.col("size") > 1).alias("circle")).join(got.withColumnRenamed("node", "component"), "component")
        out = out.unionByName(component.join(told, "component").select("node", "worst", "next", "component", "circle"))
    return out.join(loops.hint("merge"), "node", "left").select("node", "worst", "next", "component", (F.col("circle") | F.coalesce("loop", F.lit(False))).alias("recursive"))


def ways(found: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Rows (node, path) of longest()'s rows, for all nodes or those given: the components on the way, each with its nodes in order.

    Steps are doubled a round. All paths together can take the square of the nodes: ask for those that are needed.
    """
    kind = found.schema["node"].dataType.simpleString()
    parts = found.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("path"), F.first("next").alias("next"))
    rows = parts.select(F.lit(0).alias("space"), "component", F.col("next").alias("to"), F.col("path").cast(f"array<{kind}>").alias("path"))
    if nodes is not None:  # only what lies on the ways of those
        start = found.join(nodes.select("node"), "node", "left_semi").select(F.col("component").alias("node")).distinct()
        on = hops(parts.where("next is not null").select(F.col("component").alias("src"), F.col("next").alias("dst")), start).select(F.col("node").alias("component"))
        rows = rows.join(on, "component", "left_semi")
    whole = followed(rows, ["space"], "component", "to", {"path": lambda a, b: F.concat(a, b)})
    asked = found if nodes is None else found.join(nodes.select("node"), "node", "left_semi")
    return asked.select("node", "component").join(whole.select("component", "path"), "component").select("node", "path")
