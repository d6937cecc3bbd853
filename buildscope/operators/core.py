"""Relational helpers that the rest is made of. All are lazy and leave the strategy to Catalyst."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: what an upsert by key leaves."""
    return dedupe_first(df, keys, [F.col(c).desc() for c in order])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank; Spark keeps only k rows a key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def ring(df: DataFrame, keys: Sequence[str], time: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    return top_k(df, keys, [F.col(c).desc() for c in time], n, "_n").drop("_n")


def optional(*parts: Column | None) -> Column:
    """Conjunction of the conditions that are given; an absent one filters nothing."""
    given = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def contains(column: str, part: str | None) -> Column | None:
    """Case-insensitive substring test; % and _ are plain characters. None for an empty part."""
    return F.lower(F.col(column)).contains(part.lower()) if part else None


def tri_state(value: Column, allowed: Sequence[bool | None]) -> Column:
    """Whether a boolean that may be null is one of the allowed states; null is a state like the others."""
    known = [a for a in allowed if a is not None]
    out = value.isin(known) if known else F.lit(False)
    return F.coalesce(out, F.lit(None in allowed))


def short_keys(df: DataFrame, names: dict[str, str], marked: Sequence[str] = ()) -> DataFrame:
    """The named columns under short names; comments that mark generated text go from `marked` ones."""
    strip = lambda c: F.trim(F.regexp_replace(c, "<!--[^>]*-->", ""))
    return df.select(*((strip(c) if c in marked else F.col(c)).alias(n) for c, n in names.items()))


def remap_ends(edges: DataFrame, pairs: DataFrame, a: str, b: str, file: str, paired: str) -> DataFrame:
    """edges with both ends replaced by their paired file where there is one; edges from a file to itself go."""
    for end in (a, b):
        to = pairs.select(F.col(file).alias(end), F.col(paired).alias("_to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges.where(F.col(a) != F.col(b))


def valid_patterns(patterns: Sequence[str]) -> list[str]:
    """Those that compile; the others are skipped."""
    import re

    def works(p):
        try:
            re.compile(p)
        except re.error:
            return False
        return True

    return [p for p in patterns if works(p)]


def user_match(value: Column, pattern: str, flags: str = "") -> Column:
    """Whether a user's pattern is found; flags other than i, m, s and u are dropped, a pattern that does not compile never matches."""
    if not valid_patterns([pattern]):
        return F.lit(False)
    known = "".join(f for f in dict.fromkeys(flags) if f in "imsu")
    return value.rlike((f"(?{known})" if known else "") + pattern)


def any_glob(value: Column, globs: Sequence[str]) -> Column:
    """Whether any glob of * and ? fits the whole value."""
    import re

    fits = [value.rlike("^" + re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") + "$") for g in globs]
    return reduce(lambda x, y: x | y, fits) if fits else F.lit(False)


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, tie: str, values: Sequence[str]) -> DataFrame:
    """left with the values of right's last row at or before it, by union and one window.

    Right rows come before left rows of the same time; of right rows at one time the one with
    the greatest tie counts. Each key is sorted once and nothing is multiplied, so a long
    history costs no more than its rows.
    """
    own = F.struct(*values)
    none = F.lit(None).cast(right.select(own.alias("v")).schema["v"].dataType)
    a = left.withColumn("_v", none).withColumn("_s", F.lit(1)).withColumn("_t", F.lit(0).cast("long"))
    b = right.select(*by, on, own.alias("_v"), F.lit(0).alias("_s"), F.col(tie).cast("long").alias("_t"))
    w = Window.partitionBy(*by).orderBy(on, "_s", "_t").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return both.where("_s = 1").select(*left.columns, *(F.col(f"_v.{v}").alias(f"asof_{v}") for v in values))


def range_join(points: DataFrame, intervals: DataFrame, x: str, lo: str, hi: str, width: float) -> DataFrame:
    """Pairs with lo <= x < hi: intervals are dealt to the cells of a grid, points to one, and cells are joined.

    width is about the length of an interval; a longer one takes a row a cell.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    spread = intervals.where(F.col(hi) > F.col(lo)).withColumn("_cell", F.explode(F.sequence(cell(lo), cell(hi))))
    return points.withColumn("_cell", cell(x)).join(spread, "_cell").where((F.col(x) >= F.col(lo)) & (F.col(x) < F.col(hi))).drop("_cell")


def waterfall(candidates: DataFrame, keys: Sequence[str], priority: str = "priority") -> DataFrame:
    """Candidates of each key's best priority."""
    w = Window.partitionBy(*keys).orderBy(priority)
    return candidates.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, before, after, delta) that changed or went; rows that came are not reported."""
    a, b = old.select(key, F.col(value).alias("before")), new.select(key, F.col(value).alias("after"))
    changed = a.join(b, key).where("before <> after")
    gone = a.join(b, key, "left_anti").withColumn("after", F.lit(0).cast(a.schema["before"].dataType))
    return changed.unionByName(gone).withColumn("delta", F.col("after") - F.col("before"))


def induced(edges: DataFrame, nodes: DataFrame, a: str, b: str, node: str) -> DataFrame:
    """Edges with both ends among the nodes."""
    one = nodes.select(node).distinct()
    return edges.join(one.withColumnRenamed(node, a), a, "left_semi").join(one.withColumnRenamed(node, b), b, "left_semi").select(*edges.columns)


def waste(total: Column, claimed: Column) -> Column:
    return F.greatest(F.lit(0), total - claimed)


def seen_before(flag: Column, order, rows: int) -> Column:
    """Whether the flag holds in any of the rows just before, in a window's order."""
    return F.coalesce(F.max(flag.cast("int")).over(order.rowsBetween(-rows, -1)) == 1, F.lit(False))


def near(flag: Column, order, rows: int) -> Column:
    """Whether the flag holds within so many rows on either side: one window, no join with the targets."""
    return F.max(flag.cast("int")).over(order.rowsBetween(-rows, rows)) == 1


def findings(*parts: DataFrame) -> DataFrame:
    """Rows of several producers under one schema; what a producer does not know is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rank_of(value: Column, order: Sequence[str]) -> Column:
    """Place of value in the order; others come last."""
    out = F.when(value == order[0], 0)
    for i, v in enumerate(order[1:], 1):
        out = out.when(value == v, i)
    return out.otherwise(len(order))


def without_orphans(nodes: DataFrame, edges: DataFrame, node: str, root=None, a: str = "src", b: str = "dst") -> DataFrame:
    """The nodes with an edge, and the root."""
    ends = edges.select(F.explode(F.array(a, b)).alias(node))
    kept = nodes.join(ends, node, "left_semi")
    return kept if root is None else kept.unionByName(nodes.where(F.col(node) == root)).dropDuplicates([node])


def isrs(symbols: DataFrame) -> DataFrame:
    """M5: functions that are handlers by name or section, the first of each name by address, with the reasons."""
    from ..functions import rules as R

    section = F.col("section")
    by_name = R.is_isr(F.col("name"))
    vector = section.isin(*R.VECTOR_SECTIONS) | F.lower(section).contains("vector")
    fast = section.isin(*R.FAST_SECTIONS, *R.VECTOR_SECTIONS) | R.any_of(F.lower(section), ("iram", "itcm", "ramcode", "fastcode"))
    reason = F.concat_ws(" + ", F.when(by_name, "naming convention"), F.when(vector, "vector section"), F.when(fast, "fast memory"))
    return dedupe_first(symbols.where(by_name | vector).withColumn("reason", reason), ["name"], ["addr"])
