"""Ledgers and summaries with what their readers need besides the counts (A3, A12, A19, A23, J13, T1, SRC23)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import top_k
from .located import suffix_match

# How strong a kind of call edge is.
EDGE_RANKS = {"pointer": 3, "virtual": 2, "virtualCandidate": 2, "direct": 1}


def reconciled(sections: DataFrame, claims: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A3: rows (by, section_total, symbol_total, unclaimed, linking_gap, other_gap, coverage).

    sections: by, name, size, linking (whether it holds what linking needs); claims: by, name, size. A section's gap is what is
    not claimed of it, or nothing; coverage is the share that is not an other gap, 0 of nothing.
    """
    claimed = claims.groupBy(*by, "name").agg(F.sum("size").alias("claimed"))
    per = sections.groupBy(*by, "name").agg(F.sum("size").alias("size"), F.max("linking").alias("linking")).join(claimed, [*by, "name"], "left")
    gap = F.greatest(F.col("size") - F.coalesce("claimed", F.lit(0)), F.lit(0))
    held = lambda c: F.coalesce(F.sum(F.when(c, gap)), F.lit(0))
    out = per.groupBy(*by).agg(F.sum("size").alias("section_total"), held(F.col("linking")).alias("linking_gap"), held(~F.col("linking")).alias("other_gap"))
    symbols = claims.groupBy(*by).agg(F.sum("size").alias("symbol_total"))
    both = out.join(symbols, list(by), "left") if by else out.crossJoin(symbols)  # a row each
    total = F.coalesce("symbol_total", F.lit(0))
    share = F.when(F.col("section_total") > 0, (F.col("section_total") - F.col("other_gap")).cast("double") / F.col("section_total").cast("double")).otherwise(0.0)
    return both.select(*by, "section_total", total.alias("symbol_total"), F.greatest(F.col("section_total") - total, F.lit(0)).alias("unclaimed"), "linking_gap", "other_gap", share.alias("coverage"))


def ramp_up(entries: DataFrame, kinds: Sequence[str], scheduled: Sequence[str], open_kind: str, now: Column) -> DataFrame:
    """Rows (kind, n, total, retired, modules, oldest_days): a row for each kind, with what there is of all kinds.

    entries: kind, file, created, revisit_at. modules counts distinct first two folders of files, retired the scheduled kinds'
    entries that do not come up again, oldest_days the whole days since the first open question, null if there is none.
    """
    top = F.array_join(F.slice(F.split("file", "/"), 1, 2), "/")
    sums = entries.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("kind").isin(*scheduled) & F.col("revisit_at").isNull()).alias("retired"),
        F.countDistinct(F.when(F.coalesce("file", F.lit("")) != "", top)).alias("modules"),
        F.floor((F.unix_millis(now) - F.unix_millis(F.min(F.when(F.col("kind") == open_kind, F.col("created"))))) / 86_400_000).alias("oldest_days"),
    )
    every = entries.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    n = entries.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "kind", "left").crossJoin(sums).select("kind", F.coalesce("n", F.lit(0)).alias("n"), "total", "retired", "modules", "oldest_days")


def promoted(edges: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Rows (a, b, kind, confirmed, via, sites): of each pair the strongest kind, of equal ones the first; confirmed if any is, else as the first; the first via."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in EDGE_RANKS.items() for x in kv)), F.col("kind")), F.lit(0))
    first = F.min_by(F.struct("confirmed", "via"), order).alias("f")
    found = edges.groupBy(a, b).agg(F.min_by("kind", F.struct(-rank, F.col(order))).alias("kind"), F.max(F.coalesce("confirmed", F.lit(False))).alias("any"), first, F.count(F.lit(1)).alias("sites"))
    return found.select(a, b, "kind", F.when(F.col("any"), True).otherwise(F.col("f.confirmed")).alias("confirmed"), F.col("f.via").alias("via"), "sites")


def collapsed(findings: DataFrame, key: str, place: str, order: Sequence[str], most: int = 8) -> DataFrame:
    """Rows (key, representative, n, places, more): the first finding's order, how many there are, and the first distinct places, up to so many."""
    at = F.struct(*order)
    first = findings.groupBy(key, place).agg(F.min(at).alias("_at"))
    told = top_k(first, [key], ["_at"], most, "_n").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", place))), lambda x: x[place]).alias("places"))
    n = findings.groupBy(key).agg(F.min(at).alias("representative"), F.count(F.lit(1)).alias("n"))
    return n.join(told, key).withColumn("more", F.col("n") > most).orderBy(F.desc("n"), "representative")


def two_planes(predicted: DataFrame, observed: DataFrame, separator: str = "::") -> DataFrame:
    """Rows (name, outcome, coverage) of two tables of names: confirmed or never_ran for predicted ones, unpredicted for observed ones.

    Names agree if one is the end of the other, by whole components. coverage is the share of the predicted that is confirmed, 0 of none.
    """
    p, o = predicted.select(F.col("name").alias("p")).distinct(), observed.select(F.col("name").alias("o")).distinct()
    met = suffix_match(p, o, "p", "o", separator)
    mine = p.join(met.select("p").distinct().withColumn("_is", F.lit(True)), "p", "left").select(F.col("p").alias("name"), F.when(F.col("_is"), "confirmed").otherwise("never_ran").alias("outcome"))
    other = o.join(met.select("o").distinct(), "o", "left_anti").select(F.col("o").alias("name"), F.lit("unpredicted").alias("outcome"))
    share = mine.agg(F.coalesce(F.try_divide(F.count_if(F.col("outcome") == "confirmed"), F.count(F.lit(1))), F.lit(0.0)).alias("coverage"))
    return mine.unionByName(other).crossJoin(share)


def sorted_rows(rows: DataFrame, column: str, tie: str, numeric: bool, descending: bool, most: int = 3000) -> DataFrame:
    """The first rows by a column, as numbers (what is none counts as 0) or as text without regard to case, either way round; ties by another column."""
    key = F.coalesce(F.col(column).try_cast("double"), F.lit(0.0)) if numeric else F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    top = rows.withColumn("_key", key).orderBy(F.desc("_key") if descending else F.asc("_key"), tie).limit(most)
    order = Window.orderBy(F.desc("_key") if descending else F.asc("_key"), tie)  # of the rows that are shown
    return top.withColumn("place", F.row_number().over(order)).drop("_key")


def stem_pairs(paths: DataFrame, path: str, first: str, second: str) -> DataFrame:
    """SRC23: rows (stem, first, second): the stems that files of both extensions have, with the shallowest, then first, of each."""
    name = F.substring_index(path, "/", -1)

    def of(ext: str, column: str) -> DataFrame:
        at = F.struct(F.size(F.split(path, "/")).alias("depth"), F.col(path).alias("path")).alias("at")
        own = paths.where(name.endswith(ext)).select(F.substring(name, F.lit(1), F.length(name) - len(ext)).alias("stem"), at)
        return own.groupBy("stem").agg(F.min("at").alias("at")).select("stem", F.col("at.path").alias(column))

    return of(first, "first").join(of(second, "second"), "stem")
