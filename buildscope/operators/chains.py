"""Chains of references followed to their ends, in rounds that grow with the logarithm of the longest chain."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut


def followed(rows: DataFrame, space: Sequence[str], key: str, to: str, values: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """rows with each value as it is at the end of the row's chain, and `to` null where the chain has an end.

    A row refers by `to` to the row of that key in the same space (the columns that must agree); keys are unique in a
    space. values tells for each column how a row's own value and that of the row it refers to make one; it must be
    associative. A reference to a row that is not there is an end. A round doubles the steps taken, and only
    rows whose chain goes on are joined and stored anew; rows of a circle keep their `to`. Joins are merges, as a stored column
    of repeated values says nothing of its size in memory.
    """
    names = [*space, key, to, *values]
    stored = cut(rows.select(*names))
    done, left = [stored.where(F.col(to).isNull())], stored.where(F.col(to).isNotNull())
    n = left.count()
    while n:
        ends = reduce(DataFrame.unionByName, [*done, left]).select(*space, F.col(key).alias(to), F.lit(True).alias("_is"), F.col(to).alias("_to"), *(F.col(c).alias(f"_{c}") for c in values))
        met = left.join(ends.hint("merge"), [*space, to], "left")
        stored = cut(met.select(*space, key, F.col("_to").alias(to), *(F.when(F.col("_is"), f(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c, f in values.items())))
        done.append(stored.where(F.col(to).isNull()))
        left = stored.where(F.col(to).isNotNull())
        before, n = n, left.count()
        if n == before:
            break
    return reduce(DataFrame.unionByName, [*done, left])
