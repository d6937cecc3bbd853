"""The table of queries and their SQL, and what the query modules share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables by name, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores: a small file is read by one task, however long its rows then take."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def money(c) -> Column:
    """Exact sums of doubles, whatever the order of rows."""
    return F.col(c).cast("decimal(18,4)") if isinstance(c, str) else c.cast("decimal(18,4)")


def as_double(c) -> Column:
    return c.cast("double")


def n_rows() -> Column:
    return F.count(F.lit(1))


def pick(key: Column, values: Sequence[str]) -> Column:
    """The value that key, modulo their number, names."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def sql_pick(key: str, values: Sequence[str]) -> str:
    """pick() in the SQL that checks it."""
    quoted = ",".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({key}) % {len(values)} + 1]"
