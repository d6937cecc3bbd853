"""What a row needs of all rows before it in its file, however large the file is.

Rows are dealt by ranges of (file, place) and stored, so a file may lie in any number of ranges and a
range may hold many files. Every range is scanned by itself; then only the ends of ranges, one row for
each file and range, are put in order of ranges and scanned; and what lies before a range is
joined to its rows again. No task holds a file, only a range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .graph import cut, pinned

#: Rows of a range, about.
ROWS = 1 << 20


def dealt(rows: DataFrame, file: str, place: str, size: int) -> DataFrame:
    """rows by ranges of about so many, with the range's number in _part; as many ranges as cores, if they are not very small then."""
    count, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-count // size), min(cores, count // max(1, size // 64)))
    return rows.repartitionByRange(n, file, place).withColumn("_part", F.spark_partition_id())


def ranged(rows: DataFrame, file: str, place: str, size: int = ROWS) -> DataFrame:
    """rows stored in ranges of about so many, a partition each, with the range's number in _part, in order within it."""
    return pinned(dealt(rows, file, place, size).sortWithinPartitions(file, place))


def last_values(rows: DataFrame, file: str, place: str, columns: Sequence[str], size: int = ROWS, own: bool = True) -> DataFrame:
    """rows with the last value that is not null of each of the columns in place of the column: up to and with the row itself, or before it."""
    own_part = cut(dealt(rows, file, place, size))  # a window sorts them itself
    window = Window.partitionBy(file, "_part").orderBy(place)
    upto = window.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    inside = own_part.withColumns({f"_in_{c}": F.last(c, ignorenulls=True).over(upto) for c in columns})
    ends = own_part.groupBy(file, "_part").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(place))).alias(f"_end_{c}") for c in columns))
    ranges = Window.partitionBy(file).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(file, "_part", *(F.last(f"_end_{c}", ignorenulls=True).over(ranges).alias(f"_before_{c}") for c in columns))
    joined = inside.join(before.hint("merge"), [file, "_part"])  # there may be as many files as rows
    return joined.select(*(F.coalesce(f"_in_{c}", f"_before_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


def prefixes(rows: DataFrame, file: str, place: str, summary: Callable[[dict], bytes], compose: Callable[[bytes, bytes], bytes], nothing: bytes, size: int = ROWS, uses: Sequence[str] | None = None) -> DataFrame:
    """rows with `before`: the summaries of all rows before it in its file, composed; nothing for a file's first.

    summary(row) tells in bytes what a row, given as a dictionary of the columns that it uses (all, if not told), does; compose(a, b) what a and then b do, and
    must be associative. The sizes of what compose() gives must not grow with the rows.
    """
    own = ranged(rows, file, place, size)
    fields = StructType([*own.schema, StructField("inside", BinaryType()), StructField("upto", BinaryType())])

    def scan(batches):
        at, upto = None, nothing
        for batch in batches:
            inside, after = [], []
            told = batch.select(list(uses)) if uses is not None else batch
            for key, part, row in zip(batch.column(file).to_pylist(), batch.column("_part").to_pylist(), told.to_pylist(), strict=True):
                if (key, part) != at:
                    at, upto = (key, part), nothing
                inside.append(upto)
                upto = compose(upto, summary(row))
                after.append(upto)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside, pa.binary()), pa.array(after, pa.binary())], names=[*batch.schema.names, "inside", "upto"])

    inside = cut(own.mapInArrow(scan, fields))
    ends = inside.groupBy(file, "_part").agg(F.max_by("upto", place).alias("upto"))

    def ranges(table: pa.Table) -> pa.Table:
        upto, out = nothing, []
        table = table.sort_by("_part")
        for b in table.column("upto").to_pylist():
            out.append(upto)
            upto = compose(upto, b)
        return pa.table({file: table.column(file), "_part": table.column("_part"), "_range": pa.array(out, pa.binary())})

    kinds, names = dict(own.dtypes), rows.columns
    before = ends.groupBy(file).applyInArrow(ranges, f"`{file}` {kinds[file]}, _part int, _range binary")

    def joined(batches):
        for batch in batches:
            both = [compose(a, b) for a, b in zip(batch.column("_range").to_pylist(), batch.column("inside").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(both, pa.binary())], names=[*names, "before"])

    every = inside.join(before.hint("merge"), [file, "_part"]).select(*rows.columns, "inside", "_range")
    return every.mapInArrow(joined, StructType([*rows.schema, StructField("before", BinaryType())]))
