"""Hard negatives by a full score sort for each anchor.

Vectors are integers, so scores are exact. Anchors are the stated query set: they are taken
ANCHORS at a time, each such block being sent to all tasks, which hold it against their rows
ROWS at a time. For an anchor and so many rows all scores are computed and sorted by falling
score, ties by id. A first pass takes an anchor's positives from the rows of its label; a second
finds, by binary search, where each positive's upper limit falls in the sorted scores and reads
rows of other labels from there down to its lower limit, k at most. What the tasks found
is ranked again: the first k of all are among the first k of every part, so nothing is lost, and
no task sees more than ROWS rows and what the parts found of one anchor and positive.

Defined cases: rows with a null label, a null vector or any null or non-finite component take
no part; rows that agree in id, label and vector are one row; rows that share an id only are
rows of their own, and anchors of their own; a null id comes after all others and is never an
anchor's; a vector that is shorter than another counts as ending in zeros; an anchor without
another row of its label has no result, and neither has a positive whose score is negative, as its
limits cross. Scores beyond 64 bits stay at the largest or least long. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

POSITIVES, K, LOWER, UPPER = 5, 10, 30, 90
#: Anchors of a pass over the rows; rows that a task sorts at a time; anchors of which it holds the scores at a time.
ANCHORS, ROWS, AT_ONCE = 8192, 16384, 64
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def matrix(column) -> np.ndarray:
    """An Arrow column of lists as rows of one length; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.offsets, np.int64)
    values, size = np.asarray(column.values), np.diff(ends)
    width = int(size.max(initial=0))
    if (size == width).all():
        return values[ends[0] : ends[-1]].reshape(len(size), width)
    out = np.zeros((len(size), width), values.dtype)
    out[np.arange(width) < size[:, None]] = values[ends[0] : ends[-1]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exact; those beyond a long stay at its ends."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    most = lambda x: max(abs(int(x.min(initial=0))), int(x.max(initial=0)))
    if most(a) * most(b) * width < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, _LEAST, _MOST).astype(np.int64)


def parts(batches):
    """Of a task's rows (ids, labels, vectors, whether the id is null), so many at a time, by rising id."""

    def one(held):
        t = pa.Table.from_batches(held)
        gone = np.asarray(t.column("id").combine_chunks().is_null())
        ids = C.longs(t.column("id").combine_chunks(), C.NULL_ID)
        order = np.lexsort((gone, ids))
        return ids[order], np.asarray(t.column("label").combine_chunks())[order], matrix(t.column("x"))[order], gone[order]

    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            held.append(batch.slice(at, ROWS))
            n += held[-1].num_rows
            if n >= ROWS:
                yield one(held)
                held, n = [], 0
    if n:
        yield one(held)


def emitted(columns: dict, schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) for c, kind in schema.items()], names=list(schema))


def scored(anchors, rows):
    """For each anchor its number and its scores with the rows."""
    for a in range(0, len(anchors["id"]), AT_ONCE):
        for k, s in enumerate(products(anchors["x"][a : a + AT_ONCE], rows), a):
            yield k, s


def positives(rows: DataFrame, shared, n: int) -> DataFrame:
    """Rows (a, place, id, score): the n first other rows of each anchor's label."""
    kinds = {"a": pa.int32(), "id": pa.int64(), "score": pa.int64()}

    def run(batches):
        anchors = shared.value
        for ids, labels, x, gone in parts(batches):
            out = {c: [] for c in kinds}
            of = {label: np.flatnonzero(labels == label) for label in np.unique(labels)}
            for k, score in scored(anchors, x):
                at = of.get(anchors["label"][k], np.zeros(0, int))
                at = at[np.argsort(-score[at], kind="stable")][: n + 1]
                own = anchors["x"][k]
                for i in [i for i in at if not (ids[i] == anchors["id"][k] and np.array_equal(np.trim_zeros(x[i], "b"), np.trim_zeros(own, "b")))][:n]:
                    out["a"].append(k), out["id"].append(None if gone[i] else ids[i]), out["score"].append(score[i])
            yield emitted(out, kinds)

    by = Window.partitionBy("a").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = rows.mapInArrow(run, "a int, id long, score long")
    return found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def limits(score: int, lower: int, upper: int) -> tuple[int, int]:
    """The least and the largest score that a negative of a positive of that score may have."""
    return max(-(-lower * score // 100), _LEAST), min(upper * score // 100, _MOST)


def first_other(order: np.ndarray, labels: np.ndarray, label, start: int, end: int, k: int) -> np.ndarray:
    """The first k of order[start:end] of another label, read piece by piece."""
    found, step = [], 4 * k
    while start < end and sum(map(len, found)) < k:
        piece = order[start : min(end, start + step)]
        found.append(piece[labels[piece] != label])
        start, step = start + step, 2 * step
    return np.concatenate(found)[:k] if found else order[:0]


def negatives(rows: DataFrame, shared, k: int, lower: int, upper: int) -> DataFrame:
    """Rows (a, place, rank, id, score): the k first rows of other labels between the limits of each anchor's positives."""
    kinds = {"a": pa.int32(), "place": pa.int32(), "id": pa.int64(), "score": pa.int64()}

    def run(batches):
        anchors = shared.value
        for ids, labels, x, gone in parts(batches):
            out = {c: [] for c in kinds}
            for a, score in scored(anchors, x):
                if not anchors["positives"][a]:
                    continue
                order = np.argsort(-score, kind="stable")  # rows come by rising id, so this sorts by score, then id
                falling = -score[order]
                for place, _, positive in anchors["positives"][a]:
                    least, most = limits(positive, lower, upper)
                    start, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                    for i in first_other(order, labels, anchors["label"][a], start, end, k):
                        out["a"].append(a), out["place"].append(place), out["id"].append(None if gone[i] else ids[i]), out["score"].append(score[i])
            yield emitted(out, kinds)

    by = Window.partitionBy("a", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = rows.mapInArrow(run, "a int, place int, id long, score long")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, n_positives: int = POSITIVES, k: int = K, lower: int = LOWER, upper: int = UPPER, block: int = ANCHORS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); rows has id, label and x, an array of longs.

    anchor is a condition on id. A negative's score lies between lower and upper per cent of the positive's.
    """
    spark = rows.sparkSession
    own = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "x").where("label is not null and x is not null")
    own = C.stored(own.distinct(), "vectors")
    n = own.where(anchor & F.col("id").isNotNull()).count()
    blocks = -(-n // block)
    if not blocks:
        return spark.createDataFrame([], SCHEMA)
    dealt, out = C.shared_path(spark, "anchors"), C.shared_path(spark, "negatives")
    own.where(anchor & F.col("id").isNotNull()).withColumn("block", F.pmod(F.xxhash64("id", "label", "x"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(dealt)
    for b in range(blocks):
        held = spark.read.schema("id long, label long, x array<long>, block int").parquet(dealt).where(F.col("block") == b).orderBy("id", "label", "x").toArrow()
        if not held.num_rows:
            continue
        anchors = {"id": np.asarray(held.column("id").combine_chunks()), "label": np.asarray(held.column("label").combine_chunks()), "x": matrix(held.column("x"))}
        first = spark.sparkContext.broadcast(anchors)
        anchors["positives"] = [[] for _ in range(held.num_rows)]
        for r in positives(own, first, n_positives).orderBy("a", "place").collect():
            anchors["positives"][r.a].append((r.place, r.id, r.score))
        second = spark.sparkContext.broadcast(anchors)
        of = spark.createDataFrame(
            [(a, p, int(anchors["id"][a]), i, s) for a, own_positives in enumerate(anchors["positives"]) for p, i, s in own_positives],
            "a int, place int, anchor_id long, positive_id long, positive_score long",
        )
        found = negatives(own, second, k, lower, upper).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        found.join(F.broadcast(of), ["a", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(f"{out}/block={b}")
        first.destroy(), second.destroy()
    return spark.read.schema(SCHEMA + ", block int").parquet(out).drop("block")
