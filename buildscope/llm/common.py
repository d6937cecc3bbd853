"""Helpers that the text operators share: Arrow columns as byte buffers, row keys, session settings.

Rows are told apart by (doc_id, rid), where rid is a 64-bit hash of the row's own
doc_id and text. Rows that agree in both are copies of one row and get one answer, so
joining on the pair is safe however often a table is read again after a lost executor.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where ids are compared: it comes after every real id.
NULL_ID = np.iinfo(np.int64).max


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_id() -> Column:
    """64-bit identity of a row's content; see the module's docstring."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    if not (base := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="buildscope-")  # a single machine, as in tests
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: With the first the shuffle files of a query go when it has ended; the second keeps batches of long texts small.
STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and its shuffle files go."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in STORING}
    for k, v in STORING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes what stored() wrote for these; nothing that is still to run may read them."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def set_apart(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but `own` under names that no step uses, and what each column is called there."""
    names = {c: c if c in own else f"_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def set_back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*(F.col(n).alias(c) for c, n in names.items()))


_held: dict = {}


def held(key, build=None):
    """What build() made for key in this Python worker. A worker, which may live on from stage to stage, keeps one such thing only."""
    if key not in _held:
        _held.clear()
        trim()
        if build is not None:
            _held[key] = build()
    return _held.get(key)


def trim() -> None:
    """Gives freed memory of this worker back to the system, and has large blocks go back as soon as they are freed."""
    import gc

    gc.collect()
    release()


def release() -> None:
    """trim() without a search for unreachable objects."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        c = ctypes.CDLL(None)
        c.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        c.mallopt(-8, 2)  # M_ARENA_MAX
        c.malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: the memory stays with the worker


def tidied(run):
    """run, a function of Arrow batches, after which the worker gives freed memory back: it lives on beside the next stage's."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def strings(column) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """An Arrow string column as (bytes, starts, ends); a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    starts, ends = at[:-1], at[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        ends[gone] = starts[gone]
    return memoryview(data if data is not None else b"").cast("B"), starts, ends


def longs(column, null: int = 0) -> np.ndarray:
    """An Arrow integer column as int64, with `null` in place of nulls."""
    return np.asarray(column.cast(pa.int64()).fill_null(null))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Base of the rolling hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] == sum of values[k] * BASE**k for i <= k < j, modulo 2**64."""
    h = np.empty(len(values) + 1, np.uint64)
    h[0] = 0
    np.cumsum(values * powers(BASE, len(values)), out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], wherever the spans stand."""
    return mix((h[ends] - h[starts]) * powers(UNBASE, len(h))[starts])


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_values(data) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return _BYTES[np.frombuffer(data, np.uint8)]


def word_hashes(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by spaces, where each starts in that, and a 64-bit hash of each."""
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    if not words:
        return text, starts, np.zeros(0, np.uint64)
    h = prefix_hash(byte_values(text))
    return text, starts, span_hash(h, starts[:-1], starts[:-1] + lengths)


#: A-Z to lower case; all that is neither a digit, a letter nor beyond ASCII to spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: The same classes as a pattern, for code that works on text.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text."""
    return text.translate(LETTERS).split()
