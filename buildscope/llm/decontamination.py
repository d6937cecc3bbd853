"""Benchmark decontamination with suffix arrays over the training text.

Each task takes its documents in shards of a few MB. A shard's words become numbers of
the test vocabulary (0 for a word that no test has, which matches nothing; words are told
by 64-bit hashes, and what is found is compared byte by byte), and the positions from which a
match can start are sorted into a suffix array, compared by the next ``width`` words. Every
test suffix of at least a window is found by two binary searches. Occurrences that follow
one another in text and item make up a longest verbatim match (see ``longest_matches``); the
words that are hit are those of the occurrences, which are the same.

The training text is read once and never shuffled. The test set goes to all tasks as a
broadcast of arrays, in blocks of at most about BLOCK bytes of text, of which the driver
holds two: a larger test set takes one pass over the training text a block, with the
passes' findings stored and merged by row.

A window is ``width`` consecutive words of an item; an item with fewer words, but not
none, is one window. A document word within an occurrence of a window is hit.

Defined cases: null and empty texts have no words; items without words match nothing;
items that repeat count once by item_id; an item with a null id marks words but has no
name to list; extra columns are ignored by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WIDTH, BLOCK, SHARD = 10, 8 << 20, 1 << 20
FOUND = "doc_id long, rid long, n_words long, hits binary, items array<string>"


class Tests:
    """The windows of a block of test items as sorted arrays, and the items and places that have each."""

    def __init__(self, items: list[tuple], width: int):
        self.width = width
        split = [(i, C.plain_words((t or "").encode())) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.names = [None if i is None else str(i) for i, _ in split]
        self.lengths = np.fromiter((len(w) for _, w in split), np.int64, len(split))
        self.first = np.cumsum(self.lengths) - self.lengths
        # the items' words in a row, with the place of each
        self.text, self.at, hashes = C.word_hashes([x for _, w in split for x in w])
        del split
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        self.kind = np.dtype(">u2" if len(self.vocabulary) < 65535 else ">u4")
        number = (number.ravel() + 1).astype(self.kind)
        size = np.minimum(self.lengths, width)
        many = self.lengths - size + 1
        item = np.repeat(np.arange(len(size)), many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, size = self.first[item] + place, size[item]
        rows = np.zeros((len(start), width), self.kind)
        for k in range(width):  # a window's words; a shorter item's are followed by 0
            has = size > k
            rows[has, k] = number[start[has] + k]
        keys, inverse = np.unique(self.as_text(rows), return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        self.item, self.place = item[order], place[order]
        self.bounds = np.append(0, np.cumsum(np.bincount(inverse.ravel(), minlength=len(keys))))
        self.low, self.sizes = keys, size[order][self.bounds[:-1]]
        self.short = np.flatnonzero(self.sizes < width)
        high = rows[order[self.bounds[:-1]][self.short]]
        high[np.arange(width) >= self.sizes[self.short][:, None]] = np.iinfo(self.kind.newbyteorder("=")).max
        self.high = self.as_text(high)
        self.least = int(min([4, *self.sizes.tolist()]))

    def as_text(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view(f"S{self.width * self.kind.itemsize}").ravel()

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes; 0 for those of no test."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        near = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[near] == hashes, near + 1, 0)

    def window(self, w: int) -> bytes:
        """The words of a window, joined by spaces."""
        a = self.first[self.item[self.bounds[w]]] + self.place[self.bounds[w]]
        return self.text[self.at[a] : self.at[a + self.sizes[w]] - 1]


def search(numbers: np.ndarray, tests: Tests):
    """Occurrences in a shard of test windows: (position, index of the window)."""
    none = np.zeros(0, np.int64)
    if not len(tests.low):
        return none, none
    known = numbers > 0
    n = len(numbers)
    start = known.copy()
    for k in range(1, tests.least):
        start[: n - k] &= known[k:]
        start[n - k :] = False
    at = np.flatnonzero(start)
    if not len(at):
        return none, none
    wide = np.zeros(n + tests.width, tests.kind)
    wide[:n] = numbers
    suffixes = tests.as_text(np.lib.stride_tricks.sliding_window_view(wide, tests.width)[at])
    order = np.argsort(suffixes, kind="stable")
    suffixes = suffixes[order]
    low, high = np.searchsorted(suffixes, tests.low, "left"), np.searchsorted(suffixes, tests.low, "right")
    high[tests.short] = np.searchsorted(suffixes, tests.high, "right")
    count = high - low
    window = np.repeat(np.arange(len(count)), count)
    entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return at[order[entry]], window


def occurrences(numbers: np.ndarray, bounds: np.ndarray, text: bytes, starts: np.ndarray, tests: Tests):
    """(position, window, document) of the occurrences that lie within a document and have the window's very words."""
    position, window = search(numbers, tests)
    size = tests.sizes[window]
    doc = np.searchsorted(bounds, position, side="right") - 1
    inside = position + size <= bounds[doc + 1] if len(position) else np.zeros(0, bool)
    position, window, size, doc = position[inside], window[inside], size[inside], doc[inside]
    same = np.fromiter((text[starts[p] : starts[p + n] - 1] == tests.window(w) for p, n, w in zip(position.tolist(), size.tolist(), window.tolist(), strict=True)), bool, len(position))
    return position[same], window[same], doc[same]


def extended(position: np.ndarray, window: np.ndarray, tests: Tests):
    """Longest verbatim matches of the occurrences: arrays (position, item, place in the item, words)."""
    n = tests.bounds[window + 1] - tests.bounds[window]
    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(tests.bounds[window], n)
    p, item, place, size = np.repeat(position, n), tests.item[each], tests.place[each], np.repeat(tests.sizes[window], n)
    order = np.lexsort((p, p - place, item))
    p, item, place, size = p[order], item[order], place[order], size[order]
    new = np.ones(len(p), bool)
    new[1:] = (item[1:] != item[:-1]) | (p[1:] - place[1:] != p[:-1] - place[:-1]) | (p[1:] != p[:-1] + 1)
    cut = np.flatnonzero(new)
    return p[cut], item[cut], place[cut], np.diff(np.append(cut, len(p))) - 1 + size[cut]


def shards(batches, tests: Tests, size: int):
    """(numbers, first word of each document and the end, words in a row, where each starts, doc_ids, rids) of a MB of documents each."""
    for batch in batches:
        data, starts, ends = C.strings(batch.column("text"))
        ids, rids = batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist()
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + size)))
            words, bounds = [], [0]
            for i in range(a, b):
                words += C.plain_words(bytes(data[starts[i] : ends[i]]))
                bounds.append(len(words))
            text, at, hashes = C.word_hashes(words)
            yield tests.numbers(hashes), np.array(bounds), text, at, ids[a:b], rids[a:b]
            a = b


def blocks(benchmark: DataFrame, width: int, size: int):
    """The test items in blocks of at most about size bytes."""
    items, held = [], 0
    for item, text in benchmark.selectExpr("item_id", "cast(text as string) text").toLocalIterator():
        items.append((item, text))
        held += len(text or "")
        if held >= size:
            yield Tests(items, width)
            items, held = [], 0
    yield Tests(items, width)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", C.row_id())


def _find(shared):
    def run(batches):
        C.held("tests")
        tests = shared.value
        for numbers, bounds, text, at, ids, rids in shards(batches, tests, SHARD):
            position, window, doc = occurrences(numbers, bounds, text, at, tests)
            edge = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(edge, position, 1)
            np.add.at(edge, position + tests.sizes[window], -1)
            hit = np.cumsum(edge[:-1]) > 0
            names: dict[int, set] = {}
            for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
                names.setdefault(d, set()).update(tests.names[k] for k in tests.item[tests.bounds[w] : tests.bounds[w + 1]].tolist())
            hits = [np.packbits(hit[a:b]).tobytes() if d in names else b"" for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]
            items = [sorted(n for n in names.get(d, ()) if n is not None) for d in range(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rids, pa.int64()), pa.array(np.diff(bounds)), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "rid", "n_words", "hits", "items"])

    return run


@F.pandas_udf(T.BinaryType())
def _union(hits):
    import pandas as pd

    def one(parts):
        size = max(map(len, parts), default=0)
        out = np.zeros(size, np.uint8)
        for p in parts:
            if len(p):
                out |= np.frombuffer(p, np.uint8)
        return out.tobytes()

    return pd.Series([one(list(h)) for h in hits])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, rid, n_words, hits, items): hits has a bit a word, items the sorted ids of found items."""
    rows, parts, spark = _rows(docs), [], docs.sparkSession
    last = None
    for tests in blocks(benchmark, width, block):
        if last is not None:  # a test set of several blocks: each pass is stored, then merged
            parts.append(C.stored(rows.mapInArrow(C.tidied(_find(last)), FOUND), "found"))
            last.unpersist()
        last = spark.sparkContext.broadcast(tests)  # arrays of at most some 30 times the block's bytes
    final = rows.mapInArrow(C.tidied(_find(last)), FOUND)
    parts.append(C.stored(final, "found") if parts else final)
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    # repeated rows come once a block each: equal rows of one block are counted and given back
    one = every.groupBy("doc_id", "rid").agg(F.max("n_words").alias("n_words"), F.collect_set("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.expr(f"count(*) div {len(parts)}").alias("copies"))
    return one.withColumn("hits", _union("hits")).selectExpr("explode(sequence(1, copies)) copy", "*").select("doc_id", "rid", "n_words", "hits", "items")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """What the contamination of each document amounts to."""
    found = contamination(docs, benchmark, width)
    # ones of a bitmap: those of each of its hex digits
    ones = F.expr("aggregate(transform(regexp_extract_all(hex(hits), '.', 0), d -> int(substr('0112122312232334', instr('0123456789ABCDEF', d), 1))), 0L, (s, x) -> s + x)")
    return found.select("doc_id", "n_words", F.when(F.length("hits") > 0, ones).otherwise(F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Rows (item_id, item_word, doc_id, doc_word, words): every maximal verbatim match of at least a window."""
    rows, every = _rows(docs), None
    for tests in blocks(benchmark, width, block):

        def run(batches, shared=docs.sparkSession.sparkContext.broadcast(tests)):
            tests = shared.value
            for numbers, bounds, text, at, ids, _ in shards(batches, tests, SHARD):
                position, window, _ = occurrences(numbers, bounds, text, at, tests)
                p, item, place, words = extended(position, window, tests)
                doc = np.searchsorted(bounds, p, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([tests.names[k] for k in item.tolist()], pa.string()), pa.array(place), pa.array([ids[d] for d in doc.tolist()], pa.int64()), pa.array(p - bounds[doc]), pa.array(words)], names=["item_id", "item_word", "doc_id", "doc_word", "words"])

        part = C.stored(rows.mapInArrow(run, "item_id string, item_word long, doc_id long, doc_word long, words long"), "matches")
        every = part if every is None else every.unionByName(part)
    return every


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """docs without the documents that have a hit word; all columns stay as they are. With several blocks what each leaves is stored."""
    kept, last = docs.withColumn("text", F.col("text").cast("string")), None

    def without(kept, shared):
        def run(batches):
            for batch in batches:
                rid = pa.array(np.arange(batch.num_rows))
                whole = pa.RecordBatch.from_arrays([rid, batch.column("text"), rid], names=["doc_id", "text", "rid"])
                bad = np.zeros(batch.num_rows, bool)
                for found in _find(shared)(iter([whole])):
                    ids = np.asarray(found.column("doc_id"))
                    bad[ids] |= np.fromiter((len(h) > 0 for h in found.column("hits").to_pylist()), bool, len(ids))
                yield batch.filter(pa.array(~bad))

        return kept.mapInArrow(C.tidied(run), kept.schema)

    for tests in blocks(benchmark, width, block):
        if last is not None:
            kept = C.stored(without(kept, last), "kept")
            last.unpersist()
        last = docs.sparkSession.sparkContext.broadcast(tests)
    return without(kept, last).select(*docs.columns)
