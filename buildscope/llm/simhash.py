"""Near-duplicates by SimHash and a hierarchical index over fingerprints in Gray order.

Fingerprints of 64 bits are made once a document; only distinct ones are indexed. They are
sorted by their rank in the Gray code, where neighbours tend to share bits, and cut into blocks. A
node of the index knows its pattern: which bits all fingerprints below it share, and their values;
blocks, groups of FAN blocks and so on up are nodes, and so are groups of LEAF * STEP and of LEAF
fingerprints within a block. The index is searched for all its own fingerprints at once, group against
group, from the top down: a pair of nodes adds to the differences of the pair above it those in the
bits that its patterns share beyond that pair's, and beyond `distance` differences all below is
left out. So no link is lost, and work follows the pairs of groups that may be near. Nodes above
the blocks are met by joins; two blocks that may be near are compared in one task, which
sends on links that connect what was not connected there: no more than it has fingerprints.
Components are found over these links between distinct fingerprints.

Defined cases: a null text or one without a word has the fingerprint zero, linked like any
other; fewer words than a shingle's are one shingle; equal rows get equal results; a null doc_id
comes after all others, and a component of such only has a null component_id; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Fingerprints of a block, about; blocks or nodes of a node above; fingerprints of a lowest node; such nodes of one above it in a block.
BLOCK, FAN, LEAF, STEP = 1 << 14, 64, 8, 8
#: Bytes of a text that are split into words at a time; pairs of nodes that are expanded at a time.
PIECE, PAIRS = 1 << 20, 1 << 15
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of so many words, joined by spaces."""
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = len(words) - shingle + 1
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """In how many of the values each bit is set."""
    rows = h.view(np.uint8).reshape(-1, 8)
    if len(rows) < 512:
        return np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BITS for k in range(8)])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The text's fingerprint, unsigned; a text is read PIECE bytes at a time."""
    data = (text or "").encode().lower()
    at, n, counts, words = 0, 0, np.zeros(64, np.int64), []
    while at < len(data):
        end = len(data) if at + PIECE >= len(data) else next((m.start() for m in [_SPACE.search(data, at + PIECE)] if m), len(data))
        words += data[at:end].split()
        at = end
        if len(words) >= shingle:
            h = hashes(words, shingle)
            n, counts, words = n + len(h), counts + bit_counts(h), words[len(words) - shingle + 1 :]
    if not n and words:
        h = hashes(words, len(words))
        n, counts = 1, bit_counts(h)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, print): the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "print"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, print long")


def gray_rank(bits: Column) -> Column:
    """Place of a value in the Gray code's order, as a long whose order as a signed number is that of the places."""
    for n in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, n))
    return bits.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def indexed(prints: DataFrame, n: int, block: int) -> DataFrame:
    """The n distinct prints in blocks by Gray rank: rows (part, place, ones, some, prints), ones the bits set in all, some those set in any."""

    def run(batches):
        part, place, held, n = TaskContext.get().partitionId(), 0, [], 0

        def out(values):
            own = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([place], pa.int64()), pa.array([np.bitwise_and.reduce(values)]), pa.array([np.bitwise_or.reduce(values)]), pa.array([values.tobytes()], pa.binary())], names=["part", "place", "ones", "some", "prints"])
            return own

        for batch in batches:
            held.append(np.asarray(batch.column("print")))
            n += len(held[-1])
            while n > 2 * block:
                values = np.concatenate(held)
                yield out(values[:block])
                place, held, n = place + 1, [values[block:]], n - block
        if n:
            yield out(np.concatenate(held))

    dealt = prints.withColumn("rank", gray_rank(F.col("print"))).repartitionByRange(max(1, -(-n // block)), "rank").sortWithinPartitions("rank")
    return dealt.select("print").mapInArrow(run, "part long, place long, ones long, some long, prints binary")


def near_blocks(blocks: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b, ...) of block numbers, a <= b, whose patterns differ in no more than distance bits; blocks: (number, ones, some)."""
    spark = blocks.sparkSession
    most = blocks.agg(F.max("number")).first()[0]
    levels = 1
    while FAN**levels <= most:
        levels += 1
    pairs = spark.createDataFrame([(0, 0, 0, 0)], "a long, b long, differ int, known long")
    for level in reversed(range(levels)):
        nodes = blocks.groupBy(F.expr(f"number div {FAN**level}L").alias("node")).agg(F.bit_and("ones").alias("ones"), F.bit_or("some").alias("some"))
        nodes = nodes.select("node", F.expr(f"node div {FAN}L").alias("above"), "ones", F.expr("~(ones ^ some)").alias("mask"))
        one = nodes.selectExpr("node as a1", "above as a", "ones as bits_a", "mask as mask_a")
        two = nodes.selectExpr("node as b1", "above as b", "ones as bits_b", "mask as mask_b")
        added = F.expr("differ + bit_count((bits_a ^ bits_b) & mask_a & mask_b & ~known)")
        met = pairs.join(one, "a").join(two, "b").where((F.col("a1") <= F.col("b1")) & (added <= distance))
        pairs = met.select(F.col("a1").alias("a"), F.col("b1").alias("b"), added.cast("int").alias("differ"), F.expr("mask_a & mask_b").alias("known"))
    return pairs


class Nodes:
    """The lower levels of a block: the bits and masks of groups of LEAF * STEP, of groups of LEAF, and the fingerprints."""

    def __init__(self, prints: bytes):
        self.prints = np.frombuffer(prints, np.uint64)
        self.levels = [self.patterns(LEAF * STEP), self.patterns(LEAF), (self.prints, np.full(len(self.prints), ~np.uint64(0)))]

    def patterns(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.arange(0, len(self.prints), size)
        ones, some = np.bitwise_and.reduceat(self.prints, starts), np.bitwise_or.reduceat(self.prints, starts)
        return ones, ~(ones ^ some)


def expanded(i: np.ndarray, j: np.ndarray, step: int, ni: int, nj: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of children of the pairs of nodes, and which pair each is of."""
    k = np.arange(step)
    a = (i[:, None, None] * step + k[:, None] + 0 * k).reshape(-1)
    b = (j[:, None, None] * step + k + 0 * k[:, None]).reshape(-1)
    of = np.repeat(np.arange(len(i)), step * step)
    there = (a < ni) & (b < nj)
    return a[there], b[there], of[there]


def near(one: Nodes, two: Nodes, same: bool, distance: int):
    """Pairs of places of fingerprints within distance, some at a time; of a block with itself, each pair once."""
    (bits, mask), (bits2, mask2) = one.levels[0], two.levels[0]
    rows = max(1, PAIRS * 16 // max(1, len(bits2)))
    for top in range(0, len(bits), rows):
        known = mask[top : top + rows, None] & mask2
        differ = np.bitwise_count((bits[top : top + rows, None] ^ bits2) & known)
        i, j = np.nonzero(differ <= distance)
        state = [(i + top, j, differ[i, j], known[i, j])]
        if same:
            keep = state[0][0] <= j
            state = [tuple(x[keep] for x in state[0])]
        for level, step in ((1, STEP), (2, LEAF)):
            state = [s for i, j, differ, known in state for s in below(one, two, level, step, i, j, differ, known, same, distance)]
        for i, j, *_ in state:
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def below(one, two, level, step, i, j, differ, known, same, distance):
    """The pairs of the next level that are still within distance."""
    (bits, mask), (bits2, mask2) = one.levels[level], two.levels[level]
    for at in range(0, len(i), PAIRS):
        a, b, of = expanded(i[at : at + PAIRS], j[at : at + PAIRS], step, len(bits), len(bits2))
        of += at
        both = mask[a] & mask2[b]
        total = differ[of] + np.bitwise_count((bits[a] ^ bits2[b]) & both & ~known[of])
        keep = total <= distance
        if same:
            keep &= a <= b
        yield a[keep], b[keep], total[keep], both[keep]


class Forest:
    """Keeps the links that connect what was not connected."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Of the links (i, j) a part that connects as much."""
        root, n = self.root, len(self.root)
        apart = root[i] != root[j]
        if not apart.any():
            return []
        pairs = np.unique(np.minimum(root[i], root[j])[apart] * n + np.maximum(root[i], root[j])[apart])
        up, out = root.tolist(), []
        for p in pairs.tolist():
            a, b = divmod(p, n)
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append(divmod(p, n))
        self.root = np.array(up)
        while (self.root != (up := self.root[self.root])).any():
            self.root = up
        return out


def links(pairs: DataFrame, blocks: DataFrame, distance: int) -> DataFrame:
    """Rows (a, b): links within distance between fingerprints of the pairs of blocks, of each pair so many as connect the same."""

    def run(batches):
        for batch in batches:
            found = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                one, two = Nodes(x), Nodes(y)
                n = len(one.prints)
                values = np.concatenate([one.prints, two.prints]).view(np.int64)
                forest = Forest(len(values))
                for i, j in near(one, two, a == b, distance):
                    found += [(values[u], values[v]) for u, v in forest.add(i, j if a == b else j + n)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["a", "b"])

    held = blocks.select("number", "prints")
    both = pairs.select("a", "b").join(held.withColumnsRenamed({"number": "a", "prints": "x"}), "a").join(held.withColumnsRenamed({"number": "b", "prints": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linked(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Rows (a, b): links that connect all that is within distance among the distinct values of prints (column print), over any number of steps."""
    n = prints.count()
    if not n:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    blocks = C.stored(indexed(prints, n, block), "blocks")
    wide = blocks.agg(F.max("place")).first()[0] + 1
    blocks = blocks.withColumn("number", F.col("part") * wide + F.col("place"))
    return links(near_blocks(blocks.select("number", "ones", "some"), distance), blocks, distance)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id): the fingerprint in hex, and the least doc_id reachable over links."""
    own = C.stored(fingerprints(docs, shingle), "fingerprints")
    every = C.stored(own.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct")
    found = C.stored(linked(every.select("print"), distance, block), "links")
    label = components(found)
    joined = every.join(label.withColumnRenamed("node", "print"), "print")
    least = joined.groupBy("label").agg(F.min("first").alias("least"))
    moved = joined.join(least, "label").select("print", "least")
    ids = every.join(moved, "print", "left").select("print", F.coalesce("least", "first").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return own.join(ids, "print").select("doc_id", hexed.alias("fingerprint"), "component_id")
