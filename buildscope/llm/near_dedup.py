"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its shingles of five words: a shingle weighs its count in
the text times 1 + ln(1 + x) / ln(1 + X), where x = N / df, at most RAREST, and X is the
most that x can be; so a rare one weighs twice as much as one of all, at any size of the
corpus. A bare ln(1 + N / df) would count against copies how many there are: of two texts of
150 words that differ in two, the similarity falls from 0.87 to 0.78 once some thousands of
copies share the rest.

Document frequencies come from a count sketch (DEPTH rows of WIDTH counters, the least row
counts), filled over all documents; it never underestimates. Its error is a share of N that
does not grow with N (the distinct shingles a document over WIDTH, some 1 / 26,000), and a
shingle of fewer than N / RAREST documents counts as one of so many, so the sketch's size
need not follow the corpus: weights tell shares of the documents apart, not counts.

Each text gets BANDS * ROWS consistent weighted samples. A sample draws r and c of a
Gamma(2, 1) and b of a uniform distribution for every shingle, and keeps the shingle with
the least ln c - r (t - b) - r, where t = floor(ln w / r + b), together with t. Two texts
agree in a sample with a probability of their weighted Jaccard similarity. The draws come
from tables of 2**16 quantiles, indexed by a hash of shingle and sample.

Texts that agree in all samples of a band are candidates. Candidates are compared with
their true weights, and linked at a similarity of THRESHOLD or more; a class is a
component of links. Candidates of a band value are first compared with one of them: with
the one that meets most others over all bands, which in a group of near copies is their
common original or near it, then with others by hash. A round takes only values whose
candidates are still in several classes. After STARS rounds candidates in different classes
are compared with each other if they can be similar: in one order of all shingles, from rare
to frequent, the first shingles of a text, so many that the rest weighs less than THRESHOLD
of it, are its prefix; two texts whose prefixes share nothing, or whose total weights are
too far apart, are below THRESHOLD whatever else they share, and so are two of which the
weight from the first shared shingle on is too small. So no link between candidates
is lost, a group of any size in which most texts are alike costs as many comparisons as it
has texts, not pairs, and texts that only share a frequent passage are not compared.

Texts are kept compressed in a table that is bucketed by node, so a round shuffles the texts
of one side of its pairs only. What a round stores is deleted when it is no longer read.

Equal texts are one node from the start and never compared. Defined cases: a null text or
one without a word is a class of its own, copies included; texts of fewer than five words
are one shingle; extra columns are ignored by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .superkmer import compressed, compressor, decompressor, dictionary
from .superkmer import texts as unsqueezed
from .tables import packed, summed, unpacked

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 4
DEPTH, WIDTH = 2, 1 << 21
RAREST = 1 << 14
STARS = 2
#: Shingles before its own that a row of a prefix carries, by which two texts that share an earlier one know it.
BEFORE = 8
#: Shingles of texts already weighed that a task keeps for further pairs; 16 bytes each.
HELD = 1 << 21


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the text's shingles in order."""
    words = C.plain_words((text or "").encode())
    if not words:
        return np.zeros(0, np.uint64)
    h = C.prefix_hash(C.word_hashes(words)[2])
    n = max(1, len(words) - SHINGLE + 1)
    at = np.arange(n)
    return C.span_hash(h, at, np.minimum(at + SHINGLE, len(words)))


def slots(kinds: np.ndarray) -> list[np.ndarray]:
    return [((kinds >> np.uint64(21 * d)) & np.uint64(WIDTH - 1)).astype(np.int64) for d in range(DEPTH)]


def fill_sketch(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and the sketch of their shingles' document frequencies."""

    def count(batches):
        C.held("sketch")
        table, n = np.zeros((DEPTH, WIDTH), np.uint32), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column("text").to_pylist():
                for d, at in enumerate(slots(np.unique(shingles(text)))):
                    np.add.at(table[d], at, np.uint32(1))
        return [table.ravel(), np.array([n])]

    sketch, n = summed(docs.select("text"), count, [(DEPTH * WIDTH, np.uint32), (1, np.int64)])
    return int(n[0]), sketch.reshape(DEPTH, WIDTH)


class Weights:
    """Weighs shingles by the sketch; sent to the tasks as a broadcast of the sketch's fixed size."""

    def __init__(self, spark, n: int, sketch: np.ndarray):
        self.n, self.key = n, C.shared_path(spark, "sketch")
        self.shared = spark.sparkContext.broadcast(packed(sketch))

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles and their weights."""
        return self.counted(text)[:2]

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles, their weights and document frequencies."""
        table = C.held(self.key, lambda: unpacked(self.shared.value, np.uint32).reshape(DEPTH, WIDTH))
        kinds, tf = np.unique(shingles(text), return_counts=True)
        df = np.minimum.reduce([table[d][at] for d, at in enumerate(slots(kinds))]) if len(kinds) else np.zeros(0)
        most = min(max(self.n, 1), RAREST)
        return kinds, tf * (1 + np.log1p(np.minimum(self.n / np.maximum(df, 1), most)) / np.log1p(most)), df


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of -ln(u v), a Gamma(2, 1) variate, and their logarithms."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    lo, hi = np.zeros(len(u)), np.full(len(u), 60.0)
    for _ in range(60):  # invert 1 - exp(-x) (1 + x)
        mid = (lo + hi) / 2
        less = -np.expm1(-mid) - mid * np.exp(-mid) < u
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    return lo.astype(np.float32), np.log(lo).astype(np.float32)


GAMMA, LOG_GAMMA = _tables()
MULTIPLIERS = C.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def samples(kinds: np.ndarray, weights: np.ndarray, step: int = 4096) -> np.ndarray:
    """A 64-bit value for each sample: of the shingle kept and its t."""
    log_w = np.log(weights).astype(np.float32)
    best, value = None, None
    for a in range(0, len(kinds), step):
        u = kinds[a : a + step, None] * MULTIPLIERS
        u ^= u >> np.uint64(29)
        u *= np.uint64(0xBF58476D1CE4E5B9)
        r = GAMMA[u >> np.uint64(48)]
        beta = ((u >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65536)
        t = np.floor(log_w[a : a + step, None] / r + beta)
        cost = LOG_GAMMA[(u >> np.uint64(32)) & np.uint64(0xFFFF)] - r * (t - beta) - r
        least = cost.argmin(axis=0)
        k = np.arange(len(least))
        got = C.mix(kinds[a + least] ^ C.mix(t[least, k].astype(np.int64).view(np.uint64)))
        own = cost[least, k]
        if best is None:
            best, value = own, got
        else:
            new = own < best
            best, value = np.where(new, own, best), np.where(new, got, value)
    return value


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two sets of shingles."""
    total = a[1].sum() + b[1].sum()
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (total - both)) if total else 0.0


def node() -> Column:
    """16 bytes that stand for a text; a row's own if it has no word."""
    own = F.concat_ws(":", F.lit("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.lit("text")), F.coalesce("text", F.lit("")))
    key = F.when(F.coalesce(F.col("text"), F.lit("")).rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]"), F.col("text")).otherwise(own)
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


def signatures(rows: DataFrame, weigh: Weights) -> DataFrame:
    """Rows (node, bands): a 64-bit value a band; texts without words have none."""

    def run(batches):
        for batch in batches:
            nodes, out = [], []
            for key, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                kinds, w = weigh(text)
                if not len(kinds):
                    continue
                got = samples(kinds, w).reshape(BANDS, ROWS)
                band = np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    band = C.mix(band * np.uint64(C.BASE) + got[:, k])
                nodes.append(key), out.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["node", "bands"])

    return rows.select("node", "text").mapInArrow(C.tidied(run), "node binary, bands array<long>")


def prefix(kinds: np.ndarray, weights: np.ndarray, df: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The least set of first shingles, from rare to frequent, that leaves less than threshold of the weight, and the weight from each on.

    Those of one document are left out of it: the sketch never underestimates, so no other text has them.
    """
    order = np.lexsort((kinds, df))
    own = weights[order]
    rest = weights.sum() - np.cumsum(own)
    n = int(np.argmax(rest < threshold * weights.sum() * (1 - 1e-9))) + 1
    shared = df[order[:n]] > 1
    return kinds[order[:n]][shared], (rest + own)[:n][shared]


def prefixes(texts: DataFrame, weigh: Weights, threshold: float, shared) -> DataFrame:
    """Rows (node, total, shingle, onward, before): a text's weight, each shingle of its prefix, the weight from that on and up to BEFORE shingles before it."""

    def run(batches):
        coder = decompressor(shared.value)
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                kinds, w, df = weigh.counted(coder.decompress(text).decode())
                found, onward = prefix(kinds, w, df, threshold)
                n = len(found)
                found = found.view(np.int64)
                size = np.minimum(np.arange(n), BEFORE)
                ends = np.concatenate([[0], np.cumsum(size)])
                at = np.arange(ends[-1]) - np.repeat(ends[:-1] + size - np.arange(n), size)
                before = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[at]))
                yield pa.RecordBatch.from_arrays([pa.array([node] * n, pa.binary()), pa.array(np.full(n, w.sum())), pa.array(found), pa.array(onward), before], names=["node", "total", "shingle", "onward", "before"])

    return texts.select("node", "text").mapInArrow(C.tidied(run), "node binary, total double, shingle long, onward double, before array<long>")


def undecided_pairs(left: DataFrame, texts: DataFrame, weigh: Weights, threshold: float, shared) -> DataFrame:
    """Pairs (node, other) of left's nodes in different classes that can be similar.

    Of each shingle the class with most texts is not joined with itself, so a large group
    that is linked already costs its rows. A pair is left out at a shingle before which both
    texts carry a common one: at the first they share it is never left out, as that has
    no common one before it.
    """
    labels = left.select("node", "label").distinct()
    own = C.stored(prefixes(texts.join(labels.select("node"), "node", "left_semi"), weigh, threshold, shared).join(labels, "node"), "prefixes")
    main = own.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    own = own.join(main, "shingle")
    other = own.withColumnsRenamed({"node": "other", "label": "other_label", "total": "other_total", "onward": "other_onward", "before": "other_before"}).drop("main")
    can = F.least("onward", "other_onward") >= F.lit(threshold / (1 + threshold) * (1 - 1e-9)) * (F.col("total") + F.col("other_total"))
    one = (F.col("label") < F.col("other_label")) | (F.col("other_label") == F.col("main"))  # a pair with the main class once only
    first = ~F.arrays_overlap("before", "other_before")
    return own.where("label != main").join(other, "shingle").where((F.col("label") != F.col("other_label")) & one & can & first).select("node", "other")


def compared(pairs: DataFrame, texts: DataFrame, weigh: Weights, threshold: float, shared) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar enough."""
    one = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "x"}), "a")
    both = one.join(texts.withColumnsRenamed({"node": "b", "text": "y"}), "b").select("a", "b", "x", "y")

    def run(batches):
        known: dict[bytes, tuple] = {}
        size, coder = 0, decompressor(shared.value)

        def weighed(key, text):
            nonlocal size
            if key not in known:
                if size > HELD:
                    known.clear()
                    size = 0
                known[key] = weigh(coder.decompress(text).decode())
                size += len(known[key][0])
            return known[key]

        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            keep = [similarity(weighed(i, s), weighed(j, t)) >= threshold for i, j, s, t in zip(a, b, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(C.tidied(run), "a binary, b binary")


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """df as a table of the session's warehouse with a bucket a shuffle partition, dealt by column."""
    import uuid

    spark, n = df.sparkSession, C.shuffle_partitions(df.sparkSession)
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, column).write.bucketBy(n, column).sortBy(column).saveAsTable(table)
    out = spark.table(table)
    out._table = table
    return out


def squeezed(rows: DataFrame, shared) -> DataFrame:
    """rows (node, text) with text compressed."""

    def run(batches):
        coder = compressor(shared.value, 3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([coder.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["node", "text"])

    return rows.select("node", "text").mapInArrow(C.tidied(run), "node binary, text binary")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, rid, label, class_id, class_size): label names the row's class, class_id is its least doc_id, which two classes may share."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weigh = Weights(docs.sparkSession, *fill_sketch(rows))
    keyed = rows.withColumn("node", node())
    # read twice below, so stored: its samples are the operator's largest cost
    every = C.stored(signatures(keyed, weigh).groupBy("node").agg(F.first("bands").alias("bands")), "signatures")
    banded = every.select("node", F.explode("bands").alias("band"))
    # the values of two nodes or more, the nodes of which are compared
    shared = banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("band")
    met = banded.join(shared, "band").groupBy("band").agg(F.count(F.lit(1)).alias("met"))
    members = banded.join(met, "band")
    members = C.stored(members.join(members.groupBy("node").agg(F.sum("met").alias("score")), "node").select("band", "node", "score"), "members")
    nodes = members.select("node").distinct()
    shared = dictionary(rows)
    texts = bucketed(squeezed(keyed, shared).join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "node", "texts")
    links, tried, labels, left = None, None, None, members.withColumn("label", F.col("node"))
    for turn in range(STARS + 1):
        if turn < STARS:  # every node with one of its value's
            order = F.struct(-F.col("score") if turn == 0 else F.xxhash64(F.lit(turn), "node"), "node")
            centre = left.groupBy("band").agg(F.min_by(F.struct("node", "label"), order).alias("centre"))
            pairs = left.join(centre, "band").where("label != centre.label").select("node", F.col("centre.node").alias("other"))
        else:  # all that are in different classes and can be similar
            pairs = undecided_pairs(left, texts, weigh, threshold, shared)
        pairs = pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = C.stored(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = C.stored(compared(pairs, texts, weigh, threshold, shared), "links")
        links = found if links is None else links.unionByName(found)
        C.forget(labels)
        labels = C.stored(components(links), "labels")
        now = members.join(labels, "node", "left").select("band", "node", "score", F.coalesce("label", "node").alias("label"))
        split = now.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band")
        C.forget(left)
        left = C.stored(now.join(split, "band"), "left")
        if left.isEmpty():
            break
    ids = keyed.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "node").join(labels, "node", "left").select("doc_id", "rid", F.coalesce("label", "node").alias("label"))
    ids = C.stored(ids, "classes")
    C.forget(every, members, left, labels)
    docs.sparkSession.sql(f"drop table {texts._table}")
    return ids.join(ids.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "label").select("doc_id", "rid", F.hex("label").alias("label"), "class_id", "class_size")


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without all but one row of each class: that of the least doc_id, nulls last, and of its texts that with the least rid.

    Whole texts travel once, compressed: the ids that are kept and rows that repeat meet them at the same keys.
    """
    docs, names = C.set_apart(docs, ("doc_id", "text"))
    own = classes(docs, threshold)
    identity = lambda c: F.coalesce(c, F.lit(C.NULL_ID))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first")
    kept = own.groupBy("label").agg(first).select(identity(F.col("first.doc_id")).alias("__id"), F.col("first.rid").alias("__rid"))
    rows = docs.withColumn("text", F.col("text").cast("string"))
    key = rows.withColumn("__rid", F.xxhash64(F.col("doc_id").cast("long"), "text")).withColumn("__id", identity(F.col("doc_id").cast("long")))
    shared = dictionary(rows)
    out = compressed(key, shared).join(kept.hint("merge"), ["__id", "__rid"], "left_semi").dropDuplicates(["__id", "__rid"]).select(*docs.columns)

    def restore(batches):
        coder = decompressor(shared.value)
        for batch in batches:
            text = pa.array([None if t is None else t.decode() for t in unsqueezed(batch, coder)], pa.string())
            yield pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return C.set_back(out.mapInArrow(C.tidied(restore), rows.schema).withColumn("text", F.col("text").cast(docs.schema["text"].dataType)), names)
