"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is read as its tokens (lower-cased A-Z, white space between them as one space) and
an end. Bytes become 64 symbols, the 62 most frequent ones, an escape for the others (its
byte then costs 8 bits) and the end; a symbol is a path of bits in a Huffman tree. Each
bit is predicted from the node of the tree and from hashes of three contexts: the 3 and
the 5 symbols before, and the word so far. Their counters were learned from the training
documents.

A predictor says its stretched probability in 16 steps and its confidence in 4. Gates
(the node's depth and the confidences of the 5 symbols and the word) choose the weights with
which the stretched probabilities are added; the weights are refined by steps of logistic
regression over the counts of what the predictors said and which bit came. The mix is
refined once more towards the frequency seen for the same sayings, the more the oftener
they were seen. All of that holds for any order of the documents, so training runs on all
machines at once. The training documents of three folds fill the counters; those of the
fourth are read next, their sayings by these counters are counted, so that weights come
from text that the counters have not seen, and then they are added to the counters too. A
last pass scores. Tables have fixed sizes and are summed over tasks; the counters cover
the whole training text.

Beside it the score of a unigram model with add-one smoothing is computed: the words of a
flush of documents travel, by word, with their counts and the places of their documents,
and what comes back for each document is the sum over its words.

Defined cases: a null or empty text is the end alone; a null doc_id is learned from; equal
texts get equal scores; other columns are ignored by name.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .superkmer import pack, unpack
from .tables import packed, summed, unpacked

SYMBOLS, ESCAPE, END = 64, 62, 63
#: Symbols before the place that a context has; 0: the word so far.
ORDERS = (3, 5, 0)
#: log2 of the number of contexts that a table tells apart.
SLOTS = (16, 17, 18)
#: One training document in so many is kept from the counters until the sayings are counted.
FOLDS = 4
STARTS = tuple(int(x) for x in np.cumsum([0] + [SYMBOLS << b for b in SLOTS]))
PAD = max(ORDERS)
#: Bytes of text coded at a time, and gathered before words are sent.
CHUNK, FLUSH = 1 << 17, 12 << 20
CELLS = 8 << 16
#: White space that divides tokens, and lower case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_tables: dict[str, tuple] = {}


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


# ---------------------------------------------------------------- unigram base


def _send_words(parts: int, subs: int):
    def run(batches):
        task, serial = TaskContext.get().partitionId() << 32, 0
        held: list = []
        size = 0

        def flush():
            nonlocal serial
            here = task | serial
            serial += 1
            docs = [h[3] for h in held]
            counts = np.fromiter(map(len, docs), np.int64, len(docs))
            words = [w for d in docs for w in d]
            train = np.array([not h[2] for h in held])
            letters = np.bincount(np.frombuffer(b" ".join([b" ".join(d) for d, t in zip(docs, train, strict=True) if t]), np.uint8), minlength=256)
            out = [(0, -1, 1, here, pack({"id": np.array([C.NULL_ID if h[0] is None else h[0] for h in held], np.int64), "null": np.array([h[0] is None for h in held], np.uint8), "rid": np.array([h[1] for h in held], np.int64), "held": (~train).astype(np.uint8), "n": counts, "letters": letters.astype(np.int64)}, b""))]
            out[0] = (here % parts, *out[0][1:])
            if words:
                known = {w: i for i, w in enumerate(dict.fromkeys(words))}
                ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                kinds = list(known)
                key, n = np.unique(ids * len(docs) + np.repeat(np.arange(len(docs)), counts), return_counts=True)
                word, doc = np.divmod(key, len(docs))
                learned = np.bincount(word, np.where(train[doc], n, 0), len(kinds)).astype(np.int64)
                where = (C.word_hashes(kinds)[2] % np.uint64(parts * subs)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                first = np.searchsorted(word, np.arange(len(kinds) + 1))
                for idx in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                    span = first[idx + 1] - first[idx]
                    at = np.repeat(first[idx] - (np.cumsum(span) - span), span) + np.arange(span.sum())
                    blob = pack({"learned": learned[idx].astype(np.uint32), "docs": span.astype(np.uint32), "doc": doc[at].astype(np.uint32), "n": n[at].astype(np.uint32)}, b" ".join([kinds[i] for i in idx.tolist()]))
                    sub = int(where[idx[0]])
                    out.append((sub // subs, sub, 0, here, blob))
            kinds_ = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds_, strict=True)], names=["pid", "sub", "kind", "flush", "blob"])

        for batch in batches:
            data, starts, ends = C.strings(batch.column("text"))
            for doc, rid, out_, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), batch.column("held").to_pylist(), starts.tolist(), ends.tolist(), strict=True):
                held.append((doc, rid, out_, tokens(bytes(data[a:b]))))
                size += b - a + 64
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


WORDS = {"learned": np.uint32, "docs": np.uint32, "doc": np.uint32, "n": np.uint32}
DOCS = {"id": np.int64, "null": np.uint8, "rid": np.int64, "held": np.uint8, "n": np.int64, "letters": np.int64}
SUMS = {"doc": np.uint32, "known": np.uint32, "log": np.float64}


def _count_words(batches):
    """Per flush and bucket, each document's sum of log10(c + 1) and number of known tokens; kind 2 has c's totals."""

    def bucket(sub, blobs):
        got = [unpack(b, WORDS) for _, b in blobs]
        words = [text.split(b" ") for _, text in got]
        total: dict[bytes, int] = {}
        for (columns, _), ws in zip(got, words, strict=True):
            for w, n in zip(ws, columns["learned"].tolist(), strict=True):
                if n:
                    total[w] = total.get(w, 0) + n
        out = [(2, -1 - sub, pack({"total": np.array([sum(total.values()), len(total)], np.int64)}, b""))]
        for (flush, _), (columns, _), ws in zip(blobs, got, words, strict=True):
            c = np.fromiter((total.get(w, 0) for w in ws), np.int64, len(ws))
            per, doc = np.repeat(c, columns["docs"]), columns["doc"]
            log = np.bincount(doc, np.log10(per + 1.0) * columns["n"])
            known = np.bincount(doc, np.where(per > 0, columns["n"], 0))
            at = np.flatnonzero(np.bincount(doc))
            out.append((0, flush, pack({"doc": at.astype(np.uint32), "known": known[at].astype(np.uint32), "log": log[at]}, b"")))
        return _batch(out)

    current, blobs = None, []
    for batch in batches:
        for sub, kind, flush, blob in zip(*(batch.column(c).to_pylist() for c in ("sub", "kind", "flush", "blob")), strict=True):
            if kind == 1:
                yield _batch([(1, flush, blob)])
                continue
            if sub != current and blobs:
                yield bucket(current, blobs)
                blobs = []
            current = sub
            blobs.append((flush, blob))
    if blobs:
        yield bucket(current, blobs)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "flush", "blob"])


def _totals(batches):
    """One row for what a task has read: tokens, kinds of words, documents learned from, counts of bytes."""
    total = np.zeros(3 + 256, np.int64)
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if kind == 2:
                total[:2] += unpack(blob, {"total": np.int64})[0]["total"]
            else:
                got = unpack(blob, DOCS)[0]
                total[2] += int((got["held"] == 0).sum())
                total[3:] += got["letters"]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "n"])


def _per_document(table: pa.Table) -> pa.Table:
    """The documents of a flush with their sums."""
    docs, sums = None, []
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
        if kind == 1:
            docs = unpack(blob, DOCS)[0]
        else:
            sums.append(unpack(blob, SUMS)[0])
    n = len(docs["id"])
    log, known = np.zeros(n), np.zeros(n, np.int64)
    for s in sorted(sums, key=lambda s: (len(s["doc"]), s["log"].sum())):
        log[s["doc"]] += s["log"]
        known[s["doc"]] += s["known"]
    return pa.table({"doc_id": pa.array(docs["id"], mask=docs["null"] == 1), "rid": pa.array(docs["rid"]), "n_words": pa.array(docs["n"]), "known": pa.array(known), "log": pa.array(log)})


# ---------------------------------------------------------------- mixing model


def symbol_table(letters: np.ndarray) -> np.ndarray:
    """Symbol of each byte: the most frequent 62, the line feed as end, others escaped."""
    table = np.full(256, ESCAPE, np.uint8)
    for k, c in enumerate([c for c in np.argsort(-letters, kind="stable") if letters[c] and c != 10][:ESCAPE]):
        table[c] = k
    table[10] = END
    return table


def tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman tree over the symbols: path lengths, nodes and bits of all paths in a row, depth of each node."""
    heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    serial, parts = SYMBOLS, {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parts[serial] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], serial, serial))
        serial += 1
    paths: dict[int, list] = {}
    depth = np.zeros(SYMBOLS, np.int64)
    todo = [(heap[0][2], [])]
    while todo:
        at, path = todo.pop()
        if at < SYMBOLS:
            paths[at] = path
            continue
        node = at - SYMBOLS
        depth[node] = min(7, len(path))
        for bit in (0, 1):
            todo.append((parts[at][bit], [*path, (node, bit)]))
    lengths = np.array([len(paths[s]) for s in range(SYMBOLS)])
    flat = [x for s in range(SYMBOLS) for x in paths[s]]
    return lengths, np.array([n for n, _ in flat]), np.array([b for _, b in flat]), depth


def streams(batches, table: np.ndarray):
    """(symbols, places that are coded, first of them of each document, escapes of each, batch row numbers, batch)."""
    gap = b"\n" * PAD
    for batch in batches:
        data, starts, ends = C.strings(batch.column("text"))
        a, n = 0, batch.num_rows
        while a < n:
            texts, size, b = [], 0, a
            while b < n and (size < CHUNK or not texts):
                texts.append(b" ".join(tokens(bytes(data[starts[b] : ends[b]]))))
                size += len(texts[-1]) + PAD
                b += 1
            raw = np.frombuffer(gap + gap.join(texts) + b"\n", np.uint8)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
            begin = PAD + np.cumsum(lengths + PAD - 1) - (lengths + PAD - 1)
            first = np.cumsum(lengths) - lengths
            at = np.repeat(begin - first, lengths) + np.arange(lengths.sum())
            symbols = table[raw]
            escapes = np.add.reduceat(symbols[at] == ESCAPE, first)
            yield symbols, at, first, escapes, batch, a, b
            a = b


def contexts(symbols: np.ndarray, at: np.ndarray, space: int) -> list[np.ndarray]:
    """For each context, where in the tables the counters of each place begin."""
    s = symbols.astype(np.uint32)
    near = np.zeros(len(s), np.uint32)
    found = {}
    for k in range(1, PAD + 1):
        near[k:] |= s[:-k] << np.uint32(6 * (k - 1))
        if k in ORDERS:
            x = near[at]
            bits = SLOTS[ORDERS.index(k)]
            found[k] = x if 6 * k <= bits else (x * np.uint32(2654435761)) >> np.uint32(32 - bits)
    h = C.prefix_hash(C.byte_values(symbols))
    begin = np.where((symbols == space) | (symbols == END), np.arange(1, len(s) + 1), 0)
    np.maximum.accumulate(begin, out=begin)
    found[0] = (C.span_hash(h, begin[at - 1], at) >> np.uint64(64 - SLOTS[ORDERS.index(0)])).astype(np.uint32)
    return [(found[k] << np.uint32(6)).astype(np.int32) + np.int32(begins) for k, begins in zip(ORDERS, STARTS, strict=False)]


def count_symbols(count: np.ndarray, symbols: np.ndarray, at: np.ndarray, space: int) -> None:
    """Adds to how often each symbol followed each slot of each context."""
    own = symbols[at].astype(np.int32)
    for c in contexts(symbols, at, space):
        np.add.at(count, (c + own).astype(np.intp), count.dtype.type(1))  # numbers of these kinds need no conversion one by one


def sayings(count: np.ndarray, code) -> np.ndarray:
    """For each slot and node: confidence times 16 plus the stretched probability of a 1 in 16 steps."""
    lengths, nodes, bits, _ = code
    out = np.zeros(STARTS[-1], np.uint8)
    symbol = np.repeat(np.arange(SYMBOLS), lengths)
    way = np.zeros((2, SYMBOLS, SYMBOLS), np.float32)
    way[bits, symbol, nodes] = 1
    for a in range(0, len(count), 1 << 20):
        c = count[a : a + (1 << 20)].reshape(-1, SYMBOLS).astype(np.float32)
        zero, one = c @ way[0], c @ way[1]
        n = zero + one
        stretch = np.log((one + 0.3) / (zero + 0.3))
        step = np.clip(np.round(stretch * 1.25 + 7.5), 0, 15).astype(np.uint8)
        trust = (n >= 1).astype(np.uint8) + (n >= 6) + (n >= 60)
        out[a : a + (1 << 20)] = (trust * 16 + step).ravel()
    return out


def cells(symbols: np.ndarray, at: np.ndarray, space: int, said: np.ndarray, code, flat_start: np.ndarray):
    """For each bit of each place: cell of gates and sayings, times 2 plus the bit; and bits a place."""
    lengths, nodes, bits, depth = code
    own = symbols[at]
    n = lengths[own]
    total = int(n.sum())
    path = np.repeat((flat_start[own] - (np.cumsum(n) - n)).astype(np.int32), n) + np.arange(total, dtype=np.int32)
    node = nodes[path]
    a, b, c = (said[np.repeat(start, n) + node] for start in contexts(symbols, at, space))
    cell = depth[node]  # depth, then the word and the 5 symbols with their confidence, then the 3 symbols' step
    cell = (cell << 6) | c
    cell = (cell << 6) | b
    cell = (cell << 4) | (a & 15)
    return (cell << 1) | bits[path], n


def small(code) -> tuple:
    """The tree in the kinds of numbers that make the inner loop fast, and where each symbol's path begins."""
    lengths, nodes, bits, depth = code
    return (lengths.astype(np.int64), nodes.astype(np.int32), bits.astype(np.int32), depth.astype(np.int32)), (np.cumsum(lengths) - lengths).astype(np.int64)


def learn_mix(seen: np.ndarray, steps: int = 200) -> np.ndarray:
    """log10 probability of each cell's bit, from how often cells were seen with each bit."""
    n = seen.reshape(8, 4, 16, 4, 16, 16, 2).astype(np.float64)  # depth, trust, step (word), trust, step (5 symbols), step (3 symbols), bit
    n = n.transpose(0, 1, 3, 2, 4, 5, 6).reshape(8 * 4 * 4, 16**3, 2)
    level = (np.arange(16) - 7.5) / 1.25
    x = np.stack([*(g.ravel() for g in np.meshgrid(level, level, level, indexing="ij")), np.ones(16**3)], axis=1)
    total, ones = n.sum(2), n[:, :, 1]
    weight = np.tile([0.4, 0.3, 0.2, 0.0], (len(n), 1))
    for _ in range(steps):  # a Newton step for each gate, shortened by a ridge
        p = 1 / (1 + np.exp(-np.clip(weight @ x.T, -12, 12)))
        gradient = (ones - total * p) @ x - 0.1 * weight
        curve = np.einsum("gc,ci,cj->gij", total * p * (1 - p), x, x) + 0.1 * np.eye(4)
        change = np.linalg.solve(curve, gradient[:, :, None])[:, :, 0]
        weight += np.clip(change, -0.5, 0.5)
        if np.abs(change).max() < 1e-4:
            break
    mixed = np.clip(weight @ x.T, -12, 12)
    p = 1 / (1 + np.exp(-mixed))
    p = (ones + 20 * p) / (total + 20)  # refined by what was seen
    p = np.clip(p, 1e-6, 1 - 1e-6).reshape(8, 4, 4, 16, 16, 16).transpose(0, 1, 3, 2, 4, 5)
    return np.log10(np.stack([1 - p, p], axis=-1)).ravel()


def learn(rows: DataFrame, letters: np.ndarray) -> tuple:
    """The model of the training rows (rid and text)."""
    table = symbol_table(letters)
    space, size = int(table[32]), STARTS[-1]
    last = F.pmod(F.shiftright("rid", 7), F.lit(FOLDS)) == 0

    def fill(batches):
        count = np.zeros(size, np.uint32)
        for symbols, at, *_ in streams(batches, table):
            count_symbols(count, symbols, at, space)
        return [count]

    (count,) = summed(rows.where(~last).select("text"), fill, [(size, np.uint32)])
    code = tree(count[: STARTS[1]].reshape(-1, SYMBOLS).sum(0, dtype=np.int64))
    first = rows.sparkSession.sparkContext.broadcast(packed(sayings(count, code)))  # STARTS[-1] bytes
    fast, start = small(code)

    def say(batches):
        said = unpacked(first.value, np.uint8)
        seen, count = np.zeros(2 * CELLS, np.int64), np.zeros(size, np.uint32)
        for symbols, at, *_ in streams(batches, table):
            np.add.at(seen, cells(symbols, at, space, said, fast, start)[0].astype(np.intp), np.int64(1))
            count_symbols(count, symbols, at, space)
        return [seen, count]

    seen, more = summed(rows.where(last).select("text"), say, [(2 * CELLS, np.int64), (size, np.uint32)])
    count += np.minimum(more, np.iinfo(np.uint32).max - count)
    del more
    return table, code, rows.sparkSession.sparkContext.broadcast(packed(sayings(count, code))), learn_mix(seen)


def score(rows: DataFrame, model: tuple) -> DataFrame:
    """rows without text, with n_coded and score."""
    table, code, said, cost = model
    space = int(table[32])
    fast, start = small(code)
    shared = rows.sparkSession.sparkContext.broadcast(cost)  # 2 * CELLS numbers

    def run(batches):
        own, price = unpacked(said.value, np.uint8), shared.value
        for symbols, at, first, escapes, batch, a, b in streams(batches, table):
            cell, n = cells(symbols, at, space, own, fast, start)
            got = np.add.reduceat(price[cell], (np.cumsum(n) - n)[first]) - escapes * np.log10(256)
            coded = np.diff(np.append(first, len(at)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "held", "rid")), pa.array(coded), pa.array(got)], names=["doc_id", "held", "rid", "n_coded", "score"])

    return rows.mapInArrow(run, "doc_id long, held boolean, rid long, n_coded long, score double")


def scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    held_out is a condition on docs; what it does not hold for is learned from.
    """
    parts = C.shuffle_partitions(docs.sparkSession)
    subs = max(1, 128 // parts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held")).withColumn("rid", C.row_id())
    sent = rows.mapInArrow(_send_words(parts, subs), "pid int, sub int, kind int, flush long, blob binary")
    counted = C.stored(sent.repartitionById(parts, F.col("pid")).sortWithinPartitions("sub").mapInArrow(_count_words, "kind int, flush long, blob binary"), "words")
    got = counted.where("kind > 0").mapInArrow(_totals, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 259 numbers
    total = np.zeros(259, np.int64)
    for r in got:
        total[r.k] = r.n
    ends = int(total[2])
    n, v = int(total[0]) + ends, int(total[1]) + (ends > 0)
    sums = counted.where("kind < 2").groupBy("flush").applyInArrow(_per_document, "doc_id long, rid long, n_words long, known long, log double")
    per = sums.groupBy("doc_id", "rid").agg(F.first("n_words").alias("n_words"), F.first("known").alias("known"), F.first("log").alias("log"))
    model = learn(rows.where(~F.col("held")).select("rid", "text"), total[3:])
    scored = score(rows.select("doc_id", "held", "rid", "text"), model)
    out = scored.join(per.withColumnsRenamed({"doc_id": "_id", "rid": "_rid"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rid") == F.col("_rid")))
    n_tokens = F.col("n_words") + 1
    return out.select(
        "doc_id",
        F.col("held").alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log") + F.lit(float(np.log10(ends + 1.0))) - n_tokens * F.lit(float(np.log10(n + v + 1.0)))).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_coded")).alias("bits_per_byte"),
    )
