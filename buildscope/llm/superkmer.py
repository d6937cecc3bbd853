"""Repeated windows over a corpus by super-k-mer partitioning.

A text is a sequence of tokens (bytes, or words). Each window of W tokens has a
minimiser: the q-gram in it with the least hash, the leftmost of equals. Consecutive
windows with one minimiser travel together as one packed string (a piece) to the bucket
of that minimiser, so every occurrence of a window reaches one bucket while each token
travels about W / (W - q) * 3 times less often than if windows travelled alone.

What crosses the network is cut down before the shuffle. Within a task's flush a piece
is sent once, for the least doc_id that holds it, with the list of its places in that
doc_id's rows; every later document with the same piece has all the piece's windows
repeated, which needs no other machine. So a group of copies that holds a third of the
corpus, or a text that repeats one letter, reaches its bucket as one piece a flush.

Minimisers that stand in very many different pieces (a line that every document has)
would still make a heavy bucket. ``dealing`` counts minimisers over a scan and names
those whose share would outweigh a bucket, at most HOT_SHARE a bucket; their pieces are
cut into single windows and dealt by the hash of the whole window instead.

In a bucket the smallest doc_id of each window is found by a function that the caller
gives (sorting for words, a column-wise Burrows-Wheeler construction for bytes). Windows
of greater documents come back as spans, keyed by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Tokens of a document taken at a time; longer ones are cut with an overlap of W - 1.
SEGMENT = 1 << 20
#: Bytes of text hashed at a time, and bytes of pieces gathered before they are sent.
CHUNK, FLUSH = 1 << 18, 8 << 20
#: A minimiser is hot if its pieces are more than this share of a mean bucket's.
HOT_SHARE = 0.5
#: Effort of compression with a dictionary.
LEVEL = 4

#: Bytes of pieces a bucket, and the least number of buckets.
BUCKET, BUCKETS = 16 << 20, 256

SENT = "pid int, sub int, kind int, blob binary"
SPANS = "doc_id long, rid long, spans binary"


def pieces(values: np.ndarray, bounds: np.ndarray, width: int, gram: int):
    """Super-k-mers of the segments values[bounds[i]:bounds[i+1]].

    Returns arrays: first window, number of windows, position of the minimiser, its hash.
    """
    n = len(values)
    if n < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    at = np.arange(n - gram + 1)
    h = C.prefix_hash(values)
    grams = C.mix((h[gram:] - h[: n - gram + 1]) * C.powers(C.UNBASE, n - gram + 1))
    # 40 bits of hash, then the place: the least key is the leftmost of the least hashes
    keys = (grams & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    span = width - gram + 1
    full = -(-len(keys) // span) * span
    block = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    block[: len(keys)] = keys
    block = block.reshape(-1, span)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    least = np.minimum(right[:count], left[span - 1 : span - 1 + count])
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    valid = np.ones(count, bool)
    for end in bounds[1:-1]:
        valid[max(0, end - width + 1) : end] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    places = anchor[starts]
    new = np.empty(len(starts), bool)
    new[0] = True
    np.not_equal(places[1:], places[:-1], out=new[1:])
    new[1:] |= starts[1:] != starts[:-1] + 1
    cut = np.flatnonzero(new)
    first, place = starts[cut], places[cut]
    return first, np.diff(np.append(cut, len(starts))), place, grams[place]


def chunks(batches: Iterator[pa.RecordBatch], words: bool, width: int) -> Iterator[tuple]:
    """(text, token starts, values, segment bounds, doc of each segment, its first token there, ids, rids)."""
    for batch in batches:
        data, starts, ends = C.strings(batch.column("text"))
        ids, rids = C.longs(batch.column("doc_id"), C.NULL_ID), C.longs(batch.column("rid"))
        held, size, whose, froms, counts = [], 0, [], [], []

        def ready():
            bounds = np.zeros(len(counts) + 1, np.int64)
            np.cumsum(counts, out=bounds[1:])
            if words:
                text, at, values = C.word_hashes(held)
            else:
                text = b"".join(held)
                at, values = np.arange(len(text) + 1), C.byte_values(text)
            return text, at, values, bounds, np.array(whose), np.array(froms), ids, rids

        for row in np.argsort(ids, kind="stable"):  # the least document first
            text = bytes(data[starts[row] : ends[row]])
            tokens = text.split() if words else text
            for a in range(0, max(1, len(tokens) - width + 1), SEGMENT - width + 1):
                part = tokens[a : a + SEGMENT]
                if len(part) < width:
                    continue
                held.extend(part) if words else held.append(part)
                whose.append(row), froms.append(a), counts.append(len(part))
                size += len(text) if words else len(part)
                if size >= CHUNK:
                    yield ready()
                    held, size, whose, froms, counts = [], 0, [], [], []
        if held:
            yield ready()


def dictionary(docs: DataFrame, rows: int = 64, length: int = 4096):
    """A broadcast of at most rows * length characters of the corpus, which compression refers to.

    It shortens what is shuffled and decides no result.
    """
    text = F.col("text").cast("string")
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(64)) == 0).select(F.substring(text, 1, length).alias("text")).limit(rows).collect()
    return docs.sparkSession.sparkContext.broadcast("\n".join(r[0] or "" for r in some).encode().ljust(64))


def compressor(data: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=own)


def decompressor(data: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def pack(columns: dict[str, np.ndarray], text: bytes, coder: zstandard.ZstdCompressor | None = None) -> bytes:
    """Columns and a text as one compressed string; a column's bytes of equal rank stand together."""
    head = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in columns.values())
    sizes = np.array([len(text), *(len(a) for a in columns.values())], np.int64).tobytes()
    return (coder or zstandard.ZstdCompressor()).compress(sizes + head + text)


def unpack(blob: bytes, kinds: dict[str, type], coder: zstandard.ZstdDecompressor | None = None) -> tuple[dict[str, np.ndarray], bytes]:
    raw = (coder or zstandard.ZstdDecompressor()).decompress(blob)
    size = np.frombuffer(raw, np.int64, len(kinds) + 1)
    at, out = size.nbytes, {}
    for (name, kind), n in zip(kinds.items(), size[1:].tolist(), strict=True):
        width = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()
        at += n * width
    return out, raw[at : at + int(size[0])]


#: Of ids there are the differences, which take fewer bytes.
PIECE = {"id": np.int64, "rid": np.int64, "docs": np.uint32, "start": np.uint32, "places": np.uint32, "windows": np.uint16, "left": np.uint16}
DONE = {"id": np.int64, "rid": np.int64, "docs": np.uint32, "start": np.uint32, "windows": np.uint32}

def _whose(got: dict) -> tuple[np.ndarray, np.ndarray]:
    at = np.cumsum(got["docs"], dtype=np.uint32)
    return np.cumsum(got["id"])[at], got["rid"][at]


def _send(words: bool, width: int, gram: int, parts: int, subs: int, hot: np.ndarray, shared) -> Callable:
    total = parts * subs

    def run(batches):
        C.held("pieces")
        held: list[tuple] = []
        size, coder = 0, compressor(shared.value)

        def flush():
            # by documents in ascending order, so that the first holder of a piece is the least
            text = [p for h in held for p in h[0]]
            ids, rids, start, windows, left, bucket = (np.concatenate([h[k] for h in held]) for k in range(1, 7))
            order = np.lexsort((start, rids, ids))
            seen: dict[bytes, int] = {}
            owner = np.empty(len(text), np.int64)
            for i in order.tolist():
                owner[i] = seen.setdefault(text[i], i)
            repeated = ids[owner] < ids
            out = {"pid": [], "sub": [], "kind": [], "blob": []}

            def add(pid, sub, kind, blob):
                for k, v in zip(out, (pid, sub, kind, blob), strict=True):
                    out[k].append(v)

            # a bucket's pieces by the first place of each; places that share a piece stand together
            rank = np.empty(len(text), np.int64)
            rank[order] = np.arange(len(text))
            send = order[~repeated[order]]
            send = send[np.argsort(bucket[send] * len(text) + rank[owner[send]], kind="stable")]
            id_, rid_, start_ = ids[send], rids[send], start[send].astype(np.uint32)
            edge = np.ones(len(send), bool)
            edge[1:] = bucket[send[1:]] != bucket[send[:-1]]
            new, head = edge.copy(), edge.copy()
            new[1:] |= (id_[1:] != id_[:-1]) | (rid_[1:] != rid_[:-1])
            head[1:] |= owner[send[1:]] != owner[send[:-1]]
            cut = np.append(np.flatnonzero(edge), len(send)).tolist()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                changes, heads = new[a:b], np.flatnonzero(head[a:b])
                one = send[a:b][heads]
                docs = changes.astype(np.uint32)
                docs[0] = 0
                columns = {"id": np.diff(id_[a:b][changes], prepend=0), "rid": rid_[a:b][changes], "docs": docs, "start": start_[a:b], "places": np.diff(np.append(heads, b - a)).astype(np.uint32), "windows": windows[one].astype(np.uint16), "left": left[one].astype(np.uint16)}
                place = int(bucket[send[a]])
                add(place // subs, place, 0, pack(columns, (b"\n" if words else b"").join([text[i] for i in one.tolist()]), coder))
            gone = np.flatnonzero(repeated)
            if len(gone):
                spot = (C.mix(rids[gone].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                gone, spot = gone[o := np.lexsort((start[gone], rids[gone], ids[gone], spot))], spot[o]
                for idx in np.split(gone, np.flatnonzero(np.diff(spot)) + 1):
                    new = np.ones(len(idx), bool)
                    new[1:] = (np.diff(ids[idx]) != 0) | (np.diff(rids[idx]) != 0)
                    columns = {"id": np.diff(ids[idx[new]], prepend=0), "rid": rids[idx[new]], "docs": np.append(0, new[1:]).astype(np.uint32), "start": start[idx].astype(np.uint32), "windows": windows[idx].astype(np.uint32)}
                    add(int(C.mix(rids[idx[:1]].view(np.uint64))[0] % np.uint64(parts)), -1, 1, pack(columns, b"", coder))
            return pa.RecordBatch.from_arrays([pa.array(out["pid"], pa.int32()), pa.array(out["sub"], pa.int32()), pa.array(out["kind"], pa.int32()), pa.array(out["blob"], pa.binary())], names=list(out))

        for text, at, values, bounds, whose, froms, ids, rids in chunks(batches, words, width):
            first, windows, place, anchor = pieces(values, bounds, width, gram)
            if not len(first):
                continue
            if len(hot) and (cut := np.isin(anchor, hot)).any():
                # single windows, each dealt by its own hash
                n = windows[cut]
                each = np.repeat(first[cut], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                whole = C.span_hash(C.prefix_hash(values), each, each + width)
                first, windows = np.append(first[~cut], each), np.append(windows[~cut], np.ones(len(each), np.int64))
                place, anchor = np.append(place[~cut], np.repeat(place[cut], n)), np.append(anchor[~cut], whole)
                back = np.argsort(first, kind="stable")
                first, windows, place, anchor = first[back], windows[back], place[back], anchor[back]
            begin, end = at[first], at[first + windows + width - 1] - words
            segment = np.searchsorted(bounds, first, side="right") - 1
            row = whose[segment]
            spread = C.mix(anchor ^ np.uint64(0xA0761D6478BD642F))
            held.append(([text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], ids[row], rids[row], first - bounds[segment] + froms[segment], windows, place - first, ((spread >> np.uint64(32)) % np.uint64(total)).astype(np.int64)))
            size += int((end - begin).sum())
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _spans(ids, rids, start, windows) -> pa.RecordBatch:
    """One row for each document row, with its (start, windows) pairs packed."""
    order = np.lexsort((start, rids, ids))
    ids, rids = ids[order], rids[order]
    pairs = np.stack([start[order], windows[order]], axis=1).astype("<u4")
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (rids[1:] != rids[:-1])
    cut = np.flatnonzero(new)
    ends = np.append(cut[1:], len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[cut]), pa.array(rids[cut]), pa.array([pairs[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["doc_id", "rid", "spans"])


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, ... n[0] numbers, then those from low[1] on, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def anchors(texts: list[bytes], windows: np.ndarray, left: np.ndarray, words: bool, width: int, gram: int, step: int = 4096) -> np.ndarray:
    """A hash of each piece's minimiser, so many pieces at a time."""
    out = [np.zeros(0, np.uint64)]
    for a in range(0, len(texts), step):
        some, tokens, at = texts[a : a + step], windows[a : a + step] + width - 1, left[a : a + step]
        begin = np.cumsum(tokens) - tokens + at
        if words:
            whole = b" ".join(some) + b" "
            ends = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
            begin, end = np.append(0, ends[:-1] + 1)[begin], ends[begin + gram - 1]
        else:
            whole = b"".join(some)
            end = begin + gram
        out.append(C.span_hash(C.prefix_hash(C.byte_values(whole)), begin, end))
    return np.concatenate(out)


def _answer(words: bool, width: int, gram: int, least: Callable, shared) -> Callable:
    """Spans of the windows that a smaller document has, bucket by bucket."""

    def bucket(blobs: list[bytes], coder):
        text: list[bytes] = []
        columns: dict[str, list] = {k: [] for k in ("ids", "rids", "start", "places", "windows", "left")}
        for blob in blobs:
            got, raw = unpack(blob, PIECE, coder)
            windows = got["windows"].astype(np.int64)
            if words:
                text += raw.split(b"\n")
            else:
                ends = np.cumsum(windows + width - 1)
                text += [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            for k, v in zip(columns, (*_whose(got), got["start"], got["places"].astype(np.int64), windows, got["left"].astype(np.int64)), strict=True):
                columns[k].append(v)
        place_id, place_rid, place_start, places, windows, left = (np.concatenate(v) for v in columns.values())
        first = np.cumsum(places) - places
        ids = place_id[first]  # all places of a piece have one doc_id
        seen: dict[bytes, int] = {}
        owner = np.empty(len(text), np.int64)
        for i in np.argsort(ids, kind="stable").tolist():
            owner[i] = seen.setdefault(text[i], i)
        whole = np.flatnonzero(ids[owner] < ids)  # the same piece stands in a smaller document
        found = [(whole, np.zeros(len(whole), np.int64), windows[whole])]  # pieces, first windows, windows
        # A window that two different pieces share has one minimiser, so a piece whose minimiser stands alone is done.
        own = np.flatnonzero(owner == np.arange(len(owner)))
        tag = anchors([text[i] for i in own.tolist()], windows[own], left[own], words, width, gram)
        _, group, count = np.unique(tag, return_inverse=True, return_counts=True)
        own = own[count[group.ravel()] > 1]
        if len(own):
            i, offset, run = least([text[i] for i in own.tolist()], ids[own], windows[own], left[own])
            if len(i):
                order = np.argsort(own[i], kind="stable")
                rows, offset, run = own[i][order], offset[order], run[order]
                found.append((rows, offset, run))
                mate = np.flatnonzero((ids[owner] == ids) & (owner != np.arange(len(owner))))  # the same piece again in its least document
                low, n = np.searchsorted(rows, owner[mate], "left"), np.zeros(len(mate), np.int64)
                n = np.searchsorted(rows, owner[mate], "right") - low
                at = _ranges(low, n)
                found.append((np.repeat(mate, n), offset[at], run[at]))
        piece, offset, run = (np.concatenate([f[k] for f in found]) for k in range(3))
        if not len(piece):
            return None
        n = places[piece]
        at = _ranges(first[piece], n)
        return _spans(place_id[at], place_rid[at], place_start[at].astype(np.int64) + np.repeat(offset, n), np.repeat(run, n))

    def run(batches):
        current, blobs, coder = None, [], decompressor(shared.value)
        for batch in batches:
            for sub, kind, blob in zip(batch.column("sub").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                if kind == 1:
                    got, _ = unpack(blob.as_py(), DONE, coder)
                    ids, rids = _whose(got)
                    yield _spans(ids, rids, got["start"], got["windows"])
                    continue
                if sub != current and blobs:
                    if (rows := bucket(blobs, coder)) is not None:
                        yield rows
                    blobs = []
                current = sub
                blobs.append(blob.as_py())
        if blobs and (rows := bucket(blobs, coder)) is not None:
            yield rows

    return run


def dealing(rows: DataFrame, words: bool, width: int, gram: int, parts: int, share: int = 64) -> tuple[np.ndarray, int, int]:
    """(hot minimisers, partitions, buckets a partition).

    There is a bucket for each BUCKET bytes of pieces, BUCKETS at least. A minimiser is hot
    with more than HOT_SHARE of a mean bucket's pieces, so at most buckets / HOT_SHARE are.
    This only decides how work is dealt, never a result, so it is estimated on the rows whose
    hash is divisible by ``share``.
    """

    def count(batches):
        C.held("anchors")
        for text, at, values, bounds, *_ in chunks(batches, words, width):
            first, windows, _, anchor = pieces(values, bounds, width, gram)
            got = np.unique(anchor, return_counts=True)
            few = got[1] > 1  # what stands once in 2 MB can't be hot
            size = int((at[first + windows + width - 1] - at[first]).sum()) if len(first) else 0
            yield pa.RecordBatch.from_arrays([pa.array(np.append(got[0][few], np.uint64(0)).view(np.int64)), pa.array(np.append(got[1][few], got[1].sum()).astype(np.int64)), pa.array(np.append(np.zeros(few.sum(), np.int64), size)), pa.array(np.arange(few.sum() + 1) == few.sum())], names=["anchor", "n", "size", "total"])

    counts = rows.where(F.pmod(F.shiftright("rid", 8), F.lit(share)) == 0).mapInArrow(C.tidied(count), "anchor long, n long, size long, total boolean").groupBy("anchor", "total").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    counts = C.stored(counts, "anchors")
    total, size = counts.where("total").agg(F.sum("n"), F.sum("size")).first()
    wanted = max(BUCKETS, share * (size or 0) // BUCKET)
    parts = max(parts, wanted // 64)  # 1 GB of pieces a task at most
    subs = max(1, wanted // parts)
    least = max(8.0, HOT_SHARE * (total or 0) / (parts * subs))
    found = counts.where(~F.col("total") & (F.col("n") > least)).select("anchor").limit(int(parts * subs / HOT_SHARE) + 1).collect()
    C.forget(counts)
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64)), parts, subs


def row_key(doc=None, text=None):
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.col("doc_id") if doc is None else doc, F.col("text") if text is None else text)


def repeated_spans(docs: DataFrame, words: bool, width: int, gram: int, least: Callable, shared) -> DataFrame:
    """Rows (doc_id, rid, spans): runs of windows of each row that also start in a smaller doc_id.

    ``least(texts, ids, windows, left)`` gets different pieces and returns arrays (piece,
    first window, windows) for the runs whose windows stand in a piece with a smaller id.
    ``shared`` is a dictionary.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", row_key())
    hot, parts, subs = dealing(rows, words, width, gram, C.shuffle_partitions(docs.sparkSession))
    sent = rows.mapInArrow(C.tidied(_send(words, width, gram, parts, subs, hot, shared)), SENT)
    spans = sent.repartitionById(parts, F.col("pid")).sortWithinPartitions("sub").mapInArrow(C.tidied(_answer(words, width, gram, least, shared)), SPANS)
    return C.stored(spans, "spans")  # so that the pieces' shuffle files go before the texts are shuffled


def compressed(rows: DataFrame, shared) -> DataFrame:
    """rows with text compressed, null where it is null; see texts."""

    def squeeze(batches):
        coder = compressor(shared.value, 3)
        for batch in batches:
            text = pa.array([None if t is None else coder.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return rows.mapInArrow(C.tidied(squeeze), rows.withColumn("text", F.lit(None).cast("binary")).schema)


def with_spans(docs: DataFrame, spans: DataFrame, shared) -> DataFrame:
    """docs with the list of each row's packed spans as __spans (null if none) and text compressed; see texts."""
    by = spans.groupBy("doc_id", "rid").agg(F.collect_list("spans").alias("__spans")).withColumnsRenamed({"doc_id": "__id", "rid": "__rid"})
    left = docs.withColumn("__rid", row_key(F.col("doc_id").cast("long"), F.col("text").cast("string"))).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)))
    small = compressed(left, shared)
    return small.join(by, ["__id", "__rid"], "left").drop("__id", "__rid")


def texts(batch: pa.RecordBatch, coder: zstandard.ZstdDecompressor) -> list[bytes | None]:
    """The texts of a batch of compressed or with_spans in UTF-8."""
    return [None if t is None else coder.decompress(t) for t in batch.column("text").to_pylist()]


def covered(spans: list[bytes] | None, tokens: int, width: int) -> np.ndarray:
    """Which of a row's tokens its spans cover."""
    edge = np.zeros(tokens + 1, np.int32)
    for pairs in (np.frombuffer(s, "<u4").reshape(-1, 2).astype(np.int64) for s in spans or ()):
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 0] + pairs[:, 1] + width - 1, -1)
    return np.cumsum(edge[:-1]) > 0
