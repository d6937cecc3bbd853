"""Removal of repeated byte strings by a column-wise collection Burrows-Wheeler transform.

Each byte covered by a 50-byte string that also starts in a document with a smaller
doc_id is removed; overlaps count, and strings are judged on the input.

The corpus is dealt to buckets as super-k-mers over bytes (see superkmer). In a bucket
the pieces are a collection of short documents, lined up on their minimisers. The
construction goes from the last column to the first: each round takes one symbol of every
piece that reaches the column, puts it before that piece's suffix, and so gets

* the order of the longer suffixes, a stable sort of the old order by the new symbols (the
  symbols in the old order are the column's part of a Burrows-Wheeler transform),
* the common prefixes of neighbours, 1 more than the least of the old ones between them
  when both got the same symbol, and otherwise 0.

Only symbols, order and common prefixes of one column are in memory. Symbols are read
from one sequential file, a column a round; order and common prefixes are appended to
others, which are then read once from the start to find the repeats.

This is less than the transform of a collection of whole documents: equal windows have
equal places relative to their minimiser, so suffixes of different columns are never
merged into one transform, and pieces that are equal, or whose minimiser no other piece
has, are settled before the construction. That is what lets a round cost the number of
pieces, not the size of the transform so far; whole documents would take a round a byte of
the longest one, each of them a pass over the whole transform.

Defined cases: null and empty texts have no bytes and keep the empty string; texts under
50 bytes keep all; equal doc_ids never remove each other's bytes; a null doc_id comes
after all others; extra columns are ignored by name.
"""

from __future__ import annotations

import tempfile
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import superkmer as K
from .substring_dedup import merged, sha256

WIDTH, GRAM = 50, 10
#: Pieces lined up at a time.
ROWS = 1 << 14


class RangeMinimum:
    """Least of values[a+1 .. b], by a table of powers of two up to the longest range asked for."""

    def __init__(self, values: np.ndarray, longest: int):
        n, levels = len(values), longest.bit_length()
        self.table = np.empty((levels, n), values.dtype)
        self.table[0] = values
        for k in range(1, levels):
            step, last, new = 1 << (k - 1), self.table[k - 1], self.table[k]
            np.minimum(last[:-step], last[step:], out=new[:-step])
            new[-step:] = last[-step:]

    def between(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        k = _log2(len(self.table))[length]
        return np.minimum(self.table[k, a + 1], self.table[k, b - (1 << k) + 1])


@cache
def _log2(levels: int) -> np.ndarray:
    """Rounded-down logarithm of each length below 2**levels."""
    return np.frexp(np.arange(1 << levels).astype(np.float64))[1] - 1


def construct(texts: list[bytes], left: np.ndarray, last: int, orders, prefixes) -> list[tuple[int, int]]:
    """Writes order and common prefixes of the columns from 0 down to last, and returns (column, length) of each."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    right = lengths - left  # columns from the minimiser on
    low, high = -int(left.max()), int(right.max())
    grid = np.zeros((len(texts), high - low), np.uint8)
    place = np.arange(low, high)
    for a in range(0, len(texts), ROWS):  # a piece's bytes are its row's columns from -left to right
        own = slice(a, a + ROWS)
        grid[own][(place >= -left[own, None]) & (place < right[own, None])] = np.frombuffer(b"".join(texts[own]), np.uint8)
    with tempfile.TemporaryFile() as symbols:
        np.ascontiguousarray(grid[:, ::-1].T).tofile(symbols)  # the last column comes first
        del grid
        symbols.seek(0)
        order, common, done = np.zeros(0, np.int32), np.zeros(0, np.uint8), []
        for column in range(high - 1, max(low, last) - 1, -1):
            symbol = np.fromfile(symbols, np.uint8, len(texts))
            if len(new := np.flatnonzero(right == column + 1)):  # pieces that end here have the empty suffix, the least
                order, common = np.append(new.astype(np.int32), order), np.append(np.zeros(len(new), np.uint8), common)
            common[:1] = 0
            held = np.flatnonzero(column >= -left[order])  # a piece whose first symbol is in leaves
            got = symbol[order[held]]
            turn = np.argsort(got, kind="stable")
            was, got = held[turn], got[turn]
            longer = np.zeros(len(was), np.uint8)
            same = np.flatnonzero(got[1:] == got[:-1]) + 1
            if len(same):
                begin, end = was[same - 1], was[same]
                length = end - begin
                longer[same] = np.minimum(RangeMinimum(common, int(length.max())).between(begin, end, length), 254) + 1
            order, common = order[was], longer
            if column <= 0:
                order.tofile(orders), common.tofile(prefixes)
                done.append((column, len(order)))
    return done


def repeated_windows(width: int, gram: int):
    """Finds windows that a smaller id has: neighbours in a column with width symbols in common."""

    def least(texts, ids, windows, left):
        right = np.fromiter(map(len, texts), np.int64, len(texts)) - left
        piece, window = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        with tempfile.TemporaryFile() as orders, tempfile.TemporaryFile() as prefixes:
            done = construct(texts, left, gram - width, orders, prefixes)
            orders.seek(0), prefixes.seek(0)
            for column, n in done:
                order, run = np.fromfile(orders, np.int32, n), np.fromfile(prefixes, np.uint8, n) >= width
                if not run.any():
                    continue
                starts = np.flatnonzero(~run)
                smallest = np.minimum.reduceat(ids[order], starts)
                which = np.cumsum(~run) - 1
                hit = (ids[order] > smallest[which]) & (right[order] - column >= width)
                piece.append(order[hit].astype(np.int64))
                window.append(column + left[order[hit]])
        return merged(np.concatenate(piece), np.concatenate(window))

    return least


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept): kept is binary, a cut may fall inside a character."""

    def keep(batches):
        coder = K.decompressor(shared.value)
        for batch in batches:
            size, removed, runs, kept = [], [], [], []
            for text, spans in zip(K.texts(batch, coder), batch.column("__spans").to_pylist(), strict=True):
                raw = text or b""
                size.append(len(raw))
                if not spans:
                    removed.append(0), runs.append(0), kept.append(raw)
                    continue
                gone = K.covered(spans, len(raw), width)
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    shared = K.dictionary(docs)
    spans = K.repeated_spans(docs, False, width, gram, repeated_windows(width, gram), shared)
    rows = K.with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), spans, shared)
    return rows.select("doc_id", "text", "__spans").mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def cleaned_documents(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs with text cut to what stays; a character of which a part was removed goes whole, n_chars follows."""
    docs, back = C.set_apart(docs, ("doc_id", "text", "n_chars"))
    names = docs.columns

    def cut(batches):
        coder = K.decompressor(shared.value)
        for batch in batches:
            out = []
            for text, spans in zip(K.texts(batch, coder), batch.column("__spans").to_pylist(), strict=True):
                if spans:
                    text = np.frombuffer(text, np.uint8)[~K.covered(spans, len(text), width)].tobytes()
                out.append(None if text is None else text.decode("utf-8", "ignore"))
            at = {n: batch.column(n) for n in names} | {"text": pa.array(out, pa.string())}
            if "n_chars" in at:
                at["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays(list(at.values()), names=list(at))

    shared = K.dictionary(docs)
    spans = K.repeated_spans(docs, False, width, gram, repeated_windows(width, gram), shared)
    kinds = docs.withColumn("text", F.col("text").cast("string"))
    if "n_chars" in names:
        kinds = kinds.withColumn("n_chars", F.col("n_chars").cast("long"))
    return C.set_back(K.with_spans(kinds, spans, shared).select(*names, "__spans").mapInArrow(C.tidied(cut), kinds.schema), back)


__all__ = ["cleaned_documents", "remove_repeated_bytes", "repeated_windows", "sha256"]
