"""Substring dedup over words: super-k-mer partitioning with exact sorting in each bucket.

A window is ``width`` consecutive words. Each word that a window covers whose words also
start, as a window, in a document with a smaller doc_id is removed. Windows are judged on
the input, so removing one passage never makes another.

Defined cases: a null or empty text, or one of white space, has no words and keeps the
empty string; texts of fewer than ``width`` words keep all; equal doc_ids never remove
each other's windows; a null doc_id comes after all others; rows that repeat are answered
alike; other columns of the table are ignored whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import superkmer as K

WIDTH, GRAM = 13, 3


def merged(piece: np.ndarray, window: np.ndarray):
    """Runs (piece, first window, windows) of single windows."""
    order = np.lexsort((window, piece))
    piece, window = piece[order], window[order]
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1)
    cut = np.flatnonzero(new)
    return piece[cut], window[cut], np.diff(np.append(cut, len(piece)))


def sorted_windows(width: int):
    """Finds each window's smallest id by sorting the windows' own bytes."""

    def least(texts, ids, windows, left):
        whole = b" ".join(texts) + b" "
        ends = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
        starts = np.append(0, ends[:-1] + 1)
        base = np.cumsum(windows + width - 1) - (windows + width - 1)
        piece = np.repeat(np.arange(len(texts)), windows)
        window = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        word = base[piece] + window
        found = sorted(zip([whole[a:b] for a, b in zip(starts[word].tolist(), ends[word + width - 1].tolist(), strict=True)], ids[piece].tolist(), range(len(piece)), strict=True))
        hit, last, smallest = [], None, 0
        for key, doc, i in found:
            if key != last:
                last, smallest = key, doc
            elif doc > smallest:
                hit.append(i)
        hit = np.array(hit, np.int64)
        return merged(piece[hit], window[hit])

    return least


def remove_repeated_words(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): the words that stay, joined by one space."""

    def keep(batches):
        coder = K.decompressor(shared.value)
        for batch in batches:
            ids, words, removed, kept = batch.column("doc_id"), [], [], []
            for text, spans in zip(K.texts(batch, coder), batch.column("__spans").to_pylist(), strict=True):
                own = (text or b"").split()
                gone = K.covered(spans, len(own), width) if spans else None
                words.append(len(own))
                removed.append(0 if gone is None else int(gone.sum()))
                kept.append(b" ".join(own if gone is None else [w for w, g in zip(own, gone.tolist(), strict=True) if not g]).decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    shared = K.dictionary(docs)
    spans = K.repeated_spans(docs, True, width, gram, sorted_windows(width), shared)
    rows = K.with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), spans, shared)
    return rows.select("doc_id", "text", "__spans").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
