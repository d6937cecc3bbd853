"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) those
of its letters, rotated by two, one and no places, so order matters. A text's vector
bundles (adds) its trigrams' vectors; a language's prototype bundles those of all its
learning texts. A text gets the language whose prototype has the greatest cosine with it.

Learning is one pass that counts trigrams a language (bounded by languages times 2**18,
summed before the shuffle); as bundling is linear, prototypes follow from the counts on
the driver. Prediction is one pass without a shuffle.

Defined cases: a null text or one without a letter is `und` with score 0, and so is every
text if no language was learned; equal cosines go to the first language by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SIZE, SEED, CODES = 1024, 7, 64
_letters: list[np.ndarray] = []


def codes() -> np.ndarray:
    """A code below 64 for each code point: 0 for what is no letter, 1 to 26 for a to z, the rest hashed."""
    if not _letters:
        table = np.zeros(0x110000, np.uint8)
        at = np.array([i for i in range(0x110000) if chr(i).isalpha()])
        table[at] = 27 + (C.mix(at.astype(np.uint64)) % np.uint64(37)).astype(np.uint8)
        table[97:123] = np.arange(1, 27)
        _letters.append(table)
    return _letters[0]


def trigrams(text: str) -> np.ndarray:
    """Codes of the trigrams of a text's letters; runs of other characters count as one space."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    code = codes()[raw].astype(np.int32)
    code = np.concatenate(([0], code, [0]))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
    code = code[keep]
    if len(code) < 3:  # no letter
        return np.zeros(0, np.int32)
    return code[:-2] << 12 | code[1:-1] << 6 | code[2:]


def letter_vectors(size: int = SIZE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors rotated by two, one and no places."""
    one = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (CODES, size)).astype(np.float32) * 2 - 1
    return np.roll(one, 2, 1), np.roll(one, 1, 1), one


def bundle(kinds: np.ndarray, counts: np.ndarray, letters) -> np.ndarray:
    """Sum of the vectors of trigrams times their counts."""
    out = np.zeros(letters[0].shape[1])
    for a in range(0, len(kinds), 4096):
        k = kinds[a : a + 4096]
        bound = letters[0][k >> 12]
        bound *= letters[1][k >> 6 & 63]
        bound *= letters[2][k & 63]
        out += counts[a : a + 4096].astype(np.float32) @ bound
    return out


def learn(docs: DataFrame, size: int = SIZE, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages by name and their prototypes, each of length 1, from the text and lang of docs."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(trigrams(text))
            for lang, got in by.items():
                total[lang] = total.get(lang, 0) + np.bincount(np.concatenate(got), minlength=CODES**3)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "kind", "n"])

    rows = docs.where("text is not null and lang is not null").selectExpr("cast(text as string) text", "cast(lang as string) lang")
    got = rows.mapInArrow(count, "lang string, kind long, n long").groupBy("lang", "kind").agg(F.sum("n").alias("n")).toPandas()
    names, letters, out = sorted(got["lang"].unique()), letter_vectors(size, seed), []
    for name in names:
        own = got[got["lang"] == name].sort_values("kind")
        v = bundle(own["kind"].to_numpy(), own["n"].to_numpy(), letters)
        out.append(v / (np.linalg.norm(v) or 1))
    return names, np.array(out).reshape(len(names), size)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, lang_pred, score)."""

    def run(batches):
        letters = letter_vectors(prototypes.shape[1], seed)
        for batch in batches:
            said, scores = [], []
            for text in batch.column("text").to_pylist():
                kinds, n = np.unique(trigrams(text), return_counts=True) if text and names else ((), ())
                if not len(kinds):
                    said.append("und"), scores.append(0.0)
                    continue
                v = bundle(kinds, n, letters)
                near = prototypes @ (v / (np.linalg.norm(v) or 1))
                best = int(near.argmax())
                said.append(names[best]), scores.append(min(1.0, max(0.0, float(near[best]))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, lang_pred string, score double")
