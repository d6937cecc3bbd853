"""Packing by power-of-two decomposition.

A document of n tokens (its own and one end token) is cut into runs of 2048 and the
binary parts of what is left, the largest first. Every piece is a sequence by itself, of
a power-of-two length, so no sequence crosses documents and none has padding; sequences
of one length form a bucket, from which a trainer draws batches of equal shape.

Token ids come from a public tokenizer file. Its pre-tokenizer never joins across ASCII
white space, so a text's ids are those of its white-space runs one after the other, and
each worker keeps the ids of words that it has met (WORDS bytes of them, and STEMS).

Everything happens in one pass without a shuffle. sequence_id is the task's partition
number and a count within it; a partition read again gets the same numbers.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each;
other columns are ignored by name.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common as C

LENGTH, END = 2048, 1
#: Bytes of words and ids that a worker keeps, and of words without the punctuation at their end; beyond that it begins anew.
WORDS, STEMS = 24 << 20, 64 << 20
#: Words that are given to the tokenizer at a time, and runs of letters that it is given as one text.
ENCODED = 1 << 10
#: The same two limits where a worker shares its executor with what stages before took.
SPARING = (8 << 20, 24 << 20)

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int"


PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: A letter whose lower case ends in a mark, which joins with punctuation.
DOTTED = "\u0130".encode()


def letters(word: bytes) -> bool:
    """Whether a word is of letters only, also in lower case, which can add marks."""
    return word.isalpha() if word.isascii() else word.decode().lower().isalpha()


def parts(word: bytes) -> tuple[bytes, bytes]:
    """A word up to its last letter or digit and the ASCII punctuation behind that; a word that ends otherwise is one part."""
    stem = word.rstrip(PUNCTUATION)
    if not stem or len(stem) == len(word) or DOTTED in stem or not (stem[-1:].isalnum() if stem[-1] < 128 else stem.decode()[-1].isalnum()):
        return word, b""
    return stem, word[len(stem) :]


def taken(ids: dict[bytes, bytes]) -> int:
    """Bytes of a dictionary of words and ids, with what it and two objects an entry take."""
    return sum(map(len, ids)) + sum(map(len, ids.values())) + 150 * len(ids)


class Encoder:
    """The tokenizer of a file, and the ids of what this worker has met.

    Where the tokenizer takes upper case for lower case and parts punctuation from a letter or digit before it, the ids of a word
    are those of the word in lower case without the ASCII punctuation at its end, and of that. Where the last token of a run of
    letters is marked as such, many runs are encoded as one text. Otherwise words are encoded as they are.
    """

    def __init__(self, path: str, limits: tuple[int, int] = (WORDS, STEMS)):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limits = limits  # of words and stems
        self.words, self.stems, self.size, self.stems_size = {}, {b"": b""}, 0, 0
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        normal, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.folds = normal is not None and pre is not None and normal.normalize_str("AbZ") == "abz" and all(len(pre.pre_tokenize_str(x)) == 2 for x in ("ab,", "ab'", "ab..", "ab$-", "1,", "\u00b2."))
        vocabulary = self.tokenizer.get_vocab() if self.folds else {}
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words as little-endian 32-bit integers."""
        out, single = {}, words
        if self.last.any():
            runs, single = [], []
            for w in words:
                (runs if letters(w) else single).append(w)
            for a in range(0, len(runs), ENCODED):
                part = runs[a : a + ENCODED]
                ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) != len(part):
                    single += part
                    continue
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                out |= {w: raw[x:y] for w, x, y in zip(part, [0, *ends], ends, strict=False)}
        for a in range(0, len(single), ENCODED):
            part = single[a : a + ENCODED]
            got = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            out |= {w: np.array(g.ids, "<u4").tobytes() for w, g in zip(part, got, strict=True)}
        return out

    def table(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words."""
        if self.size > self.limits[0]:  # the words of later texts come from their parts again
            self.words, self.size = {}, 0
        missing = [w for w in words if w not in self.words]
        if not self.folds:
            new = self.encoded(missing)
        else:
            two = [parts(w) for w in missing]
            if self.stems_size > self.limits[1]:
                self.stems, self.stems_size = {b"": b""}, 0
            fresh = self.encoded(list({p for pair in two for p in pair}.difference(self.stems)))
            self.stems |= fresh
            self.stems_size += taken(fresh)
            stems = self.stems
            new = {w: stems[a] + stems[b] if b else stems[a] for w, (a, b) in zip(missing, two, strict=True)}
        self.words |= new
        self.size += taken(new)
        return list(map(self.words.__getitem__, words))

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a column as little-endian 32-bit integers; a null text has none.

        Arrow splits the texts and numbers their words, so only different words are handled one by one.
        """
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)  # a token that is text of its own is not cut or changed
        for a in self.added:
            whole |= np.asarray(pc.match_substring(texts, a))
        out = self.joined(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def joined(self, texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.folds else texts)
        coded = split.flatten().cast(pa.binary()).dictionary_encode()
        ids = self.table(coded.dictionary.to_pylist())
        if not ids:
            return [b""] * len(texts)
        size = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.concatenate(([0], np.cumsum(size[:-1], dtype=np.int64))).astype(np.int32)
        at = np.asarray(coded.indices)
        n = size[at]
        ends = np.cumsum(n, dtype=np.int64)
        place = np.repeat(starts[at] - (ends - n).astype(np.int32), n) if len(ends) and ends[-1] < 1 << 31 else np.repeat(starts[at] - (ends - n), n)
        place += np.arange(len(place), dtype=place.dtype)
        raw = flat[place].tobytes()
        offsets = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
        edge = (4 * np.concatenate(([0], ends))[offsets]).tolist()
        return [raw[a:b] for a, b in zip(edge, edge[1:], strict=False)]


def token_bytes(texts: pa.Array, path: str, limits: tuple[int, int] = (WORDS, STEMS)) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers, by this worker's encoder."""
    return C.held(("tokenizer", path, limits), lambda: Encoder(path, limits))(texts)


def cuts(n: int, length: int) -> list[int]:
    """Lengths of the pieces of n tokens: powers of two, the largest first."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, step: int = 250, limits: tuple[int, int] = (WORDS, STEMS)) -> DataFrame:
    """A row for each piece; ids holds its token ids as little-endian 32-bit integers. step texts are encoded at a time; limits are the bytes of words and stems that a worker keeps."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        sequence = TaskContext.get().partitionId() << 33
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                docs_ = batch.column("doc_id").to_pylist()
                rows = []
                for doc, raw in zip(docs_, token_bytes(batch.column("text"), tokenizer, limits), strict=True):
                    raw += last
                    at, n = 0, len(raw) // 4
                    for size in cuts(n, length):
                        rows.append((doc, at, size, raw[4 * at : 4 * (at + size)], n, sequence, 0, size.bit_length() - 1))
                        at += size
                        sequence += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                pa.default_memory_pool().release_unused()  # what a batch took is not needed as the next one's

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(C.tidied(run), SCHEMA)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences under path, one folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
