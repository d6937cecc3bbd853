"""Edge cases of every operator and brute-force versions on a small table."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from buildscope.llm import chat, decontamination, language_id, lm_scoring, media, near_dedup, packing, quality, substring_dedup, suffix_dedup
from buildscope.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, spans string, node string"


def words(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ru", "te", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    shared, own = words(rng, 60), [words(rng, 120) for _ in range(12)]
    texts = own + [own[0], own[1] + " tail", own[2][:300] + shared, shared + own[3], shared, "a " * 400, "", None, "één tëxt ☃ " * 30, "?!", " \n\t "]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(3, own[3]), (None, shared), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "xx" if d and d % 2 else None, "s", None, "clash", "clash", "clash") for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def removed(rows, width, split):
    """Which tokens of each row a smaller doc_id's window covers."""
    big = 1 << 62
    first = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, big), big if d is None else d)
    for d, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (big if d is None else d):
                gone[i : i + width] = [True] * width
        yield d, w, gone


def order(x):
    return sorted(x, key=str)


def test_repeated_words(docs, rows, empty):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeated_words(docs).collect()]
    want = [(d, len(w), sum(g), b" ".join(x for x, y in zip(w, g) if not y).decode()) for d, w, g in removed(rows, 13, lambda t: (t or "").encode().split())]
    assert order(got) == order(want)
    assert substring_dedup.remove_repeated_words(empty).count() == 0


def test_repeated_bytes(docs, rows, empty):
    got = [(r.doc_id, r.n_bytes, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeated_bytes(docs).collect()]
    want = [(d, len(w), sum(g), hashlib.sha256(bytes(x for x, y in zip(w, g) if not y)).hexdigest()) for d, w, g in removed(rows, 50, lambda t: (t or "").encode())]
    assert order(got) == order(want)
    assert suffix_dedup.cleaned_documents(docs).columns == docs.columns
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


def test_repeats_within_a_document(spark):
    """A very long text of one letter is one piece with many places; so is what rows without a doc_id share."""
    rng = random.Random(9)
    shared = words(rng, 80)
    rows = [(1, "a" * 1_500_000), (2, "b" * 70 + "a" * 1_000), (3, "x " * 200_000), (4, "y " + "x " * 500)] + [(None, f"{i} {shared}") for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.remove_repeated_bytes(docs).collect()}
    assert [got[k] for k in ((1, 1_500_000), (2, 1_070), (3, 400_000), (4, 1_002))] == [0, 1_000, 0, 1_001] and not any(v for k, v in got.items() if k[0] is None)
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.remove_repeated_words(docs).collect()}
    assert got[4, 501] == 500 and sum(got.values()) == 500


def test_packing_round_trip(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    packed = packing.pack(docs, tokenizer_path()).collect()
    assert len({r.sequence_id for r in packed}) == len(packed)
    assert all(r.length & (r.length - 1) == 0 and r.length == len(r.ids) // 4 for r in packed)
    want = order((d, s, tuple(ids[s : s + n])) for d, t in rows for ids in [tok.encode(t or "", add_special_tokens=False).ids + [1]] for s, n in zip(np.cumsum([0, *packing.cuts(len(ids), 2048)]).tolist(), packing.cuts(len(ids), 2048)))
    assert order((r.doc_id, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in packed) == want
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_contamination(spark, docs, rows):
    items = [(7, " ".join(rows[5][1].split()[20:45]).upper()), (8, "☃"), (9, ""), (10, None), (7, rows[5][1][:200]), (11, "tail")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 1):
        got = order((r.doc_id, r.n_words, tuple(r["items"])) for r in decontamination.contamination(docs, bench, block=block).collect())
        want = []
        for d, t in rows:
            own, found = decontamination.plain_words((t or "").encode()) if hasattr(decontamination, "plain_words") else decontamination.C.plain_words((t or "").encode()), set()
            for i, x in items:
                w = decontamination.C.plain_words((x or "").encode())
                n = min(10, len(w))
                if n and any(own[a : a + n] == w[b : b + n] for a in range(len(own) - n + 1) for b in range(len(w) - n + 1)):
                    found.add(str(i))
            want.append((d, len(own), tuple(sorted(found))))
        assert got == order(want)
    assert {r.doc_id for r in decontamination.clean(docs, bench).collect()}.isdisjoint({d for d, _, f in want if f and d is not None})


def test_longest_matches(spark, docs, rows):
    """Maximal matches, their places and lengths, against every diagonal of every pair."""
    items = [(7, " ".join(rows[5][1].split()[20:45])), (8, "☃"), (9, rows[0][1]), (10, "ka lo " + " ".join(rows[4][1].split()[:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in rows:
        own = decontamination.C.plain_words((t or "").encode())
        for i, x in items:
            w = decontamination.C.plain_words(x.encode())
            for shift in range(-len(w) + 1, len(own)):
                n = 0
                for a in range(len(w) + 1):
                    if a < len(w) and 0 <= shift + a < len(own) and own[shift + a] == w[a]:
                        n += 1
                        continue
                    if n >= min(10, len(w)):
                        want.append((str(i), a - n, d, shift + a - n, n))
                    n = 0
    assert order(tuple(r) for r in decontamination.longest_matches(docs, bench).collect()) == order(want) and len(want) > 8


def test_empty_tables(spark, docs, empty):
    """No documents, or no items: nothing is found and nothing lost."""
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(empty, none).count() == 0 and decontamination.clean(empty, none).count() == 0
    assert decontamination.clean(docs, none).count() == docs.count()
    assert not any(r["items"] for r in decontamination.contamination(docs, none).collect())
    assert media.encode(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judged(empty, labels).count() == 0 and quality.accepted(empty, labels).count() == 0
    assert {r.doc_id for r in quality.judged(docs, labels).where("rejected").collect()} == {18, 19, None}
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_near_duplicates(docs, rows, empty):
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id): r.class_id for r in got if r.doc_id is not None}
    assert by[12] == 0 and by[13] == 1 and by[4] == 4 and by[18] == 18
    assert near_dedup.classes(empty).count() == 0
    assert near_dedup.representatives(docs).columns == docs.columns


def test_language(docs, empty):
    names, prototypes = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, names, prototypes).collect()}
    assert names == ["xx"] and got[18].lang_pred == "und" and got[0].lang_pred == "xx" and 0 < got[0].score <= 1
    assert language_id.predict(docs, *language_id.learn(empty)).where("lang_pred <> 'und'").count() == 0


def test_media(docs, rows):
    for r in media.encode(docs).collect():
        assert media.read_wav(bytes(r.media))[-64:] and zlib.crc32(media.read_wav(bytes(r.media))[-64:]) == r.tail_crc32
        assert len(r.media) == r.payload_bytes + 44 and r.payload_bytes % 64 == 0


def test_scores(spark, docs, rows, empty):
    got = lm_scoring.scores(docs, docs.doc_id.eqNullSafe(4)).collect()
    assert len(got) == len(rows)
    assert all(r.score < 0 and r.n_tokens == len((dict_text(rows, r)).split()) + 1 for r in got if r.doc_id is not None and r.doc_id != 3)
    assert lm_scoring.scores(empty, empty.doc_id.eqNullSafe(4)).count() == 0


def dict_text(rows, r):
    return next(t or "" for d, t in rows if d == r.doc_id)


def test_quality(spark, docs, rows):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.rejected for r in quality.judged(docs, labels).collect() if r.doc_id is not None}
    assert not any(got[i] for i in range(12)) and got[18] and got[19]
    assert quality.accepted(docs, labels).columns == docs.columns


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, None, None), (4, 0, "user", "z"), (5, 0, "user", "z"), (None, 0, "user", "q")]
    got = {r.conv_id: r.chat for r in chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {3: "<|user|>\na\n<|assistant|>\nb\n<|unknown|>\n\n", 4: "<|user|>\nz\n", None: "<|user|>\nq\n"}
