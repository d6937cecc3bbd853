"""Operators 4, 5, 7, 8 and 9 and the pipeline against plain versions; columns whose names clash with what steps use."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from buildscope.llm import chat, language_id, lm_scoring, media, near_dedup, packing, suffix_dedup
from buildscope.llm.queries import ORACLE, tokenizer_path

SYLLABLES = {"en": "the ing and ion ent", "de": "sch ein ung ich ber", "fr": "eau oux que ais ent", "es": "cion ndo que los ado"}


def words(rng, n, lang="en", at_least=1):
    own = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(own) for _ in range(rng.randint(at_least, 4))) for _ in range(n))


def test_names_that_clash(spark):
    rng = random.Random(1)
    shared = words(rng, 60)
    rows = [(i, words(rng, 80) + " " + shared, i, "x", 7, "id", "n") for i in range(6)] + [(6, rows_text := words(rng, 90), 1, "x", 7, "id", "n"), (7, rows_text, 1, "x", 7, "id", "n"), (None, None, 2, "y", 8, "id", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __rid int, __spans string, __id int, _0 string, node string")
    got = {r.doc_id: tuple(r)[2:] for r in near_dedup.representatives(docs).collect()}
    assert got == {r[0]: r[2:] for r in rows if r[0] != 7} and near_dedup.representatives(docs).columns == docs.columns
    out = suffix_dedup.cleaned_documents(docs)
    assert out.columns == docs.columns and {r.doc_id: tuple(r)[2:] for r in out.collect()} == {r[0]: r[2:] for r in rows}
    assert [r.text for r in out.where("doc_id = 7").collect()] == [""]


def test_chat_nulls(spark):
    rng = random.Random(2)
    rows = [(c if c < 40 else None, t, rng.choice(["user", "unknown", None, "bot"]), rng.choice(["x", "y", None, ""])) for c in range(42) for t in range(rng.randint(1, 3))]
    rows += [(50, 0, "u", "hi"), (50, 0, "u", "hi"), (50, 0, "u", "x"), (51, 0, "u", "hi"), (52, None, "u", "hi")]
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = db.execute(ORACLE["op9_chat"]).fetchall()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, h string, last int")
    got = [tuple(r) for r in chat.render(frame).select("conv_id", "n_turns", "chat").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[0] is None for r in got)


def test_base_scores(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([words(rng, rng.randint(1, 40)), "Été  ÉTÉ été\tA a b", "", None, words(rng, 5).upper()])) for i in range(60)] + [(5, "again and again"), (None, "no id")]
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for i, t in rows if i not in held for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), i in held, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, held_out int").repartition(3)
    got = lm_scoring.scores(docs, docs.doc_id.isin(*held) & docs.doc_id.isNotNull()).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and len({r.score for r in got if r.n_tokens == 1}) == 1


def test_near_duplicates_by_all_pairs(spark):
    rng = random.Random(4)
    base = [words(rng, 120, at_least=2) for _ in range(25)]
    rows = list(enumerate(base))
    for k in range(90):
        w = rng.choice(base[:12]).split()
        for _ in range(rng.choice([0, 1, 2, 3, 12])):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((100 + k, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one two"), (303, "one two"), (304, "x " * 30_000)]
    df = Counter(s for _, t in rows for s in set(near_dedup.shingles(t).tolist()))
    n = len(rows)
    weigh = lambda s, tf: tf * (1 + math.log1p(min(n / df[s], n)) / math.log1p(n))
    sets = {i: {s: weigh(s, c) for s, c in Counter(near_dedup.shingles(t).tolist()).items()} for i, t in rows}
    alike = lambda a, b: (m := sum(min(sets[a][s], sets[b][s]) for s in sets[a].keys() & sets[b].keys())) / (sum(sets[a].values()) + sum(sets[b].values()) - m) if sets[a] and sets[b] else 0
    ids = [i for i, _ in rows]
    links = {(a, b): alike(a, b) for k, a in enumerate(ids) for b in ids[:k]}
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, label int")).collect()}
    assert all(got[a] == got[b] for (a, b), s in links.items() if s >= 0.9)
    root = {i: i for i in ids}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), s in links.items():
        if s >= near_dedup.THRESHOLD - 1e-9:
            root[max(up(a), up(b))] = min(up(a), up(b))
    assert all(up(i) == up(got[i]) for i in ids), "texts of one class are linked by similar ones"
    found = sum(got[a] == got[b] for (a, b), s in links.items() if s >= near_dedup.THRESHOLD) / sum(s >= near_dedup.THRESHOLD for s in links.values())
    assert found >= 0.98 and len(set(got.values())) > 20


def test_languages(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.choice([3, 20, 200]), lang), lang) for i in range(240) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(900, None, "en"), (901, "123 ?!", "de"), (902, "", None), (903, "a " * 400_000, None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)
    names, prototypes = language_id.learn(docs.where("doc_id % 5 <> 0"))
    assert names == sorted(SYLLABLES)
    got = {r.doc_id: r for r in language_id.predict(docs, names, prototypes).collect()}
    held = [(i, lang) for i, t, lang in rows if i % 5 == 0 and i < 240]
    assert sum(got[i].lang_pred == lang for i, lang in held) / len(held) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred in names and all(0 <= r.score <= 1 for r in got.values())


def test_audio_features():
    """Resampling by convolution with stuffed zeros, and bands by a direct transform, give what the fast forms give."""
    rng = np.random.default_rng(6)
    for n in (64, 128, 1000 // 64 * 64, 4096):
        x = rng.normal(size=n).astype(np.float32)
        t = np.arange(media.UP * media.TAPS) - (media.UP * media.TAPS - 1) / 2
        h = np.sinc(t / max(media.UP, media.DOWN)) * np.hamming(media.UP * media.TAPS)
        stuffed = np.zeros(n * media.UP)
        stuffed[:: media.UP] = x
        y = np.convolve(stuffed, h / h.sum() * media.UP)[:: media.DOWN][: n * media.UP // media.DOWN]
        got = media.resample(x)
        assert len(got) == n * media.UP // media.DOWN and np.allclose(got, y, atol=1e-4)
        mel = media.log_mel(got)
        padded = np.concatenate((got, np.zeros(max(0, media.FRAME - len(got)))))
        k, m = np.arange(media.FRAME // 2 + 1)[:, None], np.arange(media.FRAME)
        for f in {0, len(mel) // 2, len(mel) - 1}:
            frame = padded[f * media.HOP : f * media.HOP + media.FRAME] * np.hanning(media.FRAME)
            power = np.abs((frame * np.exp(-2j * np.pi * k * m / media.FRAME)).sum(1)) ** 2
            assert np.allclose(mel[f], np.log(np.maximum(power @ media.MEL, media.FLOOR)), atol=1e-2)
    loud = np.full((9, media.BANDS), -3.0)
    loud[3:5], loud[6] = 2.0, -2.95
    assert media.segments(loud).tolist() == [[3, 5]] or media.segments(loud)[0].tolist()[0] == 3


def test_pipeline(spark, tmp_path):
    rng = random.Random(7)
    trusted = [(i, words(rng, rng.randint(60, 120), "en", 2)) for i in range(60)]
    passage, item = words(rng, 70, "en", 2), words(rng, 30, "en", 2)
    rows = [*trusted, (100, trusted[0][1]), (101, " ".join([*trusted[1][1].split()[:-1], "other"])), (102, words(rng, 40) + " " + passage), (103, words(rng, 50) + " " + passage + " tail"), (104, words(rng, 40) + " " + item + " end"), (105, "#$%@ 0x0f [[ ]] " * 60), (106, None), (107, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, __rid int, rid string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(105, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = now
        if name != P.STAGES[-1][0]:
            assert now.columns == docs.columns
    ids = lambda name: {r.doc_id for r in kept[name].select("doc_id").collect()}
    assert ids("quality_classifier") >= set(range(60)) and not ids("quality_classifier") & {105, 106, 107}
    assert ids("minhash_near_dedup") == ids("quality_classifier") - {100, 101}
    texts = {r.doc_id: r.text for r in kept["suffix_array_dedup"].collect()}
    before = {r.doc_id: r.text for r in kept["minhash_near_dedup"].collect()}
    if 103 in texts and 102 in texts:
        assert passage not in texts[103] and passage in texts[102]
    first = {}
    for d in sorted(before):
        raw = before[d].encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if first.setdefault(raw[k : k + 50], d) < d:
                gone[k : k + 50] = True
        assert texts[d] == bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    assert ids("benchmark_decontamination") == ids("suffix_array_dedup") - {104}
    want = packing.pack(kept["benchmark_decontamination"], tokenizer_path())
    key = lambda df: sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in df.collect())
    assert key(kept["power_of_two_packing"]) == key(want) and key(P.run(spark, str(tmp_path))) == key(want)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("text", ["İstanbul, ΣΑΣ. ΑΣ' don't I'M we'll' O'Neil's, áb, Å. ab1, ab'' x's. 's 't.'re ǅ ﬁ. Straße; a_b (ab) <|endoftext|>. ＡＢ． 日本語。, ²a. a².  x y z,", "\x1c a\x1db, \x85 x.", "A" * 3000 + ".", ""])
def test_encoder_of_odd_words(text):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    want = np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    own, given = packing.Encoder(path), pa.array([text])
    assert own(given) == [want] and own(pa.array([None, text, "ab, ab. ab"]).slice(1, 2))[0] == want and own(pa.array([None, ""])) == [b"", b""]
    own.last[:] = False
    own.words, own.stems = {}, {b"": b""}
    assert own(given) == [want]
    own.folds, own.words = False, {}
    assert own(given) == [want] and own(pa.array([], pa.string())) == []
