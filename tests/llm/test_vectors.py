"""Operators 11 to 13 against brute force: ties, nulls, repeated rows, hot groups, empty tables, clashing columns."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from buildscope.llm import hard_negatives, simhash, whitening
from buildscope.llm.queries import op11_hard_negatives, op12_simhash, op13_whitening

EMBEDDINGS = "vec_id long, embedding array<float>, label int, x string, a int, rank string, block int"


def brute_negatives(rows):
    """Rows are (vec_id, embedding, label)."""
    kept = {}
    for i, v, label in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        x = tuple(math.floor(256 * float(np.float32(c))) for c in v)
        kept[i, label, x] = None
    last = lambda i: (i is None, i or 0)
    out = []
    for key in kept:
        i, label, x = key
        if i is None or i % 100:
            continue
        own = sorted(((-sum(p * q for p, q in zip(x, y)), last(j), j, m) for j, m, y in kept if (j, m, y) != key), key=lambda r: r[:2])
        for s, _, p, _ in [r for r in own if r[3] == label][:5]:
            found = [(j, -t) for t, _, j, m in own if m != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, p, k, j, -s, t) for k, (j, t) in enumerate(found, 1)]
    return sorted(out, key=str)


def random_vectors(rng, n, dims=4):
    rows = []
    for i in range(n):
        v = [round(rng.uniform(-1, 1), 1) for _ in range(dims)]
        rows.append((i if rng.random() < 0.97 else None, v, rng.choice([0, 1, 1, 1, 2])))
    rows += rows[:40] + [(i, rows[0][1], 1) for i in range(300, 330)] + [(100, [0.5] * dims, 1), (200, None, 1), (300, [None] * dims, 1), (400, [float("nan")] * dims, 2), (500, [float("inf")] * dims, 2), (600, [1.0] * dims, None), (-100, [0.3, -0.2], 2), (700, [], 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in rows], EMBEDDINGS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("embeddings"))
    frame(spark, random_vectors(random.Random(5), 420)).repartition(5).write.parquet(f"{at}/embeddings.parquet")
    return at


def test_negatives(spark, folder, monkeypatch):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute_negatives(rows)
    assert len(want) > 300
    assert sorted(map(tuple, op11_hard_negatives(spark, folder).collect()), key=str) == want
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    own = spark.read.parquet(f"{folder}/embeddings.parquet").where(hard_negatives.usable(F.col("embedding")))
    own = own.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), hard_negatives.whole(F.col("embedding"), 256).alias("x"))
    assert sorted(map(tuple, hard_negatives.mine(own, F.col("id") % 100 == 0, block=2).collect()), key=str) == want


def test_negatives_in_parts(monkeypatch):
    """A task's rows come in parts by rising id, whatever their order."""
    import pyarrow as pa

    monkeypatch.setattr(hard_negatives, "ROWS", 7)
    batch = pa.RecordBatch.from_arrays([pa.array([*range(20, 0, -1), None]), pa.array([1] * 21), pa.array([[k, 1] for k in range(20)] + [[9]])], names=["id", "label", "x"])
    got = list(hard_negatives.parts([batch]))
    assert [len(g[0]) for g in got] == [7, 7, 7] and all((np.diff(g[0]) > 0).all() for g in got)
    assert got[2][3].tolist() == [False] * 6 + [True] and got[2][2][-1].tolist() == [9, 0]


def test_negatives_of_few(spark):
    none = spark.createDataFrame([], "id long, label int, x array<long>")
    assert hard_negatives.mine(none, F.col("id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, 1, [3]), (1, 2, [3])], "id long, label int, x array<long>")
    assert hard_negatives.mine(alone, F.col("id") % 100 == 0).count() == 0


def test_products_beyond_doubles():
    a = np.array([[1 << 40, 3], [-(1 << 62), 1]])
    assert hard_negatives.products(a, np.array([[1 << 20, 7], [1 << 10, 0]])).tolist() == [[(1 << 60) + 21, 1 << 50], [-(1 << 63), -(1 << 63)]]
    assert hard_negatives.limits(-7, 30, 90) == (-2, -7) and hard_negatives.limits(7, 30, 90) == (3, 6)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(prints):
    """prints: [(doc_id, print)]; the least doc_id of each row's component."""
    values = sorted({p for _, p in prints})
    root = {v: v for v in values}

    def up(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, v in enumerate(values):
        for w in values[:k]:
            if (v ^ w).bit_count() <= 3 and up(v) != up(w):
                root[up(v)] = up(w)
    least = {}
    for d, p in prints:
        if d is not None:
            least[up(p)] = min(least.get(up(p), d), d)
    return [(d, f"{p:016x}", least.get(up(p))) for d, p in prints]


def test_simhash(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.choice([1, 2, 3, 4, 60, 300])) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    copied = text(200)
    for i in range(200):  # a large group of near copies
        w = copied.split()
        w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((1000 + i, "  ".join(w).upper() if i % 2 else "\n".join(w)))
    rows += [(7000, None), (7001, ""), (None, " \t"), (7002, "a"), (None, "a"), (None, "only this one"), (3, base[3]), (3, base[4]), (7003, "x y " * 1_200_000)]
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, print string, label int, first int").repartition(5)
    want = brute_components([(d, brute_fingerprint(t)) for d, t in rows])
    for block in (1 << 14, 16):
        got = [tuple(r) for r in simhash.near_duplicates(docs, block=block).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_index_finds_all_links(spark):
    """Random values about some centres, many of them alike in some bits, in blocks of a few: same components as all pairs."""
    rng = random.Random(2)
    values = {rng.getrandbits(64) & ~0xFF00 for _ in range(1500)}
    centres = rng.sample(sorted(values), 12)
    for c in centres:
        for _ in range(60):
            c ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            values.add(c)
    values |= {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 7, 0b111, 0b1111000}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.linked(spark.createDataFrame([(v,) for v in signed], "print long"), block=20)
    links = {(r.a % (1 << 64), r.b % (1 << 64)) for r in found.collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    order = {v: k for k, v in enumerate(sorted(values))}
    want = {order[v]: c for v, _, c in ((int(p, 16), p, c) for _, p, c in brute_components([(k, v) for v, k in order.items()]))}
    root = list(range(len(order)))

    def up(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = sorted((up(order[a]), up(order[b])))
        root[b] = a
    assert {k: up(k) for k in range(len(order))} == want and len(set(want.values())) < len(want)


def test_gray_rank(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(300)] + [0, 1, (1 << 64) - 1]
    ranks = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "v long").select(simhash.gray_rank(F.col("v")).alias("r")).collect()
    for v, r in zip(values, ranks):
        rank = r.r + (1 << 63)
        assert rank ^ (rank >> 1) == v


@pytest.mark.parametrize("n", [1, 2, 3, 9, 40])
def test_eigen(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    for m in (a + a.T, np.diag(rng.normal(size=n)), np.ones((n, n)), np.zeros((n, n)), a @ a.T * 1e9):
        values, vectors = whitening.eigen(m)
        assert (np.diff(values) <= 0).all()
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-12 * max(1, np.abs(m).max()) * n)
        assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-12)
        assert np.allclose(m @ vectors.T, vectors.T * values, atol=1e-11 * max(1, np.abs(m).max()) * n)


def test_whitening(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 10)) @ rng.normal(size=(10, 10)) * 0.2 + 1
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)] + [(None, [0.5] * 10, 1), (3, [0.25] * 10, None), (3, [0.25] * 10, None), (9, None, 1), (9, [None] * 10, 1), (9, [float("nan")] * 10, 1), (9, [float("-inf")] * 10, 1), (9, [0.5] * 4, 1), (9, [], 1)]
    frame(spark, rows).repartition(37).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_whitening(spark, str(tmp_path)).collect()
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v, _ in rows[:703]]
    n, total = len(kept), [sum(c) for c in zip(*(v for _, v in kept))]
    a = np.array([v for _, v in kept], float)
    values, vectors = np.linalg.eigh(np.cov(a.T, bias=True))
    values, vectors = values[::-1], vectors.T[::-1]
    white = (a - a.mean(0)) @ vectors[:8].T / np.sqrt(values[:8])
    assert len(got) == 8 * n and {r.n for r in got} == {n} and {r.identity_error < 1e-9 for r in got} == {True}
    assert all(math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9) for r in got)
    sign = {}
    by = {r.vec_id: {} for r in got if r.vec_id not in (3, None)}
    for r in got:
        if r.vec_id in by:
            by[r.vec_id][r.component] = r
    for k, (i, v) in enumerate(kept):
        if i in by:
            for c in range(1, 9):
                sign.setdefault(c, math.copysign(1, by[i][c].whitened * white[k][c - 1]))
                assert math.isclose(by[i][c].whitened, sign[c] * white[k][c - 1], abs_tol=1e-8)
                assert by[i][c].deviation == sum((n * e - s) ** 2 for e, s in zip(v, total))


def test_whitening_of_few(spark):
    schema = "id long, vector array<double>, n int"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1), (2, [], 1)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 1)], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0], 1) for i in range(4)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-12 for r in flat)
    far = whitening.whiten(spark.createDataFrame([(i, [i * 3e13], 1) for i in range(4)], schema)).where("id = 0").first()
    assert far.deviation is None and int(far.deviation_exact) == (1024 * 6 * 3 * 10**13) ** 2
