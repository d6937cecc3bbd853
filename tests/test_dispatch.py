"""Dispatch on small models by hand and against brute force: diamonds, circles, overloads, words, what needs each other."""

import random

import pytest

from buildscope.operators import dispatch as D


def model(spark, types, inherits, methods, members=(), holds=()):
    """types: (id, abstract); inherits: (derived, base); methods: (type, name, n_params, virtual, pure)."""
    t = [(i, i.split(".")[-1], i, a, k) for k, (i, a) in enumerate(types)]
    r = [(a, b, "inheritance", k) for k, (a, b) in enumerate(inherits)] + [(a, b, kind, 100 + k) for k, (a, b, kind) in enumerate(holds)]
    return D.Model(
        spark.createDataFrame(t, "id string, name string, qualified string, is_abstract boolean, ord int"),
        spark.createDataFrame(r, "src string, dst string, kind string, ord int"),
        spark.createDataFrame([(a, k, n, ty) for k, (a, n, ty) in enumerate(members)], "type_id string, ord int, name string, type string"),
        spark.createDataFrame([(a, k, n, p, v, u) for k, (a, n, p, v, u) in enumerate(methods)], "type_id string, ord int, name string, n_params long, is_virtual boolean, is_pure boolean"),
    )


DIAMOND = [("A", True), ("B", False), ("C", False), ("D", False), ("E", True)]
INHERITS = [("B", "A"), ("C", "A"), ("D", "B"), ("D", "C"), ("E", "D")]


@pytest.fixture(scope="module")
def diamond(spark):
    methods = [("A", "f", 0, True, True), ("B", "f", 0, True, False), ("D", "f", 2, True, False), ("E", "f", 0, True, False), ("B", "g", 1, False, False), ("D", "g", 1, True, False), ("A", "h", 0, True, True), ("C", "k", 1, True, True), ("C", "k", 2, True, False)]
    return model(spark, DIAMOND, INHERITS, methods, [("C", "held", "std::map<int, D>"), ("C", "no", "Bee *")], [("C", "B", "association"), ("A", "B", "dependency")])


def test_resolution(spark, diamond):
    asked = [("A", "f", None), ("A", "f", 0), ("A", "f", 1), ("B", "g", 1), ("D", "f", None), ("A", "h", 0), ("A", "nothing", None), ("X", "f", None), ("C", "k", 2), ("C", "k", 1), ("A", "f", None)]
    calls, found = D.resolve(diamond, spark.createDataFrame(asked, "static_type string, method string, arity long"))
    got = {(r.static_type, r.method, r.arity): (r.resolution, r.certainty, r.n) for r in calls.collect()}
    assert got == {
        ("A", "f", None): ("cha", "bounded", 2),
        ("A", "f", 0): ("devirtualised", "certain", 1),
        ("A", "f", 1): ("devirtualised", "certain", 1),
        ("B", "g", 1): ("exact", "certain", 1),
        ("D", "f", None): ("devirtualised", "certain", 1),
        ("A", "h", 0): ("unresolved", "unknown", 0),
        ("A", "nothing", None): ("unresolved", "unknown", 0),
        ("X", "f", None): ("unresolved", "unknown", 0),
        ("C", "k", 2): ("devirtualised", "certain", 1),
        ("C", "k", 1): ("unresolved", "unknown", 0),
    }
    targets = sorted((r.static_type, r.method, -1 if r.arity is None else r.arity, r["rank"], r.target, r.reason) for r in found.collect())
    assert targets == [("A", "f", -1, 1, "B::f", "held"), ("A", "f", -1, 2, "D::f", "member"), ("A", "f", 0, 1, "B::f", "held"), ("A", "f", 1, 1, "B::f", "held"), ("B", "g", 1, 1, "B::g", "not virtual"), ("C", "k", 2, 1, "C::k", "none"), ("D", "f", -1, 1, "D::f", "member")]


def test_evidence(spark, diamond):
    got = {r.id: (r.reason, r.holder, r.member) for r in D.evidence(diamond).collect()}
    assert got == {"A": ("abstract", None, None), "B": ("held", "C", "association"), "C": ("none", None, None), "D": ("member", "C", "held"), "E": ("abstract", None, None)}
    other = model(spark, [("L<int>", False), ("M", False)], [], [], [("M", "a", "LL<int>x"), ("M", "b", "const L<int>x")])
    assert {r.id: r.member for r in D.evidence(other).collect()} == {"L<int>": "b", "M": None}


def test_circles_end(spark):
    ring = model(spark, [("A", False), ("B", False)], [("A", "B"), ("B", "A")], [("A", "f", 0, True, False), ("B", "f", 0, True, False)])
    calls, found = D.resolve(ring, spark.createDataFrame([("A", "f", None)], "static_type string, method string, arity long"))
    assert [r.n for r in calls.collect()] == [2]
    below = D.subtrees(ring.relations, spark.createDataFrame([("A",)], "id string")).collect()
    assert {(r.type, r.depth) for r in below} == {("A", 0), ("B", 1)}


def test_expanded(spark, diamond):
    edges = spark.createDataFrame([("m", "A::f", "direct"), ("m", "A::h", "direct"), ("m", "B::g", "direct"), ("A::f", "B::f", "direct"), ("m", "D::f", "direct")], "src string, dst string, resolution string")
    nodes, out = D.expand(diamond, spark.createDataFrame([("m",)], "node string"), edges)
    assert {tuple(r) for r in out.collect()} == {("m", "A::f", "cha"), ("m", "A::h", "unresolved"), ("m", "B::g", "direct"), ("A::f", "B::f", "cha"), ("A::f", "D::f", "rta"), ("B::f", "D::f", "rta"), ("m", "D::f", "cha")}
    assert {r.node for r in nodes.collect()} == {"m", "B::f", "D::f"}


def brute_live(types, inherits, methods, direct, virtual, creates, roots):
    bases = {t: [b for a, b in inherits if a == t] for t, _ in types}
    place = {t: k for k, (t, _) in enumerate(types)}
    has = {(t, m) for t, m, _, _, pure in methods if not pure}

    def above(t):
        seen, front, depth = {t: 0}, [t], 0
        while front:
            depth += 1
            front = [b for b in {b for x in front for b in bases[x]} if b not in seen]
            seen.update(dict.fromkeys(front, depth))
        return seen

    ups = {t: above(t) for t, _ in types}
    functions, live = set(roots), set()
    while True:
        more = {d for s, d in direct if s in functions}
        made = {t for s, t in creates if s in functions}
        for s, static, m in virtual:
            if s in functions:
                for t in live:
                    if static in ups[t] and (owners := [(d, place[b], b) for b, d in ups[t].items() if (b, m) in has]):
                        more.add(f"{min(owners)[2]}::{m}")
        if more <= functions and made <= live:
            return functions, live
        functions, live = functions | more, live | made


@pytest.mark.parametrize("seed", range(3))
def test_live(spark, seed):
    rng = random.Random(seed)
    names = [f"T{k}" for k in range(12)]
    types = [(n, False) for n in names]
    inherits = [(names[k], names[rng.randrange(k)]) for k in range(1, 12)] + [(names[k], names[rng.randrange(k)]) for k in range(2, 12, 3)]
    inherits = list(dict.fromkeys(inherits))
    methods = [(n, m, 0, True, rng.random() < 0.2) for n in names for m in ("f", "g") if rng.random() < 0.6]
    functions = [f"p{k}" for k in range(10)] + [f"{t}::{m}" for t, m, *_ in methods]
    direct = [(rng.choice(functions), rng.choice(functions)) for _ in range(12)] + [("p0", "p0"), ("p1", "p2"), ("p2", "p1")]
    virtual = [(rng.choice(functions), rng.choice(names), rng.choice("fg")) for _ in range(20)]
    creates = [(rng.choice(functions), rng.choice(names)) for _ in range(25)]
    want = brute_live(types, inherits, methods, direct, virtual, creates, ["p0", "p1"])
    got = D.live(
        model(spark, types, inherits, methods),
        spark.createDataFrame(direct, "src string, dst string"),
        spark.createDataFrame(virtual, "src string, static_type string, method string"),
        spark.createDataFrame(creates, "src string, type string"),
        spark.createDataFrame([("p0",), ("p1",)], "node string"),
    )
    assert ({r.node for r in got[0].collect()}, {r.type for r in got[1].collect()}) == want
    none = D.live(model(spark, types, inherits, methods), *(spark.createDataFrame(x, s) for x, s in ((direct, "src string, dst string"), (virtual, "src string, static_type string, method string"), (creates, "src string, type string"))), spark.createDataFrame([], "node string"))
    assert none[0].count() == 0 and none[1].count() == 0
