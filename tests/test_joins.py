"""Joins over tables of many files are merges: what a stored column takes on disk says little of what it takes in memory."""

import pytest

from buildscope.operators import constructs as C
from buildscope.operators import dispatch as D
from buildscope.operators import flow as W
from buildscope.operators import located as L
from buildscope.operators import longest as G
from buildscope.operators import source as S
from buildscope.plans import queries as Q

NODE = "file string, id int, parent int, pos int, kind string, name string, type string, line int, begin int, end int, storage string, init string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        ("f", 0, None, 0, "FunctionDecl", "f", None, 1, 1, 9, None, None), ("f", 1, 0, 1, "IfStmt", None, None, 2, 2, 8, None, None), ("f", 2, 1, 2, "CallExpr", None, None, 3, 3, 3, None, None),
        ("f", 3, 2, 3, "DeclRefExpr", "go", None, 3, 3, 3, None, None), ("f", 4, 1, 4, "VarDecl", "r", "Ref &", 4, 4, 4, None, "c"), ("f", 5, 4, 5, "CallExpr", None, None, 4, 4, 4, None, None),
    ]
    return spark.createDataFrame(rows, NODE)


def test_call_sequence_broadcasts_no_nodes(nodes):
    got = W.call_sequence(nodes)
    assert "Broadcast" not in plan(got)
    assert [(r.name, r.guards) for r in got.collect()] == [("go", ["if"])]


def test_call_sequence_deals_nodes_once(spark, nodes, monkeypatch):
    plans, cut = [], W.cut
    monkeypatch.setattr(W, "cut", lambda df: plans.append(plan(df)) or cut(df))
    monkeypatch.setattr(W, "followed", None)  # nothing is deep
    got = W.call_sequence(nodes)
    assert sum(p.count("Exchange") for p in [*plans, plan(got)]) == 1
    assert [(r.name, r.guards) for r in got.collect()] == [("go", ["if"])]
    plans.clear()
    assert W.call_sequence(nodes.repartition(3, "file"), dealt=True).count() == 1
    assert sum(p.count("Exchange") for p in plans) == 1


def test_call_sequence_of_deep_and_circular_files(spark):
    deep = [("f", k, k - 1 if k else None, k, "IfStmt" if k % 2 else "ForStmt", None, None, k, k, k, None, None) for k in range(40)]
    deep += [("f", 40, 39, 40, "CXXConstructExpr", None, "A", 9, 9, 9, None, None), ("f", 41, 3, 41, "CXXConstructExpr", None, "B", 8, 8, 8, None, None)]
    flat = [("g", 0, None, 0, "IfStmt", None, None, 1, 1, 1, None, None), ("g", 1, 0, 1, "CXXConstructExpr", None, "n::C", 5, 5, 5, None, None), ("g", 2, 77, 2, "CXXConstructExpr", None, "D", 5, 5, 5, None, None)]
    circle = [("h", 1, 2, 1, "IfStmt", None, None, 1, 1, 1, None, None), ("h", 2, 1, 2, "IfStmt", None, None, 1, 1, 1, None, None), ("h", 3, 2, 3, "CXXConstructExpr", None, "E", 1, 1, 1, None, None)]
    got = {(r.file, r.step, r.name): r.guards for r in W.call_sequence(spark.createDataFrame(deep + flat + circle, NODE)).collect()}
    words = ["if" if k % 2 else "for" for k in range(40)]
    assert set(got.pop(("h", 0, "E::E"))) == {"if"}
    assert got == {("f", 0, "B::B"): words[:4], ("f", 1, "A::A"): words, ("g", 0, "n::C::C"): ["if"], ("g", 1, "D::D"): []}


def test_lifetimes_follow_only_what_is_between_scopes(nodes, monkeypatch):
    monkeypatch.setattr(W, "followed", None)
    scopes, objects, dangling = W.scopes(nodes), W.objects(nodes), W.dangling(nodes)
    assert not any("Broadcast" in plan(x) for x in (scopes, objects, dangling))
    assert {(r.id, r.parent) for r in scopes.collect()} == {(0, None), (1, 0)}
    assert [(r.id, r.scope, r.destroyed) for r in objects.collect()] == [(4, 1, 8)]
    assert [(r.id, r.line) for r in dangling.collect()] == [(4, 4)]


def test_declared_objects_are_not_followed_nor_dealt_by_type(spark, nodes, monkeypatch):
    monkeypatch.setattr(W, "followed", None)
    more = [("f", 6, 1, 6, "DeclStmt", None, None, 5, 5, 5, None, None), ("f", 7, 6, 7, "VarDecl", "x", "ns::Box", 5, 5, 5, None, None)]
    types = spark.createDataFrame([("ns::Box", "Box", False, 0)], "qualified string, name string, has_destructor boolean, ord int")
    objects = W.objects(nodes.unionByName(spark.createDataFrame(more, NODE)), types)
    assert "hashpartitioning(type" not in plan(objects)
    assert sorted((r.id, r.scope, r.destroyed, r.rank, r.has_destructor) for r in objects.collect()) == [(4, 1, 8, 1, True), (7, 1, 8, 0, False)]


def test_comments_broadcast_no_lines(spark):
    lines = spark.createDataFrame([("a", 1, "/* one */"), ("a", 2, ".x :"), ("a", 3, ".y :")], "file string, line_no long, line string")
    got = S.comments_of(lines, r"^\s*(\.\w+)\s*:")
    assert "Broadcast" not in plan(got)
    assert {(r.name, r.comment) for r in got.collect()} == {(".x", "one"), (".y", "")}


def test_longest_ways_broadcast_no_nodes(spark, monkeypatch):
    plans, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(plan(df)) or cut(df))
    edges = spark.createDataFrame([(3, 1), (4, 1), (4, 3), (5, 4), (5, 3)], "src long, dst long")
    got = G.longest(edges, spark.createDataFrame([(k, 1) for k in (1, 3, 4, 5)], "node long, weight int"))
    assert {r.node: r.worst for r in got.collect()} == {1: 1, 3: 2, 4: 3, 5: 4}
    assert not any("Broadcast" in p for p in [*plans, plan(got)])


def test_constructs_are_not_dealt_by_type(spark):
    node = NODE + ", col int, mangled string, cast string, cleanups boolean, array boolean"
    nodes = spark.createDataFrame([("f", k, None, k, "CXXConstructExpr", None, t, k, k, k, None, None, 1, None, None, None, None) for k, t in enumerate(["ns::Box", "Cup", None])], node)
    got = C.node_constructs(nodes, destructors=spark.createDataFrame([("ns::Box",)], "type string"))
    assert "hashpartitioning(_type" not in plan(got)
    assert sorted((r.line, r.subject, r.certain) for r in got.collect()) == [(0, "ns::Box", True), (1, "Cup", False), (2, None, False)]


def test_subtrees_compare_types_of_several_bases_alone(spark, monkeypatch):
    monkeypatch.setattr(D, "cut", lambda df: df)  # whole plans
    relations = spark.createDataFrame([("B", "A", "inheritance"), ("C", "B", "inheritance"), ("A", "C", "inheritance")], "src string, dst string, kind string")
    got = D.subtrees(relations, spark.createDataFrame([("A",), ("B",)], "id string"))
    assert sorted(map(tuple, got.collect())) == [("A", "A", 0), ("A", "B", 1), ("A", "C", 2), ("B", "A", 2), ("B", "B", 0), ("B", "C", 1)]


def test_calls_meet_targets_once(spark):
    row = lambda text, *rows: spark.createDataFrame(rows, text)
    types = row("id string, name string, qualified string, is_abstract boolean, ord int", ("a", "A", "A", False, 0), ("b", "B", "B", False, 1))
    methods = row("type_id string, ord int, name string, n_params long, is_virtual boolean, is_pure boolean", ("a", 0, "f", 0, True, False), ("b", 0, "f", 2, True, False))
    model = D.Model(types, row("src string, dst string, kind string, ord int", ("b", "a", "inheritance", 0)), row("type_id string, ord int, name string, type string", ("a", 0, "m", "B")), methods)
    calls, targets = D.resolve(model, row("static_type string, method string, arity int", ("A", "f", None), ("A", "f", 1), ("A", "f", 2)))
    assert plan(targets).count("Exchange hashpartitioning(root") <= 2  # methods of a static type, and types with those above
    assert {(r.arity, r.resolution, r.n) for r in calls.collect()} == {(None, "rta", 2), (1, "devirtualised", 1), (2, "rta", 2)}
    assert [(r.arity, r.rank, r.type) for r in targets.orderBy("arity", "rank").collect()] == [(None, 1, "B"), (None, 2, "A"), (1, 1, "A"), (2, 1, "B"), (2, 2, "A")]


def test_every_pair_is_an_equi_join(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 3)  # 24 values a list
    left = spark.createDataFrame([(k % 3 if k else None, k if k % 10 else None) for k in range(90)] + [(1, 7)] * 40 + [(9, 1)], "c int, a long")
    right = spark.createDataFrame([(k % 4 if k else None, f"m{k}" if k % 7 else None) for k in range(50)] + [(8, "m")], "c int, b string")
    got, want = L.every_pair(left, right, "c", "a", "b"), left.join(right, "c")
    key = lambda df: sorted(map(str, df.collect()))
    assert got.dtypes == want.dtypes and key(got) == key(want)
    assert L.every_pair(left, right.limit(0), "c", "a", "b").count() == 0


def test_fan_out_takes_little_disk(spark, tmp_path):
    """A million rows, which took two bytes each where the methods of 50 classes alternated; one class is the work of many tasks."""
    spark.range(2500).selectExpr("id div 50 l_suppkey", "id l_partkey").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(20000).selectExpr("id p_partkey", "50 p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    df = Q.QUERIES["J20_override_fanout"](spark, str(tmp_path))
    df.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 1_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 500_000
    assert df.where("class = 7").rdd.glom().map(len).filter(bool).count() > 1
