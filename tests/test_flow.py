"""Control flow, call sequences and lifetimes against walks of the same programs by recursion, and by hand."""

import random
from collections import Counter

import pytest

from buildscope.operators import flow as W
from buildscope.operators.chains import followed

STATEMENT = "fn string, id string, parent string, slot string, pos int, kind string, text string, init string, update string, label string"


class Program:
    """A random program as nested statements, as rows, and its edges by continuations."""

    def __init__(self, rng, fn, size):
        self.rng, self.fn, self.n, self.rows, self.edges = rng, fn, 0, [], Counter()
        self.labels = {}
        self.body = self.sequence(size, 0, False)
        self.place(self.body, None, "body")

    def sequence(self, size, depth, in_switch):
        return [self.statement(depth) for _ in range(self.rng.randint(0 if depth else 1, size))]

    def statement(self, depth):
        r = self.rng
        kind = r.choice(["simple"] * 4 + ["if", "for", "while", "do", "switch", "break", "continue", "return", "goto", "label", "block", "preproc"] if depth < 4 else ["simple", "break", "continue", "return"])
        self.n += 1
        s = {"id": f"s{self.n}", "kind": kind, "text": f"t{self.n}"}
        if kind in ("if", "preproc"):
            s |= {"then": self.sequence(3, depth + 1, False), "else": self.sequence(2, depth + 1, False)}
        elif kind in ("for", "while", "do", "block"):
            s["body"] = self.sequence(3, depth + 1, False)
            if kind == "for":
                s |= {"init": r.choice([None, "i = 0"]), "update": r.choice([None, "i++"])}
        elif kind == "switch":
            s["body"] = []
            for k in range(r.randint(0, 4)):
                self.n += 1
                s["body"].append({"id": f"s{self.n}", "kind": "case", "label": f"{k}", "body": self.sequence(2, depth + 1, False)})
            if s["body"] and r.random() < 0.5:
                r.choice(s["body"])["label"] = None
        elif kind == "goto":
            s["label"] = f"L{r.randint(0, 3)}"
        elif kind == "label":
            s["label"] = f"L{r.randint(0, 3)}"
            s["body"] = [self.statement(depth + 1)]
            self.labels.setdefault(s["label"], []).append(s)
        return s

    def place(self, seq, parent, slot):
        for pos, s in enumerate(seq):
            s["pos"] = pos
            self.rows.append((self.fn, s["id"], parent, slot, pos, s["kind"], s.get("text"), s.get("init"), s.get("update"), s.get("label")))
            for part in ("then", "else", "body"):
                if part in s:
                    self.place(s[part], s["id"], part)

    def items(self, seq):
        return [s for k, s in enumerate(seq) if not (s["kind"] == "simple" and k and seq[k - 1]["kind"] == "simple")]

    def go(self, src, kind, to, label=None):
        """An edge along a way, which is (node, last kind on it or None, whether it drops labels) or None."""
        if to:
            self.edges[self.fn, src, to[0], to[1] or kind, None if to[2] else label] += 1

    def enter(self, seq, after, ctx):
        """The way into a sequence that goes on to `after`; walks it once for its edges."""
        way = after
        for s in reversed(self.items(seq)):
            way = self.into(s, way, ctx)
        return way

    def into(self, s, after, ctx):
        brk, cont = ctx
        kind, me = s["kind"], s["id"]
        over = lambda way, how, drops=False: way and (way[0], way[1] or how, way[2] or drops)
        if kind == "simple":
            self.go(me, "flow", after)
        elif kind in ("if", "preproc"):
            self.go(me, "true", self.enter(s["then"], after, ctx))
            self.go(me, "false", self.enter(s["else"], after, ctx))
        elif kind in ("for", "while"):
            update = s.get("update")
            back = (f"update:{me}", None, False) if update else (me, "loop-back", False)
            self.go(me, "true", self.enter(s["body"], back, (after, (back[0], None, False))))
            self.go(me, "false", after)
            if update:
                self.go(f"update:{me}", "loop-back", (me, None, False))
            if s.get("init"):
                self.go(f"init:{me}", "flow", (me, None, False))
                return (f"init:{me}", None, False)
        elif kind == "do":
            way = self.enter(s["body"], (me, None, False), (after, (me, None, False)))
            self.go(me, "false", after)
            if way:
                self.go(me, "loop-back", (way[0], "loop-back", False))
            return way
        elif kind == "switch":
            full, fall = after, after
            for c in reversed(s["body"]):
                if c["body"]:
                    full = self.enter(c["body"], fall, (after, cont))
                    fall = over(full, "fallthrough")
                self.go(me, "case", full, c["label"] if c["label"] is not None else "default")
            if all(c["label"] is not None for c in s["body"]):
                self.go(me, "case", after, "no match")
        elif kind == "break":
            return over(brk, "break", True)
        elif kind == "continue":
            return over(cont, "continue", True)
        elif kind == "return":
            self.go(me, "flow", ("exit", None, False))
        elif kind == "goto":
            if s["label"] in self.labels:
                to = min(self.labels[s["label"]], key=lambda x: (x["pos"], x["id"]))
                self.go(me, "goto", (to["id"], None, False))
        elif kind == "label":
            self.go(me, "flow", self.enter(s["body"], after, ctx))
        elif kind == "block":
            return self.enter(s["body"], after, ctx)
        return (me, None, False)

    def all_edges(self):
        self.go("entry", "flow", self.enter(self.body, ("exit", None, False), (None, None)))
        return self.edges


def test_control_flow(spark):
    rng = random.Random(11)
    programs = [Program(rng, f"f{k}", 5) for k in range(120)]
    want = sum((p.all_edges() for p in programs), Counter())
    rows = [r for p in programs for r in p.rows]
    rng.shuffle(rows)
    nodes, edges = W.control_flow(spark.createDataFrame(rows, STATEMENT))
    got = Counter((r.fn, r.src, r.dst, r.kind, r.label) for r in edges.collect())
    assert got == want
    assert {k[3] for k in want} == {"flow", "true", "false", "case", "fallthrough", "loop-back", "break", "continue", "goto"}
    known = {(r.fn, r.node) for r in nodes.collect()}
    assert all((f, n) in known for f, s, d, *_ in want for n in (s, d)) and len(known) == nodes.count()
    texts = {(r.fn, r.node): r.texts for r in nodes.collect()}
    p = programs[0]
    assert all(len(t) == 1 or k[1].startswith(("entry", "exit", "s")) for k, t in texts.items()) and (p.fn, "entry") in texts


def test_chains(spark):
    rows = [("a", k, k + 1 if k < 40 else None, k) for k in range(41)] + [("b", 1, 2, 5), ("b", 2, 1, 6), ("b", 3, 1, 7), ("b", 4, 99, 8)]
    got = followed(spark.createDataFrame(rows, "space string, id int, to int, v long"), ["space"], "id", "to", {"v": lambda a, b: a + b}).collect()
    assert {(r.id, r.v, r.to) for r in got if r.space == "a"} == {(k, sum(range(k, 41)), None) for k in range(41)}
    assert {r.id: r.to is None for r in got if r.space == "b"} == {1: False, 2: False, 3: False, 4: True}


NODE = "file string, id int, parent int, pos int, kind string, name string, type string, line int"


def test_calls(spark):
    rows = [
        (0, None, "FunctionDecl", "f", None, 1), (1, 0, "IfStmt", None, None, 2), (2, 1, "WhileStmt", None, None, 3),
        (3, 2, "CallExpr", None, "int", 9), (4, 3, "ImplicitCastExpr", None, None, 9), (5, 4, "DeclRefExpr", "late", None, 9),
        (6, 2, "CXXMemberCallExpr", None, "void", 4), (7, 6, "MemberExpr", "put", None, 4), (8, 7, "DeclRefExpr", "box", "const ns::Box *", 4),
        (9, 0, "CXXConstructExpr", None, "ns::Box &", 4), (10, 9, "CallExpr", None, "int", 4), (11, 10, "DeclRefExpr", "first", None, 4),
        (12, 0, "CallExpr", None, None, 5), (13, 12, "MemberExpr", "x", None, 5), (14, 0, "CXXMemberCallExpr", None, None, 6), (15, 14, "MemberExpr", "bare", None, 6),
    ]
    nodes = spark.createDataFrame([("f.cpp", i, p, i, k, n, t, line) for i, p, k, n, t, line in rows], NODE)
    got = W.call_sequence(nodes, spark.createDataFrame([("ns::Box::put",)], "name string")).orderBy("step").collect()
    assert [(r.name, r.line, r.guards, r.virtual) for r in got] == [("ns::Box::put", 4, ["if", "while"], True), ("ns::Box::Box", 4, [], False), ("first", 4, [], False), ("bare", 6, [], False), ("late", 9, ["if", "while"], False)]
    assert W.call_sequence(nodes.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_lifetimes(spark, seed):
    rng = random.Random(seed)
    kinds = ["CompoundStmt", "IfStmt", "DeclStmt", "VarDecl", "VarDecl", "VarDecl", "CXXNewExpr", "MaterializeTemporaryExpr", "CallExpr", "ForStmt"]
    rows = []
    for f in ("a", "b"):
        rows.append((f, 0, None, 0, "FunctionDecl", "f", None, 1, 100, None, None))
        for k in range(1, 60):
            parent = rng.choice([None, *range(max(0, k - 8), k), k - 1, k - 1])
            begin = rng.randint(1, 20)
            rows.append((f, k, parent, k, rng.choice(kinds), rng.choice(["v", "w", None]), rng.choice(["Box", "const ns::Box &", "int", "Box *", "Ref &", None]), begin, begin + rng.randint(0, 9), rng.choice([None, "static"]), rng.choice([None, "c"])))
    by = {(r[0], r[1]): r for r in rows}

    def around(r):
        while r[2] is not None:
            r = by[r[0], r[2]]
            if r[4] in W.SCOPES:
                return r[1]
        return None

    bare = lambda t: " ".join((t or "").replace("const", "").replace("*", "").replace("&", "").split())
    want, risky, order = [], [], {}
    for r in rows:
        f, i, _, _, kind, name, type_, begin, _, storage, init = r
        s = around(r)
        if kind == "VarDecl" and name and s is not None:
            if "&" in (type_ or "") and init == "c" and any(x[0] == f and x[2] == i and x[4] == "CallExpr" for x in rows):
                risky.append((f, i, name, begin))
            if not bare(type_) or bare(type_) == "int" or "*" in type_:
                continue
            kept = "static" if storage == "static" else "automatic"
            order[f, s] = order.get((f, s), 0) + 1
            want.append([f, i, name, bare(type_), s, begin, by[f, s][8] if kept == "automatic" else -1, order[f, s] - 1, kept])
        elif kind in ("CXXNewExpr", "MaterializeTemporaryExpr"):
            heap = kind == "CXXNewExpr"
            want.append([f, i, "(heap)" if heap else "(temporary)", bare(type_), s, begin, -1 if heap else begin, -1, "dynamic" if heap else "temporary"])
    for x in want:
        if x[8] == "automatic":
            x[7] = sum(y[8] == "automatic" and (y[0], y[4]) == (x[0], x[4]) and (y[5], y[1]) > (x[5], x[1]) for y in want)
    nodes = spark.createDataFrame(rows, "file string, id int, parent int, pos int, kind string, name string, type string, begin int, end int, storage string, init string")
    types = spark.createDataFrame([("ns::Box", "Box", False, 0), ("Ref", "Ref", True, 1)], "qualified string, name string, has_destructor boolean, ord int")
    scopes, objects, dangling = W.lifetimes(nodes, types)
    assert sorted(map(str, (tuple(r)[:9] for r in objects.collect()))) == sorted(map(str, map(tuple, want)))
    assert sorted(map(tuple, dangling.collect())) == sorted(risky)
    assert {(r.file, r.id, r.parent) for r in scopes.collect()} == {(r[0], r[1], around(r)) for r in rows if r[4] in W.SCOPES}
    assert {r.type: r.has_destructor for r in objects.collect()} == {"Box": False, "ns::Box": False, "Ref": True} | ({"": True, "int": True} if any(x[3] in ("", "int") for x in want) else {})
