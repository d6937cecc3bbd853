"""Which dispatch counts, and what guards a transition, on text by hand."""

import pytest

from buildscope.operators import machines as M

ENUM = "enum S { A, B, C, D, E };\n"


def one(text):
    (found,) = [m for m in M.machines(ENUM + text) if m["enum"] == "S"]
    return found


def case(*states):
    return "".join(f"case {s}: x.s = A; break; " for s in states)


@pytest.mark.parametrize(("states", "kind"), [("AB", "switch-case"), ("A", "unknown"), ("ABCDE", "switch-case")])
def test_share_of_states(states, kind):
    """Two of five are 40 per cent; one is too few."""
    found = one(f"void f() {{ switch (x.s) {{ {case(*states)} }} }}")
    assert found["kind"] == kind
    if kind == "switch-case":
        assert found["confidence"] == min(0.95, 0.5 + len(states) / 10) and len(found["transitions"]) == len(states) and found["variable"] == "x.s"


def test_most_transitions_and_ties():
    two = "void f() { switch (y->s) { case A: y->s = B; case B: break; case C: break; } }\nvoid g() { switch (z.s) { case A: z.s = C; case B: z.s = D; } }\nvoid h() { switch (w.s) { case A: w.s = E; case B: w.s = E; } }"
    found = one(two)
    assert found["variable"] == "z.s" and [(a, b) for a, b, *_ in found["transitions"]] == [("A", "C"), ("B", "D")]
    nothing = "void f() { switch (s) { case A: break; case B: break; } if (s == A) { s = B; } }"
    assert one(nothing)["kind"] == "if-else" and one(nothing)["confidence"] == 0.35 + 0.5 / 5


@pytest.mark.parametrize(
    ("body", "label"),
    [
        ("if (a) { if (b) { s = B; } }", "on b"),
        ("if (a) { } s = B;", None),
        ("if (a) x = 1; s = B;", None),
        ("if (a) s = B;", "on a"),
        ("if (a) { q(); } else if (b) { q(); s = B; }", "on b"),
        ("if (f(a) && (b || c)) { while (1) { s = B; } }", "on f(a) && (b || c)"),
        ("go(1); s = B;", "after go()"),
        ("if (x) { go(); } s = B;", None),
        ("return (1); s = B;", None),
        (f"if ({'a' * 101}) {{ s = B; }}", None),
        ("if (a) { /* } */ s = B; }", "on a"),
        ("if (a) { if (b) { } s = B; }", "on a"),
    ],
)
def test_guards(body, label):
    found = one(f"void f() {{ if (outer) {{ switch (s) {{ case A: {body} break; case B: break; }} }} }}")
    assert [(a, b, g) for a, b, g, _ in found["transitions"]] == [("A", "B", label)]


def test_enums():
    got = [(m["enum"], m["states"]) for m in M.machines("enum { X = f(1, 2), Y } E1;\nenum class T : std::uint8_t { P, };\nenum { };\nenum E { Q /* , R */, S = sizeof(int[3]) };\nenum Fwd;\nenum Open { Z")]
    assert got == [("E1", ["X", "Y"]), ("T", ["P"]), ("E", ["Q", "S"])]
    assert M.machines("") == [] and M.ports("") == []


def test_tables():
    text = "void a() { m_state = B; }\nvoid b() { state = A; myState = S::C; }\nint T::c() { return 1; }\nF t[] = { a, &b, c, d, e };\n"
    assert one(text)["kind"] == "unknown"  # two of five are functions of those names
    found = one(text.replace("c, d, e", "T::c, a, a"))
    assert found["kind"] == "dispatch-table" and found["transitions"] == [("A", "B", "via a()", 2), ("B", "C", "via b()", 3), ("D", "B", "via a()", 2), ("E", "B", "via a()", 2)]


def test_files(spark):
    files = spark.createDataFrame([("a.c", ENUM + "void f() { if (s == A) { s = C; } }", 1), ("b.c", None, 2), ("c.c", "", 3)], "file string, text string, line int")
    assert [tuple(r) for r in M.transitions(files).collect()] == [("a.c", "S", "A", "C", None, "if-else", 2)]
    assert M.state_machines(files).count() == 1 and M.io_ports(files).count() == 1 and M.state_machines(files.limit(0)).count() == 0
