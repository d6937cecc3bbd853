"""Blanked text equals a scan character by character, whole and in any pieces; carries equal a loop over each file."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from buildscope.operators import carry, lexer


def brute(text):
    """Character by character."""
    out, i, state = [], 0, "code"
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if state == "code":
            if two in ("//", "/*"):
                state, out, i = ("line" if two == "//" else "block"), [*out, "  "], i + 2
                continue
            state = {'"': "string", "'": "char"}.get(c, "code")
            out.append(c)
        elif state == "line":
            state = "code" if c == "\n" else state
            out.append("\n" if c == "\n" else " ")
        elif state == "block":
            if two == "*/":
                state, out, i = "code", [*out, "  "], i + 2
                continue
            out.append("\n" if c == "\n" else " ")
        else:
            if c == "\\":
                out.append(" " * len(two))
                i += 2
                continue
            if c == ('"' if state == "string" else "'"):
                state = "code"
                out.append(c)
            else:
                out.append("\n" if c == "\n" and state == "string" else " ")
        i += 1
    return "".join(out)


TEXT = st.text(alphabet="/*\"'\\\nab é☃", max_size=40)


@settings(max_examples=1500, deadline=None)
@given(TEXT, st.lists(st.integers(0, 40), max_size=6))
def test_blank_in_pieces(text, cuts):
    assert lexer.blank(text) == brute(text)
    ends = sorted({min(c, len(text)) for c in cuts} | {0, len(text)})
    pieces = [text[a:b] for a, b in zip(ends, ends[1:])]
    state, got = lexer.NOTHING, []
    for k, p in enumerate(pieces):
        got.append(lexer.blank(p, state[lexer.CODE], "".join(pieces[k + 1 :])[:1]))
        state = lexer.compose(state, lexer.does(p))
    assert "".join(got) == brute(text)


def test_maps_of_long_texts(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("/*\"'\\\nab") for _ in range(3000))
    whole = lexer.does(text)
    for step in (1, 2, 7, 100):
        monkeypatch.setattr(lexer, "STEP", step)
        assert lexer.does(text) == whole
    state = list(range(9))
    for c in text:
        k = lexer._CLASSES.find(c)
        state = [int(lexer.TABLE[k][s]) for s in state]
    assert bytes(state) == whole


@pytest.mark.parametrize("size", [1 << 20, 7, 1])
def test_blanked(spark, size):
    rng = random.Random(size)
    files = {f"f{k}": "".join(rng.choice(["/", "*", '"', "'", "\\", "\n", "x", " ", "//", "/*", "*/", "word"]) for _ in range(rng.choice([0, 5, 80]))) for k in range(12)}
    rows = []
    for name, text in files.items():
        ends = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(6))})
        parts = [text[a:b] for a, b in zip(ends, ends[1:])] or [None]
        for k in range(len(parts) - 1, -1, -1):  # empty pieces between
            if rng.random() < 0.3:
                parts.insert(k, rng.choice(["", None]))
        rows += [(name, 10 * k, p, "clash") for k, p in enumerate(parts)]
    rng.shuffle(rows)
    got = lexer.blanked(spark.createDataFrame(rows, "file string, piece int, text string, map string"), size).collect()
    for name, text in files.items():
        assert "".join(r.text for r in sorted((r for r in got if r.file == name), key=lambda r: r.piece)) == brute(text)
    assert len(got) == len(rows)
    assert lexer.blanked(spark.createDataFrame([], "file string, piece int, text string")).count() == 0


@pytest.mark.parametrize("size", [1 << 20, 9, 2])
def test_last_values(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), k, rng.choice([None, None, k]), rng.choice([None, str(k)])) for k in range(90)]
    frame = spark.createDataFrame(rows, "file string, line_no int, x int, y string")
    for own in (True, False):
        want, last = [], {}
        for f, k, x, y in rows:
            a, b = last.get(f, (None, None))
            now = (a if x is None else x, b if y is None else y)
            last[f] = now
            want.append((f, k, *(now if own else (a, b))))
        assert sorted(tuple(r) for r in carry.last_values(frame, "file", "line_no", ["x", "y"], size, own).collect()) == sorted(want)


def test_prefixes(spark):
    rows = [(f"f{k % 3}", k, str(k)) for k in range(40)]
    frame = spark.createDataFrame(rows, "file string, n int, x string")
    for size in (1 << 20, 6, 1):
        got = carry.prefixes(frame, "file", "n", lambda r: (r["x"] + ",").encode(), lambda a, b: a + b, b"", size).collect()
        assert {(r.n, bytes(r.before).decode()) for r in got} == {(k, "".join(f"{j}," for j in range(k % 3, k, 3))) for k in range(40)}
        assert got[0].asDict().keys() == {"file", "n", "x", "before"}
    assert carry.prefixes(frame.where(F.lit(False)), "file", "n", lambda r: b"", lambda a, b: a + b, b"").count() == 0
