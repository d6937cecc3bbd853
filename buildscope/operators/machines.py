"""State machines in program text (E1, E2) and what a file takes in and gives out.

A file is read once into its blanked text, a table of what closes each brace and parenthesis, and the extents of its
decisions. Candidates for an enumeration's dispatch are scored over these: the switch with most transitions, else
comparisons with its values, else a table of handlers.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .lexer import blank
from .source import spans

# Words that name no function that is called.
KEYWORDS = frozenset(
    """if else for while do switch case default return sizeof typedef struct union enum class public private protected new delete throw
    catch try namespace using template static_cast dynamic_cast reinterpret_cast const_cast defined goto break continue static const
    volatile inline extern virtual override explicit friend operator void int char short long float double bool unsigned signed auto
    register typename this nullptr true false __attribute__ NULL""".split()
)
# Shares of states that a switch and a table must cover, confidences, and how far a block may be from its condition.
SWITCH_SHARE, TABLE_SHARE, CONDITION, BEFORE = 0.4, 0.6, 100, 120
COMPARED_WITHIN, TABLE_CONFIDENCE, UNKNOWN_CONFIDENCE = 80, 0.6, 0.15
# Names of variables, handlers, getters and setters.
STATE_VARIABLE = r"\b([A-Za-z_]\w*[Ss]tate\w*)"
HANDLER = r"\b([A-Za-z_]\w*(?:[Cc]allback|[Hh]andler|[Cc]b))"
GETTER, SETTER = re.compile(r"(^|_)[Gg]et([A-Z_]|$)"), re.compile(r"(^|_)[Ss]et([A-Z_]|$)")

_VALUE = r"(?:[A-Za-z_]\w*\s*::\s*)?([A-Za-z_]\w*)"
_ENUM = re.compile(r"\benum\b(?:\s+class\b)?\s*([A-Za-z_]\w*)?\s*(?::\s*[\w:<>\s]+)?\{")
_ENTRY = re.compile(r"([A-Za-z_]\w*)\s*(?:=.+)?", re.S)
_CASE = re.compile(rf"\bcase\s+{_VALUE}\s*:(?!:)|\bdefault\s*:")
_IF = re.compile(r"\bif\s*\(")
_CALL_BEFORE = re.compile(r"([A-Za-z_]\w*)\s*\([^()]*\)\s*;\s*$")
_CLASS = re.compile(r"\bclass\s+([A-Za-z_]\w*)\s*:\s*((?:\s*,?\s*(?:public|private|protected)\s+[\w:]+)+)")


class Source:
    """A file's text with what closes what."""

    def __init__(self, text: str):
        self.text, self.clean = text, blank(text)
        self.close: dict[int, int] = {}
        stack: dict[str, list[int]] = {"}": [], ")": []}
        for m in re.finditer(r"[{}()]", self.clean):
            if m[0] in "{(":
                stack["}" if m[0] == "{" else ")"].append(m.start())
            elif stack[m[0]]:
                self.close[stack[m[0]].pop()] = m.start()
        self.lines = [m.start() for m in re.finditer("\n", self.clean)]
        self.functions = [s for s in spans(text) if s["kind"] == "function"]
        self.branches = list(self._branches())

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.lines, at) + 1

    def _branches(self) -> Iterator[tuple[int, int, int, str]]:
        """(place, start, end, condition) of what each `if` guards: its block, or up to the next semicolon."""
        for m in _IF.finditer(self.clean):
            shut = self.close.get(m.end() - 1)
            if shut is None:
                continue
            condition = self.clean[m.end() : shut].strip()
            block = re.compile(r"\s*\{").match(self.clean, shut + 1)
            end = self.close.get(block.end() - 1, len(self.clean)) if block else self.clean.find(";", shut)
            if condition and len(condition) <= CONDITION:
                yield m.start(), shut + 1, (end if end >= 0 else len(self.clean)) + 1, condition

    def guard(self, at: int, start: int) -> str | None:
        """The condition of the innermost `if`, from a place on, around another; else the call just before it."""
        around = [c for place, a, b, c in self.branches if start <= place < at and a < at + 1 <= b]
        if around:
            return f"on {around[-1]}"
        call = _CALL_BEFORE.search(self.clean[max(start, at - BEFORE) : at])
        return f"after {call[1]}()" if call and call[1] not in KEYWORDS else None

    def depth_from(self, start: int, at: int) -> int:
        part = self.clean[start:at]
        return part.count("{") - part.count("}")


def top_level(text: str) -> list[str]:
    """Parts between commas that lie in no bracket, without blanks around; empty ones go."""
    parts, depth, since = [], 0, 0
    for m in re.finditer(r"[(){}<>\[\],]", text):
        if m[0] in "({<[":
            depth += 1
        elif m[0] in ")}>]":
            depth -= 1
        elif depth <= 0:
            parts.append(text[since : m.start()])
            since = m.end()
    return [p.strip() for p in [*parts, text[since:]] if p.strip()]


def enums(s: Source) -> Iterator[dict]:
    """Enumerations with their values in order; one without a name is called by its alias, or by its line."""
    for m in _ENUM.finditer(s.clean):
        end = s.close.get(m.end() - 1)
        if end is None:
            continue
        found = (_ENTRY.fullmatch(p) for p in top_level(s.clean[m.end() : end]))
        states = [e[1] for e in found if e]
        alias = re.compile(r"\s*([A-Za-z_]\w*)\s*;").match(s.clean, end + 1)
        if states:
            yield {"enum": m[1] or (alias[1] if alias else f"AnonEnum_L{s.line(m.start())}"), "states": states, "line": s.line(m.end() - 1)}


def assigned(s: Source, start: int, end: int, variable: str, states: set[str]) -> Iterator[tuple[str, str | None, int]]:
    """(state, guard, line) of assignments of states to a variable, or to a member of that name."""
    for m in re.compile(rf"[\w.>-]*?{re.escape(variable)}\s*=\s*{_VALUE}\s*;").finditer(s.clean, start, end):
        if m[1] in states:
            yield m[1], s.guard(m.start(), start), s.line(m.start())


def last_part(expression: str) -> str:
    return re.split(r"->|\.", re.sub(r"[()]", "", expression))[-1].strip()


def by_switch(s: Source, states: list[str]) -> dict | None:
    """The switch over enough of the states with most transitions; of equal ones the first."""
    best = None
    for m in re.finditer(r"\bswitch\s*\(", s.clean):
        shut = s.close.get(m.end() - 1)
        begin = s.clean.find("{", shut) if shut is not None else -1
        end = s.close.get(begin)
        if end is None:
            continue
        expression = s.clean[m.end() : shut].strip()
        marks = [c for c in _CASE.finditer(s.clean, begin + 1, end) if not s.depth_from(begin + 1, c.start())]
        known = [c for c in marks if c[1] in states]
        if len(known) < max(1, -(-len(states) * int(SWITCH_SHARE * 10) // 10)):
            continue
        ends = [c.start() for c in marks[1:]] + [end]
        found = [(c[1], *t) for c, stop in zip(marks, ends, strict=True) if c[1] in states for t in assigned(s, c.end(), stop, last_part(expression), set(states))]
        if best is None or len(found) > len(best["transitions"]):
            best = {"kind": "switch-case", "variable": expression, "confidence": min(0.95, 0.5 + len(known) / len(states) * 0.5), "transitions": found}
    return best


def by_comparison(s: Source, states: list[str]) -> dict | None:
    found, variable = [], None
    for state in dict.fromkeys(states):
        for m in re.finditer(rf"([A-Za-z_][\w.>-]*)\s*==\s*(?:[A-Za-z_]\w*\s*::\s*)?{state}\b", s.clean):
            variable = variable or m[1]
            begin = s.clean.find("{", m.end())
            end = s.close.get(begin)
            if begin < 0 or begin - m.end() > COMPARED_WITHIN or end is None:
                continue
            found += [(state, *t) for t in assigned(s, begin + 1, end, last_part(m[1]), set(states))]
    reached = len({f[0] for f in found})
    return {"kind": "if-else", "variable": variable, "confidence": min(0.85, 0.35 + reached / len(states) * 0.5), "transitions": found} if found else None


def by_table(s: Source, states: list[str]) -> dict | None:
    """A list of as many names as there are states, most of them of functions, that assign states."""
    own: dict[str, dict] = {}
    for f in s.functions:
        own.setdefault(name_of(f), f)
    for m in re.finditer(r"=\s*\{", s.clean):
        end = s.close.get(m.end() - 1)
        names = [re.sub(r"[&\s]", "", e) for e in top_level(s.clean[m.end() : end])] if end is not None else []
        if len(names) != len(states) or sum(n in own for n in names) < -(-len(names) * int(TABLE_SHARE * 10) // 10):
            continue
        found = []
        for state, n in zip(states, names, strict=True):
            if f := own.get(n):
                for a in re.compile(rf"{STATE_VARIABLE}\s*=\s*{_VALUE}\s*;").finditer(s.clean, f["body_start"] + 1, f["body_end"] - 1):
                    if a[2] in states:
                        found.append((state, a[2], f"via {n}()", s.line(a.start())))
        if found:
            return {"kind": "dispatch-table", "variable": None, "confidence": TABLE_CONFIDENCE, "transitions": found}
    return None


def name_of(function: dict) -> str:
    """A function's name as it is written, with what is before it."""
    written = f"{function['class']}::{function['name']}"
    return written if function["class"] and re.sub(r"\s+", "", function["signature"]).find(written) >= 0 else function["name"]


def machines(text: str) -> list[dict]:
    """For each enumeration of a text what dispatches on it, with the transitions (from, to, label, line)."""
    s = Source(text)
    out = []
    for e in enums(s):
        for way in (by_switch, by_comparison, by_table):
            found = way(s, e["states"])
            if found and found["transitions"]:
                break
        else:
            found = {"kind": "unknown", "variable": None, "confidence": UNKNOWN_CONFIDENCE, "transitions": []}
        out.append(e | found)
    return out


def ports(text: str) -> list[tuple[str, str, str, str | None, int]]:
    """(name, direction, mechanism, detail, line) of what a text depends on, offers, calls, shares and registers."""
    s = Source(text)
    out = [(m[1], "dependency", "include", None, s.line(m.start())) for m in re.finditer(r"^[ \t]*#include\s*[<\"]([^>\"]+)[>\"]", text, re.M)]
    local = set()
    for f in s.functions:
        name = name_of(f)
        local |= {name, f["name"]}
        if not f["is_static"]:
            kind = "getter" if GETTER.search(name) else "setter" if SETTER.search(name) else "function-call-in"
            virtual = f["is_virtual"] or re.compile(r"[^{}]*\boverride\b").match(s.clean[f["start"] : f["body_start"]])
            out.append((f"{name}()", "input", kind, "virtual" if virtual else None, f["first_line"]))
    called: dict[str, int] = {}
    for m in re.finditer(r"\b([A-Za-z_]\w*)\s*\(", s.clean):
        if len(m[1]) > 1 and m[1] not in KEYWORDS and m[1] not in local:
            called.setdefault(m[1], m.start())
    out += [(f"{n}()", "output", "function-call-out", None, s.line(at)) for n, at in called.items()]
    out += [(m[1], "shared", "global-variable", None, s.line(m.start(1))) for m in re.finditer(r"^[ \t]*extern\s+(?!\")[\w \t*]*?[\s*]([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*;", s.clean, re.M)]
    out += [(f"{m[2]}()", "output", "callback-registration", f"registered as {m[1]}", s.line(m.start())) for m in re.finditer(rf"{HANDLER}\s*=\s*([A-Za-z_]\w*)\s*;", s.clean) if m[2] not in KEYWORDS]
    for m in _CLASS.finditer(s.clean):
        bases = [re.sub(r"\b(?:public|private|protected)\b", "", b).strip() for b in m[2].split(",")]
        out += [(b, "dependency", "class-extension", f"{m[1]} extends {b}", s.line(m.start())) for b in bases if b]
    return out


def _table(files: DataFrame, read, schema: str) -> DataFrame:
    """The rows that read(text) gives for each file, with the file's name."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [(f, *r) for f, t in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in read(t or "")]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("file", "text").mapInArrow(run, schema)


def state_machines(files: DataFrame) -> DataFrame:
    """Rows (file, enum, states, kind, variable, confidence, line)."""
    return _table(files, lambda t: [tuple(m[c] for c in ("enum", "states", "kind", "variable", "confidence", "line")) for m in machines(t)], "file string, enum string, states array<string>, kind string, variable string, confidence double, line int")


def transitions(files: DataFrame) -> DataFrame:
    """Rows (file, enum, src, dst, label, kind, line)."""
    return _table(files, lambda t: [(m["enum"], a, b, label, m["kind"], line) for m in machines(t) for a, b, label, line in m["transitions"]], "file string, enum string, src string, dst string, label string, kind string, line int")


def io_ports(files: DataFrame) -> DataFrame:
    """Rows (file, name, direction, mechanism, detail, line)."""
    return _table(files, ports, "file string, name string, direction string, mechanism string, detail string, line int")
