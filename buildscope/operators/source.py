"""Functions, types, namespaces and calls in program text (E4, E6), and what comments speak of (SRC8).

Files come as (file, text), a row a file, and are read with comments and literals blanked, so that offsets are
those of the text itself. An opening brace is told by its head, the text since the last brace or
semicolon; spans nest as braces do, so a file costs one pass over its braces.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import carry
from .lexer import blank

# Words before parentheses that name no function.
KEYWORDS = (
    "if", "else", "for", "while", "do", "switch", "case", "return", "sizeof", "typeof", "alignof", "__attribute__", "__asm__", "asm",
    "volatile", "static", "inline", "extern", "const", "struct", "union", "enum", "typedef",
)
#: Words that a head of a function does not name either.
BLOCKS = frozenset(KEYWORDS) | {"catch", "throw", "typeid", "using", "namespace", "template", "explicit", "operator", "decltype", "static_assert"}
SPANS = "file string, kind string, name string, class string, namespace string, start int, body_start int, body_end int, first_line int, last_line int, is_static boolean, is_virtual boolean, bases array<string>, signature string"

_NAME = r"~?[A-Za-z_]\w*"
_PUNCTUATION = re.compile(r"[{};]|^[ \t]*#[^\n]*(?:\\\n[^\n]*)*", re.M)
_SPACE_HEAD = re.compile(rf"\bnamespace\b\s*((?:{_NAME}(?:\s*::\s*)?)*)\s*$")
_TYPE_HEAD = re.compile(rf"\b(class|struct)\s+({_NAME})(?:\s+final)?\s*(?::(?!:)([^(){{}}]*))?$")
_CALLED = re.compile(rf"({_NAME}(?:\s*::\s*{_NAME})*)\s*\(")
_AFTER = re.compile(r"\s*(?:(?:const|override|final|noexcept|volatile|try)\b\s*(?:\([^()]*\))?\s*|&{1,2}\s*|->[^{}]*)*(?::.*)?$", re.S)
_ACCESS = re.compile(r"\b(?:public|private|protected|virtual)\b")


def closing(text: str, at: int) -> int:
    """Place of the parenthesis that closes the one at `at`, or -1."""
    depth = 0
    for m in re.compile(r"[()]").finditer(text, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.start()
    return -1


def function_head(head: str) -> tuple[str, int, int] | None:
    """Name and the places of the parentheses of the function that a head declares, if it does."""
    m = _CALLED.search(head)
    if not m or re.split(r"\W", m[1])[-1] in BLOCKS or re.match(r"\s*(?:else|return|do|case)\b", head):
        return None
    end = closing(head, m.end() - 1)
    return (re.sub(r"\s+", "", m[1]), m.end() - 1, end) if end >= 0 and _AFTER.match(head, end + 1) else None


def spans(text: str) -> list[dict]:
    """Namespaces, types and functions of a text, by the place of their brace; what is never closed is left out."""
    clean = blank(text)
    out, stack, since = [], [], 0
    lines = [m.start() for m in re.finditer("\n", clean)]

    def line(at: int) -> int:
        import bisect

        return bisect.bisect_left(lines, at) + 1

    for m in _PUNCTUATION.finditer(clean):
        at, c = m.start(), m[0]
        if c == "{":
            head = clean[since:at]
            own = _of(head, since)
            if own:
                spaces = [s["name"] for s in stack if s and s["kind"] == "namespace" and s["name"]]
                own |= {"namespace": "::".join(spaces) or None, "body_start": at, "first_line": line(own["start"])}
                if own["kind"] == "function" and own["class"] is None:
                    inside = next((s for s in reversed(stack) if s), None)
                    own["class"] = inside["name"] if inside and inside["kind"] == "class" else None
                out.append(own)
            stack.append(own)
        elif c == "}" and stack:
            own = stack.pop()
            if own:
                own |= {"body_end": at + 1, "last_line": line(at)}
        since = m.end()
    return [s for s in out if "body_end" in s]


def _of(head: str, at: int) -> dict | None:
    start = at + len(head) - len(head.lstrip())
    row = {"class": None, "start": start, "is_static": False, "is_virtual": False, "bases": [], "signature": None}
    if m := _SPACE_HEAD.search(head):
        return row | {"kind": "namespace", "name": re.sub(r"\s+", "", m[1])}
    if m := _TYPE_HEAD.search(head):
        bases = [_ACCESS.sub("", b).strip() for b in (m[3] or "").split(",")]
        return row | {"kind": "class", "name": m[2], "bases": [b for b in bases if b]}
    if found := function_head(head):
        name, _, end = found
        owner, _, last = name.rpartition("::")
        return row | {"kind": "function", "name": last, "class": owner or None, "is_static": bool(re.search(r"\bstatic\b", head)), "is_virtual": bool(re.search(r"\bvirtual\b", head)), "signature": " ".join(head[: end + 1].split())}
    return None


def outlines(files: DataFrame) -> DataFrame:
    """Rows as spans() gives them for each file; a null text has none."""
    names = [f.split()[0] for f in SPANS.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [{"file": f, **s} for f, t in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True) for s in spans(t or "")]
            ints = {"start", "body_start", "body_end", "first_line", "last_line"}
            kinds = {"bases": pa.list_(pa.string()), "is_static": pa.bool_(), "is_virtual": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32() if c in ints else kinds.get(c, pa.string())) for c in names], names=names)

    return files.select("file", "text").mapInArrow(run, SPANS)


def calls(files: DataFrame, extern_prefixes: Sequence[str]) -> DataFrame:
    """Rows (file, caller, callee, is_extern, at): functions of the same file, or of names with one of the prefixes, that a function's body names before a parenthesis.

    Each callee once a caller, at its first place; a function's calls of itself and keywords go. Of two functions of
    one name in a file the last counts.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for f, t in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                clean = blank(t or "")
                bodies = {s["name"]: (s["body_start"], s["body_end"]) for s in spans(t or "") if s["kind"] == "function"}
                for caller, (a, b) in bodies.items():
                    first: dict[str, int] = {}
                    for m in re.compile(r"\b(\w+)\s*\(").finditer(clean, a, b):
                        if m[1] != caller and m[1] not in KEYWORDS:
                            first.setdefault(m[1], m.start())
                    rows += [(f, caller, callee, at) for callee, at in first.items()] or [(f, caller, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], names=["file", "caller", "callee", "at"])

    every = files.select("file", "text").mapInArrow(run, "file string, caller string, callee string, at int")
    known = every.select("file", F.col("caller").alias("callee")).distinct().withColumn("known", F.lit(True))
    extern = F.lit(False)
    for p in extern_prefixes:
        extern = extern | F.startswith("callee", F.lit(p))
    return every.where("callee is not null").join(known.hint("merge"), ["file", "callee"], "left").withColumn("is_extern", extern).where("known or is_extern").select("file", "caller", "callee", "is_extern", "at")


def comments_of(lines: DataFrame, declaration: str, most: int = 5) -> DataFrame:
    """SRC8: rows (file, line_no, name, comment) for lines that match `declaration` (its first group the name): the block comment before each, if only blank lines, fewer than most, lie between; else an empty text.

    lines has (file, line_no, line), line_no counting a file's lines. The first declaration of a name in a file counts.
    Comments are told by the state at the start of each line, and what the last line of one is by
    carry.last_values, so a file may be cut anywhere.
    """
    own = lines.select("file", F.col("line_no").cast("long").alias("line_no"), F.coalesce("line", F.lit("")).alias("line"))
    opened, closed = F.col("line").contains("/*"), F.col("line").contains("*/")
    bare = F.trim("line") == ""
    ends_comment = F.col("line").rlike(r"\*/\s*$")
    start = F.when(opened, F.col("line_no"))
    marked = own.withColumns({"_start": start, "_text": F.when(closed & ends_comment, F.col("line_no")), "_other": F.when(~bare & ~ends_comment, F.col("line_no"))})
    state = carry.last_values(marked, "file", "line_no", ["_start", "_text", "_other"], own=False)
    name = F.regexp_extract("line", declaration, 1)
    found = state.where(F.col("line").rlike(declaration)).withColumn("name", name)
    near = F.col("_text").isNotNull() & (F.coalesce("_other", F.lit(-1)) < F.col("_text")) & (F.col("line_no") - F.col("_text") <= most)
    # the comment's first line: the last that opened one up to its last line
    begin = state.select("file", F.col("line_no").alias("_text"), F.coalesce(F.when(F.col("line").contains("/*"), F.col("line_no")), "_start").alias("_from"))
    told = found.withColumn("_text", F.when(near, F.col("_text"))).join(begin.hint("merge"), ["file", "_text"], "left")
    first = told.groupBy("file", "name").agg(F.min_by(F.struct("line_no", "_from", "_text"), "line_no").alias("d")).select("file", "name", "d.*")
    spoken = first.where("_from is not null").withColumn("n", F.explode(F.sequence("_from", "_text")))
    text = spoken.join(own.select("file", F.col("line_no").alias("n"), F.col("line").alias("_line")).hint("merge"), ["file", "n"])
    words = text.groupBy("file", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "_line"))), lambda x: x["_line"]), "\n").alias("comment"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("comment", r"(?s)^.*/\*+|\*+/\s*$", ""), r"(?m)^\s*\*+ ?|\s+$", ""))
    return first.select("file", "line_no", "name").join(words.hint("merge"), ["file", "name"], "left").withColumn("comment", F.coalesce(clean, F.lit("")))
