"""Program text with comments and literals blanked at equal length (SRC24), scanned in pieces of any size.

Reading C or C++ text is a finite automaton of nine states, and what a piece of text does is a map from the
state before it to the state after it, nine bytes. Maps compose, so the pieces of one file are read
in parallel: each piece's map first, then the state before each piece (carry.prefixes), then each
piece's text once more from that state. A slash at the end of a piece opens a comment if the next piece goes on so;
the first character of that piece is looked up for it.

Comments become spaces but for line ends; of a string its quotes and line ends stay, of a character its quotes;
a backslash takes the character after it with it. What is not closed goes on to the end of the file.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import carry
from .graph import cut

CODE, SLASH, LINE, BLOCK, STAR, STRING, STRING_ESCAPE, CHAR, CHAR_ESCAPE = range(9)
_CLASSES = "/*\"'\\\n"
#: Characters that are composed at a time.
STEP = 1 << 14


def _table() -> np.ndarray:
    """The state after each class of character (the last: any other) in each state."""
    steps = {
        CODE: {"/": SLASH, '"': STRING, "'": CHAR},
        SLASH: {"/": LINE, "*": BLOCK, '"': STRING, "'": CHAR},
        LINE: {"\n": CODE},
        BLOCK: {"*": STAR},
        STAR: {"*": STAR, "/": CODE},
        STRING: {'"': CODE, "\\": STRING_ESCAPE},
        CHAR: {"'": CODE, "\\": CHAR_ESCAPE},
    }
    rest = {SLASH: CODE, STAR: BLOCK, STRING_ESCAPE: STRING, CHAR_ESCAPE: CHAR}
    return np.array([[steps.get(s, {}).get(c, rest.get(s, s)) for s in range(9)] for c in [*_CLASSES, "x"]], np.uint8)


TABLE = _table()
NOTHING = bytes(range(9))


def compose(a: bytes, b: bytes) -> bytes:
    """What a and then b do."""
    return a.translate(b.ljust(256, b"\0"))


_STEPS = {c: TABLE[k].tobytes().ljust(256, b"\0") for k, c in enumerate([*_CLASSES, "x"])}
_PLAIN = re.compile(f"[^{re.escape(_CLASSES)}]+")
#: Characters up to which a text is read one by one.
SHORT = 1 << 10


def does(text: str | None) -> bytes:
    """The map of a piece of text: the state after it for each state before it."""
    if len(text or "") <= SHORT:
        out = NOTHING
        for c in _PLAIN.sub("x", text or ""):
            out = out.translate(_STEPS[c])
        return out
    codes = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    kinds = np.full(len(codes), len(_CLASSES), np.uint8)
    for k, c in enumerate(_CLASSES):
        kinds[codes == ord(c)] = k
    again = np.zeros(len(kinds), bool)
    again[1:] = (kinds[1:] == len(_CLASSES)) & (kinds[:-1] == len(_CLASSES))
    kinds, out = kinds[~again], NOTHING  # doing it again, any other character changes nothing
    for at in range(0, len(kinds), STEP):
        maps = TABLE[kinds[at : at + STEP]]
        while len(maps) > 1:
            odd = maps[len(maps) // 2 * 2 :]
            maps = np.concatenate([np.take_along_axis(maps[1::2], maps[0 : len(maps) // 2 * 2 : 2].astype(np.intp), 1), odd])
        out = compose(out, maps[0].tobytes())
    return out


# What is left of a comment or literal in each state, and its end; what opens one in code.
_QUOTED = r"([^{q}\\]*(?:\\.[^{q}\\]*)*\\?)({q}?)"
_REST = {
    LINE: re.compile(r"([^\n]*)()"),
    BLOCK: re.compile(r"([^*]*(?:\*(?!/)[^*]*)*)((?:\*/)?)"),
    STAR: re.compile(r"(?:()(/)|([^*]*(?:\*(?!/)[^*]*)*)((?:\*/)?))"),
    STRING: re.compile(_QUOTED.format(q='"'), re.S),
    STRING_ESCAPE: re.compile("(.?)" + _QUOTED.format(q='"'), re.S),
    CHAR: re.compile(_QUOTED.format(q="'"), re.S),
    CHAR_ESCAPE: re.compile("(.?)" + _QUOTED.format(q="'"), re.S),
}
_OPENS = re.compile(r"//|/\*|[\"']")
_STATES = {"//": LINE, "/*": BLOCK, '"': STRING, "'": CHAR}
_INSIDE = re.compile(r"\\.|[^\n]", re.S)


def _spaced(state: int, parts: tuple) -> str:
    """What is left of a comment or literal, with blanks in place of what goes."""
    parts = [p for p in parts if p is not None]
    if state in (LINE, BLOCK, STAR):
        return re.sub(r"[^\n]", " ", "".join(parts))
    escaped = " " * len(parts[0]) if state in (STRING_ESCAPE, CHAR_ESCAPE) else ""
    body, shut = parts[-2:]
    return escaped + (" " * len(body) if state in (CHAR, CHAR_ESCAPE) else _INSIDE.sub(lambda m: " " * len(m[0]), body)) + shut


def blank(text: str, state: int = CODE, after: str = "") -> str:
    """The text from a state on, blanked; after: the character that follows it, if any."""
    out, at = [], 0
    if state == SLASH:
        state = {"/": LINE, "*": BLOCK}.get(text[:1], CODE)
        if state != CODE:
            out, at = [" "], 1
    if state != CODE:
        m = _REST[state].match(text, at)
        out.append(_spaced(state, m.groups()))
        at = m.end()
    while m := _OPENS.search(text, at):
        inner = _STATES[m[0]]
        rest = _REST[inner].match(text, m.end())
        out += [text[at : m.start()], m[0] if inner in (STRING, CHAR) else "  ", _spaced(inner, rest.groups())]
        at = rest.end()
    last = text[at:]
    if last.endswith("/") and after and after in "/*":
        last = last[:-1] + " "
    return "".join([*out, last])


def blanked(pieces: DataFrame, size: int = carry.ROWS) -> DataFrame:
    """SRC24: pieces (file, piece, text) with comments and literals blanked; a file's texts by `piece`, a number, are its text.

    A null text is an empty one.
    """
    own = pieces.select("file", F.col("piece").cast("long").alias("piece"), F.coalesce("text", F.lit("")).alias("text"))

    def summaries(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "piece", "text")), pa.array([does(t) for t in texts], pa.binary()), pa.array([t[:1] or None for t in texts], pa.string())], names=["file", "piece", "text", "map", "first"])

    known = cut(own.mapInArrow(summaries, "file string, piece long, text string, map binary, first string"))  # read several times
    before = carry.prefixes(known.select("file", "piece", "map"), "file", "piece", lambda row: row["map"], compose, NOTHING, size)
    # from the end of the file on, the last first character is that of the next piece that has one
    after = carry.last_values(known.select("file", (-F.col("piece")).alias("_back"), F.col("first").alias("after")), "file", "_back", ["after"], size, own=False)

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("text", "before", "after")]
            out = [blank(text, state[CODE], next_ or "") for text, state, next_ in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("piece"), pa.array(out, pa.string())], names=["file", "piece", "text"])

    every = known.select("file", "piece", "text").join(before.select("file", "piece", "before").hint("merge"), ["file", "piece"]).join(after.select("file", (-F.col("_back")).alias("piece"), "after").hint("merge"), ["file", "piece"])
    return every.mapInArrow(run, "file string, piece long, text string")
