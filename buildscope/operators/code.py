"""Operators on tables of symbols, calls, syntax nodes and source text."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as R

# The forms in which a function is bound to a name.
BINDINGS = {
    "pointer": r"\(\s*\*\s*([A-Za-z_]\w*)\s*\)\s*\([^)]*\)\s*=\s*&?([A-Za-z_]\w*)\s*[;,)]",
    "field": r"\.(\w+)\s*=\s*&?([A-Za-z_]\w*)\s*[,}]",
}


def participants(symbols: DataFrame, calls: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """M40. Rows (file, name, extern, pos): a file's symbols by line, then its callees in call order, each name once.

    symbols has (file, name, line), calls (file, callee, ord). A name is extern if it is no
    symbol of the file or has one of the prefixes.
    """
    own = symbols.select("file", "name", F.lit(0).alias("part"), F.col("line").cast("long").alias("at"))
    every = own.unionByName(calls.select("file", F.col("callee").alias("name"), F.lit(1).alias("part"), F.col("ord").cast("long").alias("at")))
    first = every.groupBy("file", "name").agg(F.min(F.struct("part", "at")).alias("first"))
    extern = (F.col("first.part") == 1) | R.is_extern(F.col("name"), prefixes)
    return first.select("file", "name", extern.alias("extern"), (F.row_number().over(Window.partitionBy("file").orderBy("first", "name")) - 1).cast("long").alias("pos"))


def context(functions: DataFrame, file: str, message: str, limit: int = 30) -> DataFrame:
    """M23. Names of the file's functions and of those that the message mentions, the first ones by their order; functions has (file, name, ord)."""
    near = F.col("file") == file
    told = F.lit(message.lower()).contains(F.lower("name"))
    first = functions.where(near | told).groupBy("name").agg(F.min(F.struct((~near).alias("far"), "ord")).alias("first"))
    return first.orderBy("first", "name").limit(limit).select("name")


def with_source(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """M33. rows (file, pos, kind, src_line, text) and, before an instruction, its source line where that changes and exists in lines (file, line, source)."""
    known = rows.where("kind = 'insn' and src_line <> 0").join(lines.withColumnRenamed("line", "src_line"), ["file", "src_line"])
    before = F.lag("src_line").over(Window.partitionBy("file").orderBy("pos"))
    new = known.withColumn("before", before).where("before is null or before <> src_line")
    added = new.select("file", "pos", F.lit("source_code").alias("kind"), "src_line", F.col("source").alias("text"), F.lit(0).alias("part"))
    return added.unionByName(rows.select("file", "pos", "kind", "src_line", "text").withColumn("part", F.lit(1)))


def type_usage(tags: DataFrame) -> DataFrame:
    """E12. Distinct rows (type, file) of types that tags (file, inherits, typeref, signature) use."""
    bases = F.transform(F.split(F.coalesce("inherits", F.lit("")), ","), lambda x: F.trim(x))
    first = F.array(F.regexp_extract(F.coalesce("typeref", F.lit("")), r"\b([A-Za-z_]\w*)\b", 1))
    words = F.regexp_extract_all(F.coalesce("signature", F.lit("")), F.lit(r"\b([A-Z][A-Za-z_]\w*)\b"), 1)
    return tags.select("file", F.explode(F.concat(bases, first, words)).alias("type")).where("type <> ''").distinct().select("type", "file")


def complexity(nodes: DataFrame) -> DataFrame:
    """E7. Per function of nodes (function, kind, opcode, ancestors array of (kind, opcode)): paths, hidden ones, deepest decision, statements."""
    seen = R.is_decision(F.col("kind"), F.col("opcode"))
    above = F.size(F.filter("ancestors", lambda a: R.is_decision(a["kind"], a["opcode"])))
    visible, hidden = F.count_if(seen), F.count_if(F.col("kind").isin(*R.HIDDEN_PATHS))
    return nodes.groupBy("function").agg(
        (1 + visible + hidden).alias("cyclomatic"), visible.alias("visible"), hidden.alias("hidden"),
        F.coalesce(F.max(F.when(seen, above + 1)), F.lit(0)).cast("long").alias("max_depth"), F.count_if(F.col("kind").endswith("Stmt")).alias("statements"),
    )


def interrupt_stack(handlers: DataFrame, frames: DataFrame, worst: DataFrame, overhead: int) -> DataFrame:
    """M6. Stack of handlers (name): frames (name, size), worst (name, worst_case, path) and the core's own overhead; null where nothing is known."""
    rows = handlers.join(frames, "name", "left").join(worst, "name", "left")
    depth = F.when(F.size("path") > 0, F.size("path") - 1)
    return rows.select("name", "size", "worst_case", (F.lit(overhead) + F.coalesce("worst_case", "size")).alias("total"), depth.alias("depth"), F.coalesce(depth > 5, F.lit(False)).alias("deep"))


def bindings(files: DataFrame, functions: DataFrame) -> DataFrame:
    """E5. Distinct rows (file, form, name, function) of functions (name) bound in files (file, text)."""
    found = [
        files.select("file", F.lit(form).alias("form"), F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(p), 1).alias("name"), F.regexp_extract_all("text", F.lit(p), 2).alias("function"))).alias("b"))
        for form, p in BINDINGS.items()
    ]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.select("file", "form", "b.*").distinct().join(functions.select(F.col("name").alias("function")).distinct(), "function", "left_semi").select("file", "form", "name", "function")


DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(define|undef|ifdef|ifndef|if|elif|else|endif)\b(.*)")


def ranges(text: str) -> list[tuple[bool, str | None, int, int]]:
    """(inactive, macro, start, end) of text that is not, or not surely, compiled; offsets count characters."""
    out, known, open_, at = [], set(), [], 0  # open_: [active, macro, start, taken, parent]

    def close(frame, end):
        if frame[0] is not True:
            out.append((frame[0] is False, None if frame[0] is False else frame[1], frame[2], end))

    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        m = DIRECTIVE.match(line)
        if not m:
            continue
        word, rest = m[1], m[2].strip()
        name = re.split(r"[\s(]", rest)[0]
        if word == "define":
            known.add(name)
        elif word == "undef":
            known.discard(name)
        elif word in ("if", "ifdef", "ifndef"):
            parent = open_[-1][0] if open_ else True
            active = None
            if word == "if":
                active, name = (False if re.sub(r"\s", "", rest) == "0" else None), None
            elif name in known:
                active = word == "ifdef"
            active = False if parent is False else active
            open_.append([active, name, start, active is True, parent])
        elif open_ and word == "endif":
            close(open_.pop(), start)
        elif open_:
            frame = open_[-1]
            close(frame, start)
            active = False if frame[3] else None if word == "elif" or frame[0] is None else True
            frame[0], frame[2] = (False if frame[4] is False else active), start
            frame[3] = frame[3] or frame[0] is True
    return out


def conditional_ranges(files: DataFrame) -> DataFrame:
    """M17. Rows (file, inactive, macro, start, end) of files (file, text); ranges that are never closed are left out."""

    def run(batches):
        for batch in batches:
            rows = [(f, *r) for f, t in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in ranges(t or "")]
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "inactive", "macro", "start", "end"])

    return files.select("file", "text").mapInArrow(run, "file string, inactive boolean, macro string, start long, `end` long")
