"""Sections and symbols of ELF files of 32 and 64 bits and either byte order (SRC6).

A file is read by seeking: first its header and section table, then, dealt over tasks by ranges of symbols, each
range with the part of the string table that its names lie in. So neither a file nor its symbol table need fit
into a task. Files come as (file), opened with pyarrow.fs wherever they lie, or as (file, content).
"""

from __future__ import annotations

import io
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC, SYMTAB, DYNSYM = b"\x7fELF", 2, 11
TYPES = ("notype", "object", "func", "section", "file", "common", "tls")
BINDINGS = ("local", "global", "weak")
NO_SECTION = (0, 0xFFF1, 0xFFF2)
#: Symbols of a range; bytes that are read at a time and blocks of them that are kept.
RANGE, BLOCK, KEPT = 1 << 16, 1 << 18, 64
SAFE = (1 << 53) - 1


class Unreadable(ValueError):
    """What makes a file unreadable; told in the column problem."""


class Blocks:
    """Bytes of a seekable file, read in blocks of which the last ones used are kept."""

    def __init__(self, file, size: int):
        self.file, self.size, self.kept = file, size, OrderedDict()

    def block(self, k: int) -> bytes:
        if k not in self.kept:
            self.file.seek(k * BLOCK)
            self.kept[k] = self.file.read(BLOCK)
            if len(self.kept) > KEPT:
                self.kept.popitem(last=False)
        self.kept.move_to_end(k)
        return self.kept[k]

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise Unreadable(f"read past the end at offset {at}")
        parts = [self.block(k) for k in range(at // BLOCK, (at + max(n, 1) - 1) // BLOCK + 1)]
        return b"".join(parts)[at % BLOCK : at % BLOCK + n]

    def text(self, at: int) -> str:
        """The text up to the next zero, or the end of the file."""
        out = []
        while 0 <= at < self.size:
            part = self.block(at // BLOCK)[at % BLOCK :]
            end = part.find(b"\0")
            out.append(part if end < 0 else part[:end])
            if end >= 0:
                break
            at += len(part)
        return b"".join(out).decode("utf-8", "replace")


def opened(file: str, content: bytes | None) -> Blocks:
    if content is not None:
        return Blocks(io.BytesIO(content), len(content))
    from pyarrow.fs import FileSystem

    where, path = FileSystem.from_uri(file) if "://" in file or file.startswith("file:") else (FileSystem.from_uri("file:///")[0], file)
    held = where.open_input_file(path)
    return Blocks(held, held.size())


def fields(little: bool, wide: bool) -> dict[str, np.dtype]:
    """Layouts of a section's and a symbol's entry; the two widths order a symbol's fields differently."""
    o, a = ("<" if little else ">"), ("u8" if wide else "u4")
    section = [(n, o + (a if n in ("flags", "addr", "offset", "size", "align", "ent_size") else "u4")) for n in ("name", "type", "flags", "addr", "offset", "size", "link", "info", "align", "ent_size")]
    symbol = [("name", o + "u4"), ("info", "u1"), ("other", "u1"), ("section", o + "u2"), ("value", o + a), ("size", o + a)]
    if not wide:
        symbol = [symbol[k] for k in (0, 4, 5, 1, 2, 3)]
    return {"section": np.dtype(section), "symbol": np.dtype(symbol)}


def safe(value) -> int:
    if int(value) > SAFE:
        raise Unreadable("a value is beyond 53 bits")
    return int(value)


def header(b: Blocks) -> dict:
    """Class, byte order, machine and sections."""
    if b.size < 64 or b.read(0, 4) != MAGIC:
        raise Unreadable("no ELF file")
    kind, order = b.read(4, 2)
    if kind not in (1, 2):
        raise Unreadable(f"unknown class {kind}")
    if order not in (1, 2):
        raise Unreadable(f"unknown byte order {order}")
    wide, little = kind == 2, order == 1
    number = lambda at, n: int.from_bytes(b.read(at, n), "little" if little else "big")
    start = safe(number(0x28, 8)) if wide else number(0x20, 4)
    size, count, names = (number(at + (0 if wide else -12), 2) for at in (0x3A, 0x3C, 0x3E))
    if not start or not count:
        raise Unreadable("no section headers")
    layout = fields(little, wide)["section"]
    rows = [np.frombuffer(b.read(start + k * size, layout.itemsize), layout)[0] for k in range(count)]
    sections = [{"index": k} | {c: safe(r[c]) for c in ("type", "flags", "addr", "offset", "size", "link", "ent_size")} for k, r in enumerate(rows)]
    table = sections[names]["offset"] if names < count else 0
    for s, r in zip(sections, rows, strict=True):
        s["name"] = b.text(table + int(r["name"]))
    return {"class": 64 if wide else 32, "little_endian": little, "machine": number(18, 2), "sections": sections}


SECTIONS = "file string, class int, little_endian boolean, machine int, stripped boolean, index int, name string, type long, flags long, addr long, offset long, size long, link int, ent_size long, problem string"


def sections(files: DataFrame) -> DataFrame:
    """SRC6: the sections of files; a file that cannot be read has one row, with its problem. stripped: it has no full symbol table."""
    names = [c.split()[0] for c in SECTIONS.split(", ")]
    given = "content" in files.columns

    def run(batches):
        for batch in batches:
            rows = []
            contents = batch.column("content").to_pylist() if given else [None] * batch.num_rows
            for file, content in zip(batch.column("file").to_pylist(), contents, strict=True):
                try:
                    if given and content is None:
                        raise Unreadable("no content")
                    own = header(opened(file, content))
                    stripped = not any(s["type"] == SYMTAB for s in own["sections"])
                    rows += [{"file": file, "stripped": stripped} | {k: v for k, v in own.items() if k != "sections"} | s for s in own["sections"]]
                except (Unreadable, OSError) as e:
                    rows.append({"file": file, "problem": str(e)})
            kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in SECTIONS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return files.select("file", *(["content"] if given else [])).mapInArrow(run, SECTIONS)


def symbols(files: DataFrame, known: DataFrame | None = None, size: int = RANGE) -> DataFrame:
    """SRC6: rows (file, place, name, value, size, type, binding, section_index, section) of the symbols with a name.

    They are those of the first full symbol table, else of the first dynamic one; known: sections() of the files, if at hand. A
    file is read once for each range of `size` symbols. Symbols that are undefined, absolute or common have no section. Values
    beyond the largest long are negative.
    """
    every = (sections(files) if known is None else known).where("problem is null")
    tables = every.where(F.col("type").isin(SYMTAB, DYNSYM) & (F.col("type") == F.when(F.col("stripped"), DYNSYM).otherwise(SYMTAB)))
    first = tables.groupBy("file").agg(F.min_by(F.struct("class", "little_endian", "offset", "size", "ent_size", "link"), "index").alias("t")).where("t.ent_size > 0")
    strings = every.select("file", F.col("index").alias("_link"), F.col("offset").alias("strings"))
    count = F.floor(F.col("t.size") / F.col("t.ent_size")).cast("long")
    dealt = first.withColumn("_link", F.col("t.link")).withColumn("count", count).where("count > 0").join(strings, ["file", "_link"], "left")
    dealt = dealt.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(size).cast("long"))))
    dealt = dealt.select("file", "from", F.least(F.lit(size).cast("long"), F.col("count") - F.col("from")).alias("n"), F.coalesce("strings", F.lit(0).cast("long")).alias("strings"), "t.class", "t.little_endian", "t.offset", "t.ent_size")
    given = "content" in files.columns
    if given:
        dealt = dealt.join(files.select("file", "content"), "file")
    dealt = dealt.repartition("file", "from")  # a range a task may take

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = opened(r["file"], r.get("content"))
                layout = fields(r["little_endian"], r["class"] == 64)["symbol"]
                raw = np.frombuffer(b.read(r["offset"] + r["from"] * r["ent_size"], r["n"] * r["ent_size"]), np.uint8).reshape(r["n"], r["ent_size"])
                if r["ent_size"] < layout.itemsize:
                    continue
                own = np.ascontiguousarray(raw[:, : layout.itemsize]).view(layout)[:, 0]
                names = [b.text(r["strings"] + int(k)) for k in own["name"]]
                keep = np.array([bool(n) for n in names], bool)
                info = own["info"][keep]
                kind = [TYPES[k] if k < len(TYPES) else "other" for k in (info & 15).tolist()]
                binding = [BINDINGS[k] if k < len(BINDINGS) else "other" for k in (info >> 4).tolist()]
                place = (r["from"] + np.flatnonzero(keep)).astype(np.int64)
                columns = [pa.array([r["file"]] * len(kind), pa.string()), pa.array(place), pa.array([n for n in names if n], pa.string()), pa.array(own["value"][keep].astype(np.int64)), pa.array(own["size"][keep].astype(np.int64)), pa.array(kind, pa.string()), pa.array(binding, pa.string()), pa.array(own["section"][keep].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "place", "name", "value", "size", "type", "binding", "section_index"])

    found = dealt.mapInArrow(run, "file string, place long, name string, value long, size long, type string, binding string, section_index int")
    named = every.select("file", F.col("index").alias("section_index"), F.col("name").alias("section"))
    return found.join(named, ["file", "section_index"], "left").select("file", "place", "name", "value", "size", "type", "binding", "section_index", F.when(~F.col("section_index").isin(*NO_SECTION), F.col("section")).alias("section"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (file) of all files under a folder that are not empty; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("file"))
