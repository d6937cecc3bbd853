"""Text output of build tools as typed rows. Lines come as (file, line_no, line), in order of line_no within a file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import carry
from ..operators.core import dedupe_first, dedupe_last

# Type letters and block words of the formats.
NM_TYPES = {
    "T": "function", "t": "function", "W": "weak", "w": "weak", "D": "variable", "d": "variable", "B": "variable", "b": "variable",
    "R": "constant", "r": "constant", "C": "common", "c": "common", "U": "undefined", "A": "absolute", "a": "absolute",
    "V": "weak_obj", "v": "weak_obj", "G": "small_data", "g": "small_data", "S": "small_bss", "s": "small_bss", "I": "indirect", "i": "indirect",
}
NM_LETTERS = "^[TtDdBbRrWwUuAaCcVvGgSsIi]$"
BLOCK_WORDS = ("VERSION", "COMMSETTINGS", "COMMDISPLAY", "COMMCHANNELS", "SEND", "RECEIVE")
HEX_LINE = r"^([0-9a-fA-F]{2})(\s+[0-9a-fA-F]{2})+$"


def lines(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """Lines (file, line_no, line) of all files under path; files are split, so line_no tells the order of a file's lines but is not their count.

    With folders a folder is one file, whose parts follow one another by name, as Spark writes them.
    """
    at, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("_path"), at.alias("_at"), row.alias("_row"), F.col("value").alias("line"))
    file = F.regexp_replace("_path", "/[^/]*$", "") if folders else F.col("_path")
    place = [F.col("_path")] * folders + [F.col("_at"), F.col("_row")]
    return rows.select(file.alias("file"), F.struct(*place).alias("line_no"), "line")


def whole(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, text) for formats that a line does not hold; a file must fit a row."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def name_in(path: Column, key: str = "file") -> Column:
    """The name that a folder key=name of a path stands for."""
    return F.url_decode(F.url_decode(F.regexp_extract(path, f"(?:^|/){key}=([^/]*)", 1)))


def hexadecimal(c) -> Column:
    return F.conv(F.regexp_replace(c, "^0[xX]", ""), 16, 10).cast("long")


def _in_file():
    return Window.partitionBy("file").orderBy("line_no")


def nm(rows: DataFrame) -> DataFrame:
    """SRC4: a symbol a line, in one of four layouts; names with a leading $ go, the first of each (name, addr) stays.

    `addr size type name`, `addr type name`, `type name` and `name type addr size`; a name may hold blanks.
    """
    p, n = F.split(F.trim("line"), r"\s+"), F.size(F.split(F.trim("line"), r"\s+"))
    part = lambda i: F.get(p, i)
    is_hex = lambda i: F.coalesce(part(i).rlike("^[0-9a-fA-F]{6,}$"), F.lit(False))
    is_type = lambda i: F.coalesce(part(i).rlike(NM_LETTERS), F.lit(False))
    rest = lambda i: F.array_join(F.slice(p, i + 1, F.greatest(n - i, F.lit(0))), " ")
    row = lambda addr, size, kind, name: F.struct(addr.alias("addr"), size.alias("size"), kind.alias("type_raw"), name.alias("name"))
    zero, number = F.lit(0).cast("long"), lambda i: hexadecimal(part(i))
    parsed = (
        F.when((n >= 4) & is_hex(0) & is_hex(1) & is_type(2), row(number(0), number(1), part(2), rest(3)))
        .when((n >= 3) & is_hex(0) & is_type(1), row(number(0), zero, part(1), rest(2)))
        .when(~((n >= 3) & is_hex(0)) & (n >= 2) & is_type(0), row(zero, zero, part(0), rest(1)))
        .when(~is_hex(0) & (n >= 3), row(F.when(is_hex(2), number(2)).otherwise(zero), F.when(is_hex(3), number(3)).otherwise(zero), part(1), part(0)))
    )
    own = rows.where((F.trim("line") != "") & ~F.trim("line").endswith(":")).select("file", "line_no", parsed.alias("_r")).where("_r is not null").select("file", "line_no", "_r.*")
    kinds = F.create_map(*(F.lit(x) for kv in NM_TYPES.items() for x in kv))
    own = own.where((F.col("name") != "") & ~F.col("name").startswith("$")).withColumn("type", F.coalesce(F.try_element_at(kinds, F.col("type_raw")), F.lit("other"))).withColumn("is_global", F.col("type_raw").rlike("[A-Z]") & (F.upper("type_raw") == F.col("type_raw")))
    return dedupe_first(own, ["name", "addr"], ["file", "line_no"])


SECTION = r"^(\.\S+)\s+(0x[0-9a-fA-F]+)\s+(0x[0-9a-fA-F]+)\s*$"
UNIT = r"^\s+(\.\S+)\s+(0x[0-9a-fA-F]+)\s+(0x[0-9a-fA-F]+)\s+(\S+)"
SYMBOL = r"^\s+(0x[0-9a-fA-F]{4,})\s+(\S+)\s*$"


def map_entries(rows: DataFrame) -> DataFrame:
    """SRC1, SRC3: sections, units and symbols of linker maps as rows (file, kind, section, name, addr, size, object).

    Reading starts at the memory map's title, or, without one, at the first line of a known
    section. A section, carried from its line to those after it, goes with what it holds if
    its size is 0; units of size 0 go too; symbols have size 0.
    """
    get = lambda pattern, k: F.regexp_extract("line", pattern, k)
    title = F.min(F.when(F.col("line").startswith("Linker script and memory map"), F.col("line_no")))
    known = F.min(F.when(F.col("line").rlike(r"^\.(text|data|bss|rodata|iram|dram|flash)"), F.col("line_no")))
    begin = rows.groupBy("file").agg(F.coalesce(title, known).alias("_from"))  # a row a file
    own = rows.join(begin, "file").where(F.col("_from").isNull() | (F.col("line_no") >= F.col("_from")))
    head = F.when(F.col("line").rlike(SECTION), F.struct(get(SECTION, 1).alias("name"), hexadecimal(get(SECTION, 2)).alias("addr"), hexadecimal(get(SECTION, 3)).alias("size")))
    own = own.select("file", "line_no", "line").withColumn("_head", head).withColumn("_section", F.col("_head"))
    own = carry.last_values(own, "file", "line_no", ["_section"]).where("_section.size > 0")
    row = lambda kind, name, addr, size, obj: F.struct(F.lit(kind).alias("kind"), name.alias("name"), addr.alias("addr"), size.alias("size"), obj.alias("object"))
    none, zero = F.lit(""), F.lit(0).cast("long")
    entry = (
        F.when(F.col("_head").isNotNull(), row("section", F.col("_head.name"), F.col("_head.addr"), F.col("_head.size"), none))
        .when(F.col("line").rlike(UNIT), F.when(hexadecimal(get(UNIT, 3)) > 0, row("unit", get(UNIT, 1), hexadecimal(get(UNIT, 2)), hexadecimal(get(UNIT, 3)), get(UNIT, 4))))
        .when(F.col("line").rlike(SYMBOL) & ~get(SYMBOL, 2).rlike(r"^(0x|\.)"), row("symbol", get(SYMBOL, 2), hexadecimal(get(SYMBOL, 1)), zero, none))
    )
    return own.select("file", "line_no", F.col("_section.name").alias("section"), entry.alias("_e")).where("_e is not null").select("file", "line_no", "section", "_e.*")


def map_discarded(rows: DataFrame) -> DataFrame:
    """SRC2: (file, name, object) of the discarded sections: from the title to the first line that is neither blank, indented nor one of them."""
    pattern = r"^\s+(\.\S+)\s+0x\S+\s+0x\S+\s+(\S+)"
    hit, title = F.col("line").rlike(pattern), F.col("line").contains("Discarded input sections")
    event = F.when(title, True).when((F.trim("line") != "") & ~hit & ~F.col("line").rlike(r"^[ \t]"), False)
    own = carry.last_values(rows.select("file", "line_no", "line", event.alias("_in")), "file", "line_no", ["_in"]).where(F.col("_in") & hit & ~title)
    return own.select("file", "line_no", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("object"))


def sections(headers: DataFrame, sizes: DataFrame) -> DataFrame:
    """SRC5: sections of a header listing; a size listing fills sizes of 0 and adds sections that are missing. The last line of a name counts."""
    a, b = r"^\s*\[\s*\d+\]\s+(\S+)\s+(\S+)\s+([0-9a-fA-F]+)\s+([0-9a-fA-F]+)\s+([0-9a-fA-F]+)", r"^(\S+)\s+(0x[0-9a-fA-F]+|\d+)\s+(0x[0-9a-fA-F]+|\d+)"
    get = lambda p, k: F.regexp_extract("line", p, k)
    number = lambda c: F.when(c.startswith("0x"), hexadecimal(c)).otherwise(c.try_cast("long"))
    h = headers.where(F.col("line").rlike(a)).select("file", "line_no", get(a, 1).alias("name"), get(a, 2).alias("type"), F.conv(get(a, 3), 16, 10).cast("long").alias("addr"), F.conv(get(a, 5), 16, 10).cast("long").alias("size"))
    s = sizes.where(F.col("line").rlike(b)).select("file", "line_no", get(b, 1).alias("name"), number(get(b, 2)).alias("_size"), number(get(b, 3)).alias("_addr"))
    h, s = dedupe_last(h, ["name"], ["file", "line_no"]).drop("file", "line_no"), dedupe_last(s, ["name"], ["file", "line_no"]).drop("file", "line_no")
    both = h.join(s, "name", "full")
    return both.select("name", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("addr", "_addr").alias("addr"), F.coalesce(F.nullif("size", F.lit(0)), "_size", F.lit(0)).alias("size"))


def stack_usage(rows: DataFrame) -> DataFrame:
    """SRC10: `.su` lines; of each (func, base name of the listing) the last stays."""
    pattern = r"^([^:]+):(\d+):\d+:(\S+)\s+(\d+)\s+(\S+)"
    get = lambda k: F.regexp_extract("line", pattern, k)
    base = F.substring_index(F.regexp_replace("file", r"\\", "/"), "/", -1)
    own = rows.where(F.col("line").rlike(pattern)).select(base.alias("source"), F.col("file").alias("_file"), "line_no", get(2).cast("int").alias("at"), get(3).alias("func"), get(4).cast("long").alias("size"), F.regexp_replace(get(5), ",", " ").alias("kind"))
    return dedupe_last(own, ["func", "source"], ["_file", "line_no"]).drop("line_no", "_file")


def trace(rows: DataFrame) -> DataFrame:
    """SRC12: function trace lines as events; lines that fit nothing have kind null, so they can be counted."""
    pattern = r"^\s*(?:([\d.]+)\s*(us|ms|ns|s))?\s*\[\s*(\d+)\]\s*\|(\s*)(.*)$"
    get = lambda k: F.regexp_extract("line", pattern, k)
    body = get(5)
    unit = F.when(get(2) == "ns", 0.001).when(get(2) == "us", 1.0).when(get(2) == "ms", 1e3).when(get(2) == "s", 1e6)
    out, into, leaf = r"^\}\s*/\*\s*(.+?)\s*\*/\s*$", r"^(.+?)\(\)\s*\{\s*$", r"^(.+?)\(\)\s*;\s*$"
    kind = F.when(body.rlike(out), "exit").when(body.rlike(into), "enter").when(body.rlike(leaf), "leaf")
    name = F.when(body.rlike(out), F.regexp_extract(body, out, 1)).when(body.rlike(into), F.regexp_extract(body, into, 1)).when(body.rlike(leaf), F.regexp_extract(body, leaf, 1))
    own = rows.where((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
    depth = F.when(get(3) != "", F.greatest(F.lit(0), F.floor((F.length(get(4)) - 1) / 2)).cast("int"))
    return own.select("file", "line_no", kind.alias("kind"), name.alias("name"), depth.alias("depth"), F.when(get(3) != "", get(3)).cast("int").alias("tid"), (F.when(get(1) != "", get(1)).try_cast("double") * unit).alias("duration_us"))


def record_layouts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC13: (records, entries) of a layout dump; block is the place of a record's separator. A record begins at the separator and needs a footer; an entry's depth is half of its indent.

    Entries are fields, bit fields, bases and table pointers; a base's line has its role in brackets.
    """
    head, entry = r"^\s*(\d+)\s*\|\s*(struct|class|union)\s+(\S.*?)\s*$", r"^(\s*)(?:(\d+)|(\d+):(\d+)-(\d+))\s*\|(\s*)(.*?)\s*$"
    footer, nv = r"\[?sizeof=(\d+),\s*dsize=(\d+),\s*align=(\d+)", r"nvsize=(\d+),\s*nvalign=(\d+)"
    get = lambda p, k: F.regexp_extract("line", p, k)
    begin = F.when(F.col("line").contains("*** Dumping AST Record Layout"), F.col("line_no"))
    own = carry.last_values(rows.select("file", "line_no", "line", begin.alias("block")), "file", "line_no", ["block"]).where("block is not null").where(~F.col("line").contains("*** Dumping AST Record Layout") & (F.trim("line") != ""))
    first = Window.partitionBy("file", "block").orderBy("line_no")
    own = own.withColumn("_n", F.row_number().over(first))
    number = lambda p, k: F.max(F.when(F.col("line").rlike(p), get(p, k)).try_cast("long"))
    is_head = (F.col("_n") == 1) & F.col("line").rlike(head)
    records = own.groupBy("file", "block").agg(F.max(F.when(is_head, get(head, 3))).alias("qualified_name"), F.max(F.when(is_head, get(head, 2))).alias("kind"), number(footer, 1).alias("size_of"), number(footer, 2).alias("data_size"), number(footer, 3).alias("align"), number(nv, 1).alias("nv_size"), number(nv, 2).alias("nv_align"))
    records = records.where("qualified_name is not null and size_of is not null").withColumn("name", F.substring_index("qualified_name", "::", -1))
    label = get(entry, 7)
    base, vptr = r"^(?:struct|class|union)\s+(\S+)\s+\((primary base|base|primary virtual base|virtual base)\)", r"^\((.+) vtable pointer\)$"
    bits = get(entry, 3) != ""
    kind = F.when(label.rlike(vptr), "vtable-pointer").when(label.rlike(r"^\(vbase offset|^\((.+) vbtable pointer\)$"), "vbase-offset").when(label.rlike(base), F.regexp_replace(F.regexp_extract(label, base, 2), " ", "-")).when(bits, "bitfield").otherwise("field")
    name = F.when(label.rlike(vptr), F.regexp_extract(label, vptr, 1)).when(label.rlike(base), F.regexp_extract(label, base, 1)).when(label.contains(" "), F.substring_index(label, " ", -1)).otherwise("")
    offset = F.coalesce(F.nullif(get(entry, 2), F.lit("")), F.nullif(get(entry, 3), F.lit(""))).cast("long")
    entries = own.where((F.col("_n") > 1) & F.col("line").rlike(entry) & (label != "") & ~F.col("line").rlike(footer) & ~F.col("line").rlike(nv))
    entries = entries.select("file", "block", "line_no", offset.alias("offset"), F.greatest(F.lit(0), F.floor((F.length(get(entry, 6)) - 1) / 2)).cast("int").alias("depth"), kind.alias("kind"), name.alias("name"))
    return records, entries.join(records.select("file", "block", "qualified_name"), ["file", "block"])


def size_literal(expr: Column) -> Column:
    """A sum of decimal or hex numbers with K or M; 0 for anything else. Nothing is evaluated."""
    parts = F.transform(F.split(expr, r"\+"), lambda x: F.upper(F.trim(x)))

    def one(x):
        digits = F.regexp_extract(x, r"^(?:0X([0-9A-F]+)|(\d+)([KM]?))$", 2)
        by = F.when(x.endswith("K"), 1024).when(x.endswith("M"), 1 << 20).otherwise(1)
        return F.when(x.rlike(r"^0X[0-9A-F]+$"), F.conv(F.substring(x, 3, 32), 16, 10).cast("long")).when(x.rlike(r"^\d+[KM]?$"), digits.try_cast("long") * by)

    numbers = F.transform(parts, one)
    return F.when(F.exists(numbers, lambda v: v.isNull()), F.lit(0).cast("long")).otherwise(F.aggregate(numbers, F.lit(0).cast("long"), lambda a, v: a + v))


def linker_regions(files: DataFrame) -> DataFrame:
    """SRC7: memory regions of linker scripts (file, text): name, attrs, origin, length, end, type."""
    plain = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    line = r"(?i)(\w+)\s*(?:\(([^)]*)\))?\s*:\s*(?:org|ORIGIN)\s*=\s*([^,]+),\s*(?:len|LENGTH)\s*=\s*([^\n]+)"
    found = F.regexp_extract_all(F.regexp_extract(plain, r"(?s)MEMORY\s*\{([^}]+)\}", 1), F.lit(line), F.lit(0))
    get = lambda k: F.regexp_extract("_m", line, k)
    rows = files.select("file", F.posexplode(found).alias("place", "_m")).select("file", "place", get(1).alias("name"), F.trim(get(2)).alias("attrs"), size_literal(get(3)).alias("origin"), size_literal(get(4)).alias("length"))
    n, a = F.lower("name"), F.lower("attrs")
    kind = F.when(n.contains("itcm"), "itcm").when(n.contains("dtcm") | n.contains("stack"), "dtcm").when(n.contains("dflash") | n.contains("data_flash"), "dflash").when(n.contains("flash") | n.contains("rom") | (a.contains("r") & a.contains("x")), "flash").when(n.contains("ram"), "sram").otherwise("default")
    return rows.withColumn("end", F.col("origin") + F.col("length")).withColumn("type", kind)


def linker_sections(files: DataFrame) -> DataFrame:
    """SRC7: output sections of linker scripts (file, text): name, noload, vma and lma, the regions where they run and where they are stored, and place.

    A section is a name, perhaps a type in parentheses or an address, a body in braces, which may hold braces once, and a
    region. Scripts of several files are read one by one; J18 joins their sections with the regions of any.
    """
    plain = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    body = F.regexp_extract(plain, r"(?s)SECTIONS\s*\{(.+)", 1)
    section = r"(?s)(\.[\w.]+)\s*(\([^)]*\))?\s*(?::\s*(?:AT\s*\([^)]+\)\s*)?)?\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}[^>{}]*>\s*(\w+)(?:\s*AT\s*>\s*(\w+))?"
    get = lambda k: F.nullif(F.regexp_extract("_m", section, k), F.lit(""))
    found = files.select("file", F.posexplode(F.regexp_extract_all(body, F.lit(section), F.lit(0))).alias("place", "_m"))
    return found.select("file", "place", get(1).alias("name"), F.col("_m").rlike(r"\bNOLOAD\b").alias("noload"), get(4).alias("vma"), get(5).alias("lma"))


def call_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC9: (nodes, edges) of call graph dumps (file, text); a label's lines tell frame, its kind, and place. Of nodes of one name the last file's last counts."""
    block = F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)(?:node|edge)\s*:\s*\{[^}]*\}"), F.lit(0))).alias("place", "b")
    blocks = files.select("file", block)
    text = lambda k: F.regexp_replace(F.regexp_extract("b", rf'\b{k}\s*:\s*"((?:[^"\\]|\\.)*)"', 1), r"\\n", "\n")
    nodes = blocks.where(F.col("b").rlike(r"^node")).select("file", F.col("place").alias("_place"), F.trim(text("title")).alias("name"), text("label").alias("label"), F.col("b").rlike(r'shape\s*:\s*"?ellipse').alias("external")).where("name <> ''")
    nodes = dedupe_last(nodes, ["name"], ["file", "_place"])
    size, place = r"(?im)^\s*(\d+)\s+bytes?\s*\(?(static|dynamic(?:,\s*bounded)?)?", r"(?im)^\s*(.+\.(?:c|cpp|cxx|cc|h|hpp))(?::(\d+))?"
    kind = F.lower(F.regexp_extract("label", size, 2))
    nodes = nodes.select("name", "external", F.coalesce(F.nullif(F.regexp_extract("label", size, 1), F.lit("")).cast("long"), F.lit(0)).alias("frame"), kind.contains("dynamic").alias("dynamic"), kind.contains("bounded").alias("bounded"), F.regexp_extract("label", place, 1).alias("source"), F.coalesce(F.nullif(F.regexp_extract("label", place, 2), F.lit("")).cast("int"), F.lit(0)).alias("at"))
    edges = blocks.where(F.col("b").rlike(r"^edge")).select(F.trim(text("sourcename")).alias("src"), F.trim(text("targetname")).alias("dst")).where("src <> '' and dst <> ''")
    return nodes, edges


def last_of_keys(pairs: Column) -> Column:
    """A map of an array of (key, value): of a key that comes more than once the last value."""
    later = lambda x, i: F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"])
    return F.map_from_entries(F.filter(pairs, lambda x, i: ~later(x, i)))


def tags(rows: DataFrame) -> DataFrame:
    """SRC19: tag lines with `key:value` columns, of a key the last; comments and lines of fewer than four columns go."""
    p = F.split("line", "\t")
    pairs = F.transform(F.filter(F.slice(p, 5, 1 << 20), lambda x: F.instr(x, ":") > 1), lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.regexp_replace(x, "^[^:]*:", "").alias("value")))
    extra = last_of_keys(pairs)
    own = rows.where((F.col("line") != "") & ~F.col("line").startswith("!")).where(F.size(p) >= 4)
    get = lambda k: F.try_element_at(F.col("_x"), F.lit(k))
    return own.withColumn("_x", extra).select(p[0].alias("name"), F.regexp_replace(p[1], r"^\./", "").alias("file"), F.coalesce(get("kind"), p[3]).alias("kind"), F.coalesce(get("class"), get("namespace"), get("scope")).alias("scope"), get("inherits").alias("inherits"), get("signature").alias("signature"))


def json_objects(files: DataFrame) -> DataFrame:
    """SRC16: rows (file, place, object) of JSON objects that stand one after another without a list around them; what does not parse ends a file."""
    import pyarrow as pa

    def split(batches):
        import json

        decoder = json.JSONDecoder()
        for batch in batches:
            out = ([], [], [])
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at, place = (text or "").find("{"), 0
                while at >= 0:
                    try:
                        _, end = decoder.raw_decode(text, at)
                    except ValueError:
                        break
                    for column, value in zip(out, (file, place, text[at:end]), strict=True):
                        column.append(value)
                    at, place = text.find("{", end), place + 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["file", "place", "object"])

    return files.select("file", "text").mapInArrow(split, "file string, place long, object string")


def front_matter(files: DataFrame) -> DataFrame:
    """SRC21: rows (file, fields, body) of notes with a head of `key: value` lines between --- lines; of a key the last value counts."""
    head = F.regexp_extract("text", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^\w[\w-]*\s*:"))
    fields = last_of_keys(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))))
    return files.select("file", fields.alias("fields"), F.regexp_replace(F.regexp_replace("text", r"(?s)^---\r?\n.*?\r?\n---\r?\n?", ""), r"^\s+|\s+$", "").alias("body"))


def blocks(rows: DataFrame) -> DataFrame:
    """SRC22: rows (file, block_no, keyword, lines): a block begins after a blank line, or at a known word."""
    blank = F.trim("line") == ""
    own = rows.withColumn("_blank", blank).withColumn("_before", F.coalesce(F.lag("_blank").over(_in_file()), F.lit(True)))
    start = ~F.col("_blank") & (F.col("_before") | F.trim("line").isin(*BLOCK_WORDS))
    own = own.withColumn("block_no", F.sum(start.cast("int")).over(_in_file())).where("not _blank")
    got = own.groupBy("file", "block_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return got.select("file", (F.col("block_no") - 1).alias("block_no"), F.col("_l")[0]["line"].alias("keyword"), F.transform(F.slice("_l", 2, 1 << 20), lambda x: x["line"]).alias("lines"))


def block_text(parsed: DataFrame, eol: str = "\r\n") -> DataFrame:
    """SNK8: rows (file, text): blocks as text again, a blank line between them."""
    one = F.array_join(F.concat(F.array("keyword"), F.col("lines")), eol)
    return parsed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block_no", one.alias("t")))).alias("_b")).select("file", F.concat(F.array_join(F.transform("_b", lambda x: x["t"]), eol + eol), F.lit(eol)).alias("text"))


def compile_entry(entries: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """SRC18: files with the first entry that is, or ends, their path, else the first of the same base name; null if there is none."""
    norm = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/+", "/"))
    base = lambda c: F.substring_index(norm(c), "/", -1)
    e = entries.select("place", F.col("file").alias("entry"), base("file").alias("_b"), norm("file").alias("_f"))
    got = files.select(path).distinct().withColumn("_b", base(path)).join(e, "_b", "left")
    rank = F.when(norm(path).endswith(F.col("_f")), 0).otherwise(1)
    return got.groupBy(path).agg(F.min_by("entry", F.when(F.col("entry").isNotNull(), F.struct(rank, "place"))).alias("entry"))


def project_settings(files: DataFrame) -> DataFrame:
    """SRC25: (file, includes, defines) of IDE project files, each value once and in order; null lists for text that is no XML."""
    import pyarrow as pa

    def read(batches):
        from xml.etree import ElementTree

        def values(root, kind):
            found = (v.get("value") for o in root.iter("option") if o.get("valueType") == kind for v in o.findall("listOptionValue"))
            return list(dict.fromkeys(re.sub('^"|"$', "", v) for v in found if v is not None))

        for batch in batches:
            out = ([], [])
            for text in batch.column("text").to_pylist():
                try:
                    root = ElementTree.fromstring(text or "")
                except ElementTree.ParseError:
                    root = None
                for column, kind in zip(out, ("includePath", "definedSymbols"), strict=True):
                    column.append(None if root is None else values(root, kind))
            yield pa.RecordBatch.from_arrays([batch.column("file"), *(pa.array(c, pa.list_(pa.string())) for c in out)], names=["file", "includes", "defines"])

    return files.select("file", "text").mapInArrow(read, "file string, includes array<string>, defines array<string>")


def file_kinds(paths: DataFrame, path: str, kinds: dict[str, str], pruned: tuple[str, ...] = (".git", "build")) -> DataFrame:
    """SRC23: paths outside pruned folders with their kind by extension; others go."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), ext)
    keep = ~F.exists(F.split(path, "/"), lambda p: p.isin(*pruned))
    return paths.where(keep).withColumn("kind", kind).where("kind is not null")
