"""Listings of disassemblers and of debug information (SRC11, SRC15, F11, M34). Lines come as (file, line_no, line).

What a line owes to lines before it (the record it belongs to, the source line in force, its parent) is
carried over ranges of a file, so a listing may be larger than any task.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as R
from ..operators import carry
from ..operators.graph import cut

# Mnemonics of the instruction set that load, store and branch.
LOADS = ("ldr", "ldrb", "ldrh", "ldrsb", "ldrsh", "ldrd", "ldm", "ldmia", "ldmdb", "pop", "vldr", "vldm", "vldmia", "vldmdb", "ldrex", "ldrexb", "ldrexh")
STORES = ("str", "strb", "strh", "strd", "stm", "stmia", "stmdb", "push", "vstr", "vstm", "vstmia", "vstmdb", "strex", "strexb", "strexh")
BRANCHES = (
    "b", "bl", "bx", "blx", "bxj", "cbz", "cbnz", "tbb", "tbh", "beq", "bne", "blt", "bgt", "ble", "bge", "bhi", "blo", "bhs", "bls",
    "bcc", "bcs", "bmi", "bpl", "bvs", "bvc", "bal",
)
# The forms of a disassembler's lines, and what ends a source file's name.
LABEL_LINE = r"^([0-9a-fA-F]+)\s+<([^>]+)>:\s*$"
CODE_LINE = r"^\s*([0-9a-fA-F]+):(?:\t([0-9a-fA-F ]+?)\t|\s+((?:[0-9a-fA-F]{2}\s)+)\s*)([a-zA-Z][a-zA-Z0-9_.]*)(?:[ \t]+(.*))?$"
PLACE_LINE = r"^(.+\.(?:c|cpp|cxx|cc|h|hpp|s|asm))(?::(\d+))?(?:$|\s)"
SIGNATURE_LINE = r"^\w[\w:~<>*&, ]*\([^)]*\)\s*(?:const\s*)?:"
# Address ranges of the memory map, [from, to).
FLASH, SRAM, PERIPHERALS, NULL_WINDOW = (0x00000000, 0x10000000), (0x20000000, 0x40000000), (0x40000000, 0xE0000000), 0x100


def hexadecimal(c) -> Column:
    return F.conv(F.regexp_replace(c, "^0[xX]", ""), 16, 10).cast("long")


def number(c: Column) -> Column:
    """The number that a text begins with, in hexadecimal after 0x; null if there is none."""
    digits = F.regexp_extract(F.trim(c), r"^(0x[0-9a-f]+|\d+)", 1)
    return F.when(digits == "", None).when(digits.startswith("0x"), hexadecimal(digits)).otherwise(digits.try_cast("long"))


def disassembly(rows: DataFrame, x86: bool = False, size: int = carry.ROWS) -> DataFrame:
    """SRC11: typed records (file, line_no, kind, addr, raw_bytes, mnemonic, operands, is_load, is_store, is_branch, source, line, function, text).

    kind is label, insn, source_loc, func_sig, source_code or blank. A plain line is source code only after a place, a
    signature or more source code; other lines that fit nothing are left out. line is the place's own line, for
    source code and instructions that of the last place that names one, else 0; function is the last label's name.
    """
    text = F.trim("line")
    got = lambda pattern, k, c="line": F.regexp_extract(c, pattern, k)
    kind = (
        F.when(text.rlike(LABEL_LINE), "label")
        .when(F.col("line").rlike(CODE_LINE), "insn")
        .when(text.rlike(PLACE_LINE) & ~text.startswith("Disassembly"), "source_loc")
        .when(text.rlike(SIGNATURE_LINE), "func_sig")
        .when((text == "") | text.startswith("Disassembly"), "blank")
        .when(~text.startswith("."), "plain")
    )
    own = rows.select("file", "line_no", F.coalesce("line", F.lit("")).alias("line")).withColumns({"kind": kind, "text": text}).where("kind is not null")
    place_line = F.coalesce(got(PLACE_LINE, 2, "text").try_cast("long"), F.lit(0).cast("long"))
    marks = own.withColumns({
        "open": F.when(F.col("kind").isin("source_loc", "func_sig"), True).when(F.col("kind") != "plain", False),
        "at": F.when((F.col("kind") == "source_loc") & (place_line > 0), place_line),
        "function": F.when(F.col("kind") == "label", got(LABEL_LINE, 2, "text")),
    })
    state = carry.last_values(marks, "file", "line_no", ["open", "at", "function"], size)
    state = state.where((F.col("kind") != "plain") | F.col("open")).withColumn("kind", F.when(F.col("kind") == "plain", "source_code").otherwise(F.col("kind")))
    insn = F.col("kind") == "insn"
    mnemonic = F.regexp_replace(F.lower(got(CODE_LINE, 4)), r"\.(w|n|wide|narrow)$", "")
    operands = F.trim(F.regexp_replace(F.trim(got(CODE_LINE, 5)), r"\s*;.*$", ""))
    named = state.withColumns({"mnemonic": F.when(insn, mnemonic), "operands": F.when(insn, operands)})
    if x86:
        does = R.x86_access(F.col("mnemonic"), F.col("operands"))
    else:
        does = F.struct(*(F.col("mnemonic").isin(*words).alias(name) for name, words in (("is_load", LOADS), ("is_store", STORES), ("is_branch", BRANCHES))))
    return named.withColumn("does", F.when(insn, does)).select(
        "file",
        "line_no",
        "kind",
        F.when(insn, hexadecimal(got(CODE_LINE, 1))).when(F.col("kind") == "label", hexadecimal(got(LABEL_LINE, 1, "text"))).alias("addr"),
        F.when(insn, F.trim(F.concat(got(CODE_LINE, 2), got(CODE_LINE, 3)))).alias("raw_bytes"),
        "mnemonic",
        "operands",
        "does.is_load",
        "does.is_store",
        "does.is_branch",
        F.when(F.col("kind") == "source_loc", got(PLACE_LINE, 1, "text")).alias("source"),
        F.when(F.col("kind") == "source_loc", place_line).when(F.col("kind").isin("source_code", "insn"), F.coalesce("at", F.lit(0).cast("long"))).alias("line"),
        "function",
        F.when(F.col("kind") != "blank", F.col("text")).otherwise("").alias("text"),
    )


def fault(target: Column, flash=FLASH, sram=SRAM, peripherals=PERIPHERALS, null_window: int = NULL_WINDOW) -> Column:
    """what access to a target address of an instruction (is_load, is_store, is_branch, mnemonic, operands, recent_branch) may have gone wrong, as a struct (fault, confidence), or null. The first rule that fits counts."""
    inside = lambda r: (target >= r[0]) & (target < r[1])
    load, store, branch, name = F.col("is_load"), F.col("is_store"), F.col("is_branch"), F.col("mnemonic")
    says = lambda kind, sure: F.struct(F.lit(kind).alias("fault"), F.lit(sure).alias("confidence"))
    low, operands = target < null_window, F.lower("operands")
    return (
        F.when(low & (load | store), says("null_deref", "high"))
        .when(low & branch, says("bad_branch", "high"))
        .when(store & inside(flash), says("write_to_flash", "high"))
        .when((load | store) & inside(peripherals), says("peripheral_access", "high"))
        .when(branch & name.isin("bx", "blx"), says("bad_branch", "medium"))
        .when(name.isin("ldrh", "strh", "ldrsh") & (target % 2 == 1), says("unaligned_access", "high"))
        .when(name.isin("ldr", "str", "ldrd", "strd") & (target % 4 != 0), says("unaligned_access", "high"))
        .when(inside(sram) & F.col("recent_branch"), says("iaccviol", "medium"))
        .when((load | store) & (operands.contains("[sp") | operands.contains("sp,")), says("stack_overflow", "low"))
    )


def recent_branches(records: DataFrame) -> DataFrame:
    """Records with recent_branch, whether of the instructions among the five records before a row of its function one of the last two branches."""
    before = Window.partitionBy("file", "function").orderBy("line_no").rowsBetween(-5, -1)
    last = F.filter(F.collect_list(F.when(F.col("kind") == "insn", F.col("is_branch"))).over(before), lambda x: x.isNotNull())
    return records.withColumn("_last", last).withColumn("recent_branch", F.exists(F.slice("_last", F.greatest(F.size("_last") - 1, F.lit(1)), 2), lambda x: x)).drop("_last")


def faults(records: DataFrame, targets: DataFrame, size: int = carry.ROWS, **ranges) -> DataFrame:
    """rows (file, target, addr, mnemonic, function, fault, confidence): the instruction at or before each target of its file, and what went wrong.

    targets has (file, target). The lowest bit of a target marks the instruction set and does not count; a target before
    all instructions, or of no known fault, has nulls.
    """
    known = recent_branches(records).where("kind = 'insn'").groupBy("file", "addr").agg(F.min_by(F.struct("addr", "line_no", "mnemonic", "operands", "is_load", "is_store", "is_branch", "recent_branch", "function"), "line_no").alias("insn"))
    asked = targets.select("file", (F.col("target") - F.col("target") % 2).alias("target")).distinct()
    place = lambda at, mark: F.struct(at.alias("at"), F.lit(mark).alias("mark")).alias("place")
    both = known.select("file", place(F.col("addr"), 0), "insn").unionByName(asked.select("file", place(F.col("target"), 1), F.lit(None).cast(known.schema["insn"].dataType).alias("insn")))
    found = carry.last_values(both, "file", "place", ["insn"], size).where("place.mark = 1").select("file", F.col("place.at").alias("target"), "insn.*")
    return found.withColumn("f", fault(F.col("target"), **ranges)).select("file", "target", "addr", "mnemonic", "function", "f.*")


def resolved_sources(places: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Rows (source, path): the file that a source place of debug information means, or null.

    The first that exists of: the path itself, if absolute; its last one to four parts under root; else the file
    of its name that comes first, by depth and then by path, anywhere under root but in hidden folders. files has (path).
    """
    root = root.rstrip("/")
    own = places.select("source").distinct()
    parts = F.filter(F.split(F.regexp_replace("source", r"\\", "/"), "/"), lambda p: (p != "") & ~p.contains(":"))
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(4))), lambda n: F.concat(F.lit(root + "/"), F.array_join(F.slice("parts", -n, n), "/")))
    tried = own.withColumn("parts", parts).withColumn("base", F.element_at("parts", -1)).where(F.size("parts") > 0)
    tried = tried.withColumn("tries", F.concat(F.array(F.when(F.col("source").startswith("/"), F.col("source"))), tails))
    exact = tried.select("source", F.posexplode("tries").alias("rank", "path")).where("path is not null").join(files.select("path").distinct(), "path", "left_semi")
    exact = exact.groupBy("source").agg(F.min_by("path", "rank").alias("path"))
    inner = F.substring(F.col("path"), len(root) + 2, 1 << 20)
    named = files.where(F.startswith("path", F.lit(root + "/"))).where(~inner.rlike(r"(^|/)\.[^/]*/")).select(F.substring_index("path", "/", -1).alias("base"), "path")
    named = named.groupBy("base").agg(F.min(F.struct(F.size(F.split("path", "/")).alias("depth"), "path")).alias("first")).select("base", F.col("first.path").alias("anywhere"))
    return own.join(tried.select("source", "base"), "source", "left").join(exact, "source", "left").join(named, "base", "left").select("source", F.coalesce("path", "anywhere").alias("path"))


# The forms of a debug listing's lines; tags of records.
ENTRY_LINE = r"^(0x[0-9a-f]+):(\s+)(DW_TAG_\w+|NULL)"
ATTRIBUTE_LINE = r"^\s+(DW_AT_\w+)\s+\((.*)\)\s*$"
RECORD_TAGS = {"DW_TAG_structure_type": "struct", "DW_TAG_class_type": "class", "DW_TAG_union_type": "union"}
_EMPTY = struct.pack("<q", 1 << 40)


def _nested(row: dict) -> bytes:
    """What an entry does to the stack of open entries: it closes those at its depth or deeper, and opens itself."""
    return _EMPTY if row["depth"] is None else struct.pack("<3q", row["depth"], row["depth"], row["entry"])


def _stacked(a: bytes, b: bytes) -> bytes:
    """Two such summaries, the least depth closed and then the (depth, entry) left open, as one."""
    x, y = struct.unpack(f"<{len(a) // 8}q", a), struct.unpack(f"<{len(b) // 8}q", b)
    keep = [v for k in range(1, len(x), 2) if x[k] < y[0] for v in x[k : k + 2]]
    return struct.pack(f"<{1 + len(keep) + len(y) - 1}q", min(x[0], y[0]), *keep, *y[1:])


def entries(rows: DataFrame, size: int = carry.ROWS) -> DataFrame:
    """SRC15: rows (file, line_no, entry, tag, depth, parent, attributes) of a debug listing.

    An entry is named by its offset; its depth is half of the indent of its tag, and its parent the last
    entry before it that is less deep. Lines of attributes are of the last entry, but go after a NULL; the last
    of a name counts. A listing has each offset once.
    """
    got = lambda pattern, k: F.regexp_extract("line", pattern, k)
    line = F.col("line")
    # plain searches first: most of the time goes into patterns
    is_entry, is_attribute = line.startswith("0x") & line.rlike(ENTRY_LINE), line.contains("DW_AT_") & line.rlike(ATTRIBUTE_LINE)
    own = rows.select("file", "line_no", F.when(line.contains("\r"), F.regexp_replace("line", "\r$", "")).otherwise(line).alias("line")).where(is_entry | is_attribute)
    real = is_entry & (got(ENTRY_LINE, 3) != "NULL")
    marked = own.select("file", "line_no", "line", F.when(real, hexadecimal(got(ENTRY_LINE, 1))).alias("entry"), F.when(is_entry, F.when(real, hexadecimal(got(ENTRY_LINE, 1))).otherwise(F.lit(-1).cast("long"))).alias("of"))
    marked = cut(marked)  # ranges are counted, sampled and dealt
    held = cut(carry.last_values(marked, "file", "line_no", ["of"], size))
    depth = F.greatest(F.lit(0), F.floor((F.length(got(ENTRY_LINE, 2)) - 1) / 2)).cast("long")
    heads = held.where("entry is not null").select("file", "line_no", "entry", got(ENTRY_LINE, 3).alias("tag"), depth.alias("depth"))
    nested = carry.prefixes(heads, "file", "line_no", _nested, _stacked, _EMPTY, size, uses=("depth", "entry"))
    parent = parent_of(F.col("before"), F.col("depth"))
    attributes = held.where("entry is null and of >= 0").groupBy("file", F.col("of").alias("entry"), got(ATTRIBUTE_LINE, 1).alias("name")).agg(F.max_by(got(ATTRIBUTE_LINE, 2), "line_no").alias("value"))
    attributes = attributes.groupBy("file", "entry").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("attributes"))
    return nested.withColumn("parent", parent).drop("before").join(attributes, ["file", "entry"], "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>"))).select("file", "line_no", "entry", "tag", "depth", "parent", "attributes")


def parent_of(before: Column, depth: Column) -> Column:
    """The last entry left open, by a summary, that is less deep than an entry; null if none is."""

    @F.arrow_udf("long")
    def last(before: pa.Array, depth: pa.Array) -> pa.Array:
        out = []
        for b, d in zip(before.to_pylist(), depth.to_pylist(), strict=True):
            x = struct.unpack(f"<{len(b) // 8}q", b)
            out.append(next((x[k + 1] for k in range(len(x) - 2, 0, -2) if x[k] < d), None))
        return pa.array(out, pa.int64())

    return last(before, depth)


def sizes(all_entries: DataFrame, address_size: Column) -> DataFrame:
    """Rows (file, entry, size): bytes of what each entry is; address_size is a column of all_entries.

    Its own size, or for a pointer that of an address; an array is as many times its element as the product of its
    ranges; any other entry is as large as its type. Steps to types are doubled a round, so that rounds grow with the
    logarithm of the longest chain of types. A chain without an end has size 0.
    """
    attribute = lambda name: F.col("attributes").getItem(name)
    ranges = all_entries.where("tag = 'DW_TAG_subrange_type'").select("file", F.col("parent").alias("entry"), F.coalesce(number(attribute("DW_AT_count")), number(attribute("DW_AT_upper_bound")) + 1, F.lit(0).cast("long")).alias("n"))
    counts = ranges.groupBy("file", "entry").agg(F.aggregate(F.collect_list("n"), F.lit(1).cast("long"), lambda a, n: a * n).alias("counts"))
    own = F.coalesce(number(attribute("DW_AT_byte_size")), F.when(F.col("tag").isin("DW_TAG_pointer_type", "DW_TAG_reference_type"), address_size))
    typed = number(attribute("DW_AT_type"))
    first = all_entries.join(counts, ["file", "entry"], "left").select("file", "entry", own.alias("size"), F.when(F.col("tag") == "DW_TAG_array_type", F.coalesce("counts", F.lit(1).cast("long"))).otherwise(F.lit(1).cast("long")).alias("times"), typed.alias("to"))
    ends = F.when(F.col("size").isNull() & F.col("to").isNull(), F.lit(0).cast("long")).otherwise(F.col("size"))
    now = cut(first.select("file", "entry", ends.alias("size"), "times", F.when(F.col("size").isNull(), F.col("to")).alias("to")))
    left = now.where("size is null").count()
    while left:
        step = now.select("file", F.col("entry").alias("to"), F.col("size").alias("_size"), F.col("times").alias("_times"), F.col("to").alias("_to"), F.lit(True).alias("_is"))
        met = now.join(step, ["file", "to"], "left")
        open_ = F.col("size").isNull()
        size = F.when(~open_, F.col("size")).when(F.col("_is").isNull(), F.lit(0).cast("long")).otherwise(F.col("times") * F.col("_size"))
        now = cut(met.select("file", "entry", size.alias("size"), F.when(open_, F.col("times") * F.coalesce("_times", F.lit(1).cast("long"))).otherwise(F.col("times")).alias("times"), F.when(open_, F.col("_to")).alias("to")))
        before, left = left, now.where("size is null").count()
        if left == before:
            break
    return now.select("file", "entry", F.coalesce("size", F.lit(0).cast("long")).alias("size"))


def observed(rows: DataFrame, size: int = carry.ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC15: (records, members, not_found) of a debug listing.

    records: file, name, kind, size_of, sum_members, holes, sum_holes, padding; members: file, record, pos, name, type,
    offset, size, is_ancestor, bit_unit, bit_first, bit_width, hole_after; not_found: file, name of what is only declared. The
    first record of a name counts. Holes and padding are null where there are none, and in unions, records
    with a virtual base or members that overlap, and records without a member of a size, the sums too.
    """
    every = cut(entries(rows, size))
    said = F.lower(F.regexp_extract("line", r"(?i)addr_size\s*=\s*(0x[0-9a-f]+|\d+)", 1))
    address = rows.where(F.lower("line").contains("addr_size")).where(said != "").groupBy("file").agg(F.min_by(number(said), "line_no").alias("_address"))
    every = every.join(address, "file", "left").withColumn("_address", F.when(F.col("_address") > 0, F.col("_address")).otherwise(F.lit(4).cast("long")))
    attribute = lambda name: F.col("attributes").getItem(name)
    quoted = lambda c: F.nullif(F.regexp_extract(c, '"([^"]*)"', 1), F.lit(""))
    kinds = F.create_map(*(F.lit(x) for kv in RECORD_TAGS.items() for x in kv))
    named = every.where(F.col("tag").isin(*RECORD_TAGS)).select("file", "line_no", F.col("entry").alias("record"), quoted(attribute("DW_AT_name")).alias("name"), F.try_element_at(kinds, F.col("tag")).alias("kind"), attribute("DW_AT_byte_size").alias("said"), F.coalesce(attribute("DW_AT_declaration") == "true", F.lit(False)).alias("declared")).where("name is not null")
    whole = F.col("said").isNotNull() & ~F.col("declared")
    first = named.where(whole).groupBy("file", "name").agg(F.min_by(F.struct("record", "kind", F.coalesce(number(F.col("said")), F.lit(0).cast("long")).alias("size_of")), "line_no").alias("r")).select("file", "name", "r.*")
    not_found = named.where(~whole).select("file", "name").distinct().join(first.select("file", "name"), ["file", "name"], "left_anti")
    known = sizes(every, F.col("_address")).withColumnsRenamed({"entry": "_type", "size": "_size"})
    parts = every.where(F.col("tag").isin("DW_TAG_member", "DW_TAG_inheritance")).withColumnRenamed("parent", "record").join(first.select("file", "record", F.col("name").alias("owner"), F.col("kind").alias("_kind")), ["file", "record"])
    ancestor, typed, place, bit = F.col("tag") == "DW_TAG_inheritance", F.coalesce(attribute("DW_AT_type"), F.lit("")), attribute("DW_AT_data_member_location"), number(attribute("DW_AT_data_bit_offset"))
    type_name = F.coalesce(quoted(typed), F.trim(typed))
    parts = parts.where(ancestor | place.isNotNull() | bit.isNotNull()).withColumn("_type", number(typed)).join(known, ["file", "_type"], "left")
    zero = F.lit(0).cast("long")
    has_bits, bit0 = ~ancestor & attribute("DW_AT_bit_size").isNotNull() & number(attribute("DW_AT_bit_size")).isNotNull(), F.coalesce(bit, zero)
    offset = F.when(ancestor | place.isNotNull(), F.coalesce(number(place), zero)).otherwise(F.floor(bit0 / 8))
    members = parts.select(
        "file", "line_no", "record", F.col("owner"), F.col("_kind"),
        F.when(ancestor, F.element_at(F.split(type_name, "::"), -1)).otherwise(F.coalesce(quoted(attribute("DW_AT_name")), F.lit(""))).alias("name"),
        type_name.alias("type"), offset.alias("offset"), F.coalesce("_size", zero).alias("size"), ancestor.alias("is_ancestor"),
        (ancestor & attribute("DW_AT_virtuality").isNotNull()).alias("_virtual"),
        F.when(has_bits, F.floor(bit0 / 8)).alias("bit_unit"), F.when(has_bits, bit0 % 8).alias("bit_first"), F.when(has_bits, number(attribute("DW_AT_bit_size"))).alias("bit_width"),
    )
    # what is laid out, by offset: where the member before ends, and the hole between
    by = Window.partitionBy("file", "record").orderBy("offset", "line_no")
    laid = members.where("bit_width is null and size > 0").withColumn("_size", F.when(F.col("is_ancestor") & (F.lead("offset").over(by) == F.col("offset")), zero).otherwise(F.col("size")))
    laid = laid.withColumn("_end", F.coalesce(F.max(F.col("offset") + F.col("_size")).over(by.rowsBetween(Window.unboundedPreceding, -1)), zero)).withColumn("_before", F.lag(F.col("offset") + F.col("_size")).over(by))
    laid = laid.withColumn("_gap", F.greatest(F.col("offset") - F.col("_end"), zero)).withColumn("_next_gap", F.lead("_gap").over(by))
    sums = laid.groupBy("file", "record").agg(F.max(F.coalesce(F.col("offset") < F.col("_before"), F.lit(False))).alias("overlaps"), F.sum("_size").alias("sum_members"), F.count_if(F.col("_gap") > 0).alias("holes"), F.sum("_gap").alias("sum_holes"), F.max(F.col("offset") + F.col("_size")).alias("_last"))
    virtual = members.groupBy("file", "record").agg(F.max("_virtual").alias("virtual"))
    told = first.join(sums, ["file", "record"], "left").join(virtual, ["file", "record"], "left").withColumn("plain", F.col("sum_members").isNotNull() & (F.col("kind") != "union") & ~F.coalesce("virtual", F.lit(False)) & ~F.coalesce("overlaps", F.lit(False)))
    positive = lambda c: F.when(F.col("plain") & (c > 0), c)
    records = told.select("file", "name", "kind", "size_of", F.when(F.col("plain"), F.col("sum_members")).alias("sum_members"), positive(F.col("holes")).alias("holes"), positive(F.col("sum_holes")).alias("sum_holes"), positive(F.col("size_of") - F.greatest(F.col("_last"), zero)).alias("padding"))
    gaps = laid.select("file", "record", "line_no", F.when(F.col("_next_gap") > 0, F.col("_next_gap")).alias("hole_after")).join(told.where("plain").select("file", "record"), ["file", "record"], "left_semi")
    out = members.join(gaps, ["file", "record", "line_no"], "left").withColumn("pos", (F.row_number().over(Window.partitionBy("file", "record").orderBy("line_no")) - 1).cast("long"))
    return records, out.select("file", F.col("owner").alias("record"), "pos", "name", "type", "offset", "size", "is_ancestor", "bit_unit", "bit_first", "bit_width", "hole_after"), not_found


# The forms of a layout tool's lines, in order of precedence within a record.
HEAD = r"^(struct|union|class)\s+([A-Za-z_]\w*)(?:\s*:\s*[^{]+)?\s*\{"
HOLE, BIT_HOLE = r"/\* XXX (\d+) bytes? hole", r"/\* XXX (\d+) bits? hole"
BASE = r"^\s*/\*\s*(struct|class)\s+(\S+)\s+<ancestor>;\s*\*/\s*/\*\s*(\d+)\s+(\d+)\s*\*/\s*$"
MEMBER = r"^\s*(.+?)\s{2,}([A-Za-z_]\w*)(?::(\d+))?;\s*/\*\s*(\d+)(?::\s*(\d+))?\s+(\d+)\s*\*/\s*$"
NO_NAME = r"^\s*(.+?)\s+:(\d+);\s*$"
ABSENT = r"^pahole: type '([^']+)' not found"


def layouts(rows: DataFrame, size: int = carry.ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC14: (records, members, not_found) of a layout tool's text.

    records: file, place, name, kind, size_of, sum_members, holes, sum_holes, bit_holes, sum_bit_holes, padding; members: file, place
    (of the record), record, pos, name, type, offset, size, is_ancestor, bit_unit, bit_first, bit_width, hole_after,
    bit_hole_after; not_found: file, name. A record goes from its head to the next line that begins with a
    brace; a head within it is none, and one that is not ended is left out. A line about a hole is of the member before it.
    """
    line = F.col("line")
    got = lambda pattern, k: F.regexp_extract("line", pattern, k)
    own = rows.select("file", "line_no", F.regexp_replace(F.coalesce("line", F.lit("")), "\r$", "").alias("line"))
    not_found = own.where(line.rlike(ABSENT)).select("file", got(ABSENT, 1).alias("name"))
    kind = F.when(line.rlike(HOLE), "hole").when(line.rlike(BIT_HOLE), "bit_hole").when(line.rlike(BASE), "base").when(line.rlike(MEMBER), "member").when(line.rlike(NO_NAME) & ~line.contains("/*"), "no_name").when(F.ltrim("line").startswith("}"), "end").otherwise("other")
    told = own.where(~line.rlike(ABSENT)).withColumn("what", kind)
    # records are told apart by the last end before them; the first head after that begins one
    eras = carry.last_values(told.withColumn("era", F.when(F.col("what") == "end", F.col("line_no"))), "file", "line_no", ["era"], size, own=False)
    eras = cut(eras)
    heads = eras.where(line.rlike(HEAD)).groupBy("file", "era").agg(F.min_by(F.struct("line_no", got(HEAD, 2).alias("name"), got(HEAD, 1).alias("kind")), "line_no").alias("h"))
    ended = eras.where("what = 'end'").select("file", "era", F.col("line_no").alias("_end"))
    heads = heads.join(ended, heads.file.eqNullSafe(ended.file) & heads.era.eqNullSafe(ended.era)).select(heads.file, heads.era, F.col("h.line_no").alias("place"), F.col("h.name").alias("record"), F.col("h.kind").alias("record_kind"), "_end").where(F.col("place") < F.col("_end"))
    b = heads.select(F.col("file").alias("_f"), F.col("era").alias("_e"), "place", "record", "record_kind")
    inside = eras.join(b, eras.file.eqNullSafe(b._f) & eras.era.eqNullSafe(b._e)).where(F.col("line_no") > F.col("place")).drop("_f", "_e")
    number_ = lambda pattern, k: F.max_by(got(pattern, k).try_cast("long"), F.when((F.col("what") == "other") & line.rlike(pattern), F.col("line_no")))
    total, bits = r"/\* sum members: (\d+), holes: (\d+), sum holes: (\d+)", r"bit holes: (\d+), sum bit holes: (\d+) bits"
    records = inside.groupBy("file", "place", F.col("record").alias("name"), F.col("record_kind").alias("kind")).agg(
        F.coalesce(number_(r"/\* size: (\d+),", 1), F.lit(0).cast("long")).alias("size_of"),
        *(number_(total, k).alias(n) for k, n in ((1, "sum_members"), (2, "holes"), (3, "sum_holes"))),
        *(number_(bits, k).alias(n) for k, n in ((1, "bit_holes"), (2, "sum_bit_holes"))),
        number_(r"/\* padding: (\d+) \*/", 1).alias("padding"),
    )
    what, zero = F.col("what"), F.lit(0).cast("long")
    is_member = what.isin("base", "member", "no_name")
    upto = Window.partitionBy("file", "place").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.where(is_member | what.isin("hole", "bit_hole")).withColumn("pos", F.count(F.when(is_member, 1)).over(upto) - 1)
    gaps = placed.where(~is_member & (F.col("pos") >= 0)).groupBy("file", "place", "pos").agg(
        F.max_by(got(HOLE, 1).try_cast("long"), F.when(what == "hole", F.col("line_no"))).alias("hole_after"),
        F.max_by(got(BIT_HOLE, 1).try_cast("long"), F.when(what == "bit_hole", F.col("line_no"))).alias("bit_hole_after"),
    )
    long_ = lambda pattern, k: got(pattern, k).try_cast("long")
    width = F.when(what == "no_name", long_(NO_NAME, 2)).when(what == "member", long_(MEMBER, 3))
    member = lambda base, plain, no_name: F.when(what == "base", base).when(what == "member", plain).otherwise(no_name)
    offset = member(long_(BASE, 3), long_(MEMBER, 4), zero)
    members = placed.where(is_member).select(
        "file", "place", "record", "pos",
        member(got(BASE, 2), got(MEMBER, 2), F.lit("")).alias("name"),
        member(F.concat(got(BASE, 1), F.lit(" "), got(BASE, 2)), F.trim(got(MEMBER, 1)), F.trim(got(NO_NAME, 1))).alias("type"),
        offset.alias("offset"), member(long_(BASE, 4), long_(MEMBER, 6), zero).alias("size"), (what == "base").alias("is_ancestor"),
        F.when(width.isNotNull(), offset).alias("bit_unit"), F.when(width.isNotNull(), F.coalesce(F.when(what == "member", long_(MEMBER, 5)), zero)).alias("bit_first"), width.alias("bit_width"),
    )
    return records, members.join(gaps, ["file", "place", "pos"], "left"), not_found
