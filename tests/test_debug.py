"""Listings cut into ranges of any size, and the rules that the queries' tables do not hold."""

import random

import pytest
from pyspark.sql import functions as F

from buildscope.sources import debug as D


def lines(spark, **files):
    rows = [(f, n, x) for f, text in files.items() for n, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no long, line string")


def tree(rng, n):
    """A listing of n entries and the parent of each by a stack."""
    out, stack, want, depth = [], [], {}, 0
    for k in range(1, n + 1):
        depth = max(0, min(depth + rng.choice([1, 1, 0, -1, -3]), depth + 1))
        out.append(f"0x{k:08x}:{' ' * (2 * depth + 1)}DW_TAG_member")
        while stack and stack[-1][0] >= depth:
            stack.pop()
        want[k] = stack[-1][1] if stack else None
        stack.append((depth, k))
        if rng.random() < 0.5:
            out += [f'              DW_AT_name\t("n{k}")', f'              DW_AT_name\t("m{k}")']
        if rng.random() < 0.2:
            out += [f"0x{9000 + k:08x}:  NULL", '     DW_AT_name ("gone")']
        if rng.random() < 0.2:
            out += ["", "something else"]
    return "\n".join(out), want


@pytest.mark.parametrize("size", [1 << 20, 11, 3])
def test_parents(spark, size):
    rng = random.Random(size)
    (one, a), (two, b) = tree(rng, 60), tree(rng, 25)
    got = D.entries(lines(spark, one=one, two=two), size).collect()
    assert {(r.file, r.entry): r.parent for r in got} == {("one", k): v for k, v in a.items()} | {("two", k): v for k, v in b.items()}
    assert all(r.attributes in ({}, {"DW_AT_name": f'"m{r.entry}"'}) for r in got)


LAYOUT = """0x00000000: Compile Unit
0x0000000b: DW_TAG_compile_unit
0x00000010:   DW_TAG_class_type
                DW_AT_name\t("Poly")
                DW_AT_byte_size\t(0x20)
0x00000014:     DW_TAG_inheritance
                  DW_AT_type\t(0x00000090 "ns::Empty")
                  DW_AT_data_member_location\t(0x00)
0x00000018:     DW_TAG_member
                  DW_AT_name\t("p")
                  DW_AT_type\t(0x00000080 "int *")
                  DW_AT_data_member_location\t(0x00)
0x0000001c:     DW_TAG_member
                  DW_AT_name\t("bits")
                  DW_AT_type\t(0x00000084 "int")
                  DW_AT_bit_size\t(0x03)
                  DW_AT_data_bit_offset\t(0x4b)
0x00000020:     DW_TAG_member
                  DW_AT_name\t("grid")
                  DW_AT_type\t(0x00000088 "int[2][3]")
                  DW_AT_data_member_location\t(12)
0x00000024:     NULL
0x00000028:   DW_TAG_class_type
                DW_AT_name\t("Virt")
                DW_AT_byte_size\t(0x10)
0x0000002c:     DW_TAG_inheritance
                  DW_AT_type\t(0x00000090 "Empty")
                  DW_AT_virtuality\t(DW_VIRTUALITY_virtual)
0x00000030:     NULL
0x00000034:   DW_TAG_union_type
                DW_AT_name\t("U")
                DW_AT_byte_size\t(0x08)
0x00000038:     DW_TAG_member
                  DW_AT_type\t(0x00000084 "int")
                  DW_AT_data_member_location\t(0x00)
0x0000003c:     NULL
0x00000040:   DW_TAG_structure_type
                DW_AT_name\t("Later")
                DW_AT_declaration\t(true)
0x00000044:   DW_TAG_structure_type
                DW_AT_byte_size\t(0x04)
0x00000048:   DW_TAG_structure_type
                DW_AT_name\t("Later")
                DW_AT_byte_size\t(0x04)
0x0000004c:   DW_TAG_structure_type
                DW_AT_name\t("Never")
0x00000050:   DW_TAG_structure_type
                DW_AT_name\t("Later")
                DW_AT_byte_size\t(0x40)
0x00000080:   DW_TAG_pointer_type
                DW_AT_type\t(0x00000084 "int")
0x00000084:   DW_TAG_base_type
                DW_AT_byte_size\t(0x04)
0x00000088:   DW_TAG_array_type
                DW_AT_type\t(0x000000a0 "a")
0x0000008a:     DW_TAG_subrange_type
                  DW_AT_count\t(0x02)
0x0000008c:     DW_TAG_subrange_type
                  DW_AT_upper_bound\t(0x01)
0x0000008e:     NULL
0x00000090:   DW_TAG_class_type
                DW_AT_name\t("Empty")
                DW_AT_byte_size\t(0x01)
0x000000a0:   DW_TAG_typedef
                DW_AT_type\t(0x000000a4 "b")
0x000000a4:   DW_TAG_const_type
                DW_AT_type\t(0x00000084 "int")
0x000000b0:   DW_TAG_typedef
                DW_AT_type\t(0x000000b4 "round")
0x000000b4:   DW_TAG_typedef
                DW_AT_type\t(0x000000b0 "about")
0x000000b8:   DW_TAG_typedef
                DW_AT_type\t(0x0000ffff "nowhere")"""


def test_layouts(spark):
    records, members, missing = D.observed(lines(spark, f=LAYOUT))
    got = {r.name: tuple(r)[2:] for r in records.collect()}
    assert got == {
        "Poly": ("class", 32, 20, 1, 8, 4),  # the empty base takes nothing; an address has four bytes; the bits stand in the hole
        "Virt": ("class", 16, None, None, None, None),
        "U": ("union", 8, None, None, None, None),
        "Later": ("struct", 4, None, None, None, None),
        "Empty": ("class", 1, None, None, None, None),
    }
    own = {(r.record, r.name): (r.pos, r.type, r.offset, r["size"], r.is_ancestor, r.bit_unit, r.bit_first, r.bit_width, r.hole_after) for r in members.collect()}
    assert own == {
        ("Poly", "Empty"): (0, "ns::Empty", 0, 1, True, None, None, None, None),
        ("Poly", "p"): (1, "int *", 0, 4, False, None, None, None, 8),
        ("Poly", "bits"): (2, "int", 9, 4, False, 9, 3, 3, None),
        ("Poly", "grid"): (3, "int[2][3]", 12, 16, False, None, None, None, None),
        ("Virt", "Empty"): (0, "Empty", 0, 1, True, None, None, None, None),
        ("U", ""): (0, "int", 0, 4, False, None, None, None, None),
    }
    assert [r.name for r in missing.collect()] == ["Never"]
    known = {r.entry: r["size"] for r in D.sizes(D.entries(lines(spark, f=LAYOUT)), F.lit(8).cast("long")).collect()}
    assert [known[k] for k in (0x80, 0x88, 0xA0, 0xB0, 0xB4, 0xB8)] == [8, 16, 4, 0, 0, 0]


CODE = """x.o:     file format elf32

Disassembly of section .text:

00000100 <a::b(int)>:
a::b(int) const:
/w/a.c:12 (discriminator 3)
  int x = f();

 next();
   100:\tb580      \tpush\t{r7, lr}
   102:  6803 68      LDR.W r3, [r0, #0] ; tail
a.s
after
.dotted
still source
   104:\te7fe      \tb.n\t104 <x>
stray"""


@pytest.mark.parametrize("size", [1 << 20, 4, 1])
def test_disassembly(spark, size):
    got = D.disassembly(lines(spark, f=CODE), size=size).orderBy("line_no").collect()
    assert [(r.kind, r.line, r.text) for r in got if r.kind not in ("insn", "blank")] == [
        ("label", None, "00000100 <a::b(int)>:"),
        ("func_sig", None, "a::b(int) const:"),
        ("source_loc", 12, "/w/a.c:12 (discriminator 3)"),
        ("source_code", 12, "int x = f();"),
        ("source_loc", 0, "a.s"),
        ("source_code", 12, "after"),
        ("source_code", 12, "still source"),
    ]
    insn = [(r.addr, r.raw_bytes, r.mnemonic, r.operands, r.is_load, r.is_store, r.is_branch, r.line, r.function) for r in got if r.kind == "insn"]
    assert insn == [(0x100, "b580", "push", "{r7, lr}", False, True, False, 12, "a::b(int)"), (0x104, "e7fe", "b", "104 <x>", False, False, True, 12, "a::b(int)")]
    assert [r.kind for r in got][:2] == ["blank", "blank"] and got[0].function is None


def test_faults(spark):
    rows = [("str", "r0, [r1]", False, True, False, False, 0x10), ("bl", "x", False, False, True, False, 0x20), ("str", "r0, [r1]", False, True, False, False, 0x2000), ("ldr", "r0", True, False, False, False, 0x40000000), ("blx", "r3", False, False, True, False, 0x20000000), ("ldrh", "r0", True, False, False, False, 0x20000001), ("ldr", "r0", True, False, False, False, 0x20000002), ("movs", "r0", False, False, False, True, 0x20000000), ("ldr", "r0, [SP, #4]", True, False, False, False, 0x20000000), ("movs", "r0", False, False, False, False, 0x20000000)]
    frame = spark.createDataFrame(rows, "mnemonic string, operands string, is_load boolean, is_store boolean, is_branch boolean, recent_branch boolean, target long")
    got = [r.f and r.f.fault for r in frame.select(D.fault(F.col("target")).alias("f")).collect()]
    assert got == ["null_deref", "bad_branch", "write_to_flash", "peripheral_access", "bad_branch", "unaligned_access", "unaligned_access", "iaccviol", "stack_overflow", None]


def test_sources(spark):
    files = spark.createDataFrame([(p,) for p in ("/abs/a.c", "/r/x/b.c", "/r/b.c", "/r/p/q/c.c", "/r/z/c.c", "/r/.h/d.c", "/r/w/x/y/z/e.c", "/r2/f.c")], "path string")
    asked = ["/abs/a.c", "C:\\o\\x\\b.c", "q/c.c", "k/c.c", "d.c", "/m/w/x/y/z/e.c", "f.c", "", None]
    got = {r.source: r.path for r in D.resolved_sources(spark.createDataFrame([(s,) for s in asked], "source string"), files, "/r").collect()}
    assert got == {"/abs/a.c": "/abs/a.c", "C:\\o\\x\\b.c": "/r/b.c", "q/c.c": "/r/z/c.c", "k/c.c": "/r/z/c.c", "d.c": None, "/m/w/x/y/z/e.c": "/r/w/x/y/z/e.c", "f.c": None, "": None, None: None}
