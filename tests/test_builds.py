"""Build outputs in pieces, with names and keys that come twice, and text that is broken."""

import pytest

from buildscope.operators import carry
from buildscope.sources import builds as B

MAP = """Archive member included
.text 0x0 0x10
Linker script and memory map
.text  0x1000  0x40
 .text.a 0x1000 0x20 obj/a.o
                0x0000000000001000                main
.empty 0x2000 0x0
 .empty.b 0x2000 0x8 obj/b.o
.data  0x3000  0x10
 .data.c 0x3000 0x0 obj/c.o
                0x0000000000003004                value"""


def lines(spark, **files):
    return spark.createDataFrame([(f, n, x) for f, text in files.items() for n, x in enumerate(text.split("\n"))], "file string, line_no int, line string")


@pytest.mark.parametrize("size", [1 << 20, 3, 1])
def test_maps_in_ranges(spark, size, monkeypatch):
    whole = carry.last_values
    monkeypatch.setattr(carry, "last_values", lambda *a, **k: whole(*a, size=size, **k))
    got = B.map_entries(lines(spark, m=MAP, n=MAP.replace("main", "other"))).where("file = 'm'").orderBy("line_no").collect()
    assert [(r.kind, r.section, r.name, r.addr, r["size"]) for r in got] == [("section", ".text", ".text", 0x1000, 0x40), ("unit", ".text", ".text.a", 0x1000, 0x20), ("symbol", ".text", "main", 0x1000, 0), ("section", ".data", ".data", 0x3000, 0x10), ("symbol", ".data", "value", 0x3004, 0)]
    gone = "x\nDiscarded input sections\n .text.u 0x0 0x4 a.o\n\n .text.v 0x0 0x4 b.o\nMemory\n .text.w 0x0 0x4 c.o"
    assert sorted(r.name for r in B.map_discarded(lines(spark, m=gone)).collect()) == [".text.u", ".text.v"]
    dump = "x\n*** Dumping AST Record Layout\n         0 | struct A\n         0 |   int a\n           | [sizeof=4, dsize=4, align=4]\n\n*** Dumping AST Record Layout\n         0 | class B\n         4 |   int b\n           | [sizeof=8, dsize=8, align=4]"
    records, entries = B.record_layouts(lines(spark, m=dump))
    assert sorted((r.name, r.kind, r.size_of) for r in records.collect()) == [("A", "struct", 4), ("B", "class", 8)]
    assert sorted((r.qualified_name, r.name, r.offset) for r in entries.collect()) == [("A", "a", 0), ("B", "b", 4)]


def test_what_comes_twice(spark):
    tags = B.tags(lines(spark, t="f\t./a.c\t/^f/;\tf\tclass:A\tclass:B\tsignature:(int)")).first()
    assert (tags.scope, tags.signature) == ("B", "(int)")
    note = B.front_matter(spark.createDataFrame([("n", "---\na: 1\nb: x\na: 2\n---\nbody\n")], "file string, text string")).first()
    assert note.fields == {"a": "2", "b": "x"} and note.body == "body"
    text = 'node: { title: "f" label: "f\\n8 bytes (static)" }\nnode: { title: "f" label: "f\\n16 bytes (dynamic)" }\nedge: { sourcename: "f" targetname: "g" }'
    nodes, edges = B.call_graph(spark.createDataFrame([("a.ci", text), ("b.ci", 'node: { title: "g" label: "" shape : ellipse }')], "file string, text string"))
    assert sorted((r.name, r.frame, r.dynamic, r.external) for r in nodes.collect()) == [("f", 16, True, False), ("g", 0, False, True)]
    assert edges.count() == 1


def test_broken_projects(spark):
    good = '<a><option valueType="includePath"><listOptionValue value="&quot;x&quot;"/><listOptionValue value="y"/><listOptionValue value="x"/></option></a>'
    files = spark.createDataFrame([("a", good), ("b", "<a><b></a>"), ("c", None), ("d", "")], "file string, text string")
    assert {r.file: (r.includes, r.defines) for r in B.project_settings(files).collect()} == {"a": (["x", "y"], []), "b": (None, None), "c": (None, None), "d": (None, None)}
