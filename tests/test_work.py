"""How often work is done, on inputs that tell."""

import random

from pyspark.sql import functions as F

from buildscope.functions import code as R
from buildscope.operators import carry, constructs, lexer
from buildscope.plans.queries import QUERIES
from buildscope.sources import debug


def test_compile_arguments_with_odd_paths(spark):
    rows = spark.createDataFrame([(["gcc", "-O2", "./a/../f.c", "A//F.c", "x/.", "-c", "/w/f.c", "g..c", "..", "/"],)], "a array<string>")
    nothing = F.array().cast("array<string>")
    c = R.compile_arguments(F.col("a"), F.lit("/w"), F.lit("f.c"), nothing, nothing, "cc")
    assert rows.select(c).first()[0] == ["gcc", "-O2", "./a/../f.c", "A//F.c", "x/.", "g..c", "..", "/", "-c", "/w/f.c"]


def test_small_files_are_dealt_over_all_cores(spark):
    for name in ("M38_compile_entry", "E4_outlines", "SRC17_types"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_short_and_long_maps_agree(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("/*\"'\\\nxé ") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    short = [lexer.does(t) for t in texts]
    monkeypatch.setattr(lexer, "SHORT", -1)
    assert short == [lexer.does(t) for t in texts]


def test_pieces_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    pieces = spark.createDataFrame([("a", k, "/* x") for k in range(20)], "file string, piece long, text string")
    got = lexer.blanked(pieces.withColumn("text", F.udf(counted)("text")), 4)
    assert got.count() == 20 and read.value == 20


def test_rounds_read_stored_bases(spark, monkeypatch):
    seen = []
    hops = constructs.hops
    monkeypatch.setattr(constructs, "hops", lambda edges, roots: seen.append(edges._jdf.queryExecution().analyzed().toString()) or hops(edges, roots))
    types = spark.createDataFrame([("a",), ("b",)], "id string")
    bases = spark.createDataFrame([("b", "a")], "type_id string, base string")
    methods = spark.createDataFrame([("a", True, True)], "type_id string, is_destructor boolean, is_virtual boolean")
    assert [r.type for r in constructs.safe_destructors(types, bases, methods).collect()] == ["b"]
    assert "Join" not in seen[0]


def test_lines_of_a_listing_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(line):
        read.add(1)
        return line

    text = ["0x00000001: DW_TAG_compile_unit", '              DW_AT_name\t("a")\r', "0x00000008:   DW_TAG_base_type", "plain 0x DW_AT_name"]
    lines = spark.createDataFrame([("a", k, x) for k, x in enumerate(text)], "file string, line_no long, line string")
    got = debug.entries(lines.withColumn("line", F.udf(counted).asNondeterministic()("line"))).collect()
    assert sorted((r.entry, r.parent, tuple(r.attributes.items())) for r in got if r.parent) == [(8, 1, ())]
    assert {r.entry: dict(r.attributes) for r in got} == {1: {"DW_AT_name": '"a"'}, 8: {}} and read.value == len(text)


def test_ranges_take_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(100_000).selectExpr("'a' as file", "id as place", "if(id % 1000 = 0, id, null) as v")
    assert carry.ranged(rows, "file", "place").rdd.getNumPartitions() == cores
    got = carry.last_values(rows, "file", "place", ["v"])
    assert got.where("v is null or v != place - place % 1000").isEmpty() and got.count() == 100_000
