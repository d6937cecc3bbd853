"""Conditional ranges and compile commands on cases that the queries' tables do not hold."""

from pyspark.sql import functions as F

from buildscope.functions import code as R
from buildscope.operators.code import conditional_ranges, ranges


def test_nested_ranges():
    text = "#if 0\n#ifdef A\nx\n#else\ny\n#endif\n#endif\n#else\n#endif\n"
    inner, outer, end = text.index("#ifdef"), text.index("#else"), text.index("#endif")
    assert ranges(text) == [(True, None, inner, outer), (True, None, outer, end), (True, None, 0, end + len("#endif\n"))]
    assert ranges("") == [] and ranges("#ifdef A\nnever closed") == []
    assert ranges("#define A\n#undef A\n#ifndef A\n#endif") == [(False, "A", 19, 29)]


def test_ranges_of_no_text(spark):
    files = spark.createDataFrame([("a", None), ("b", "")], "file string, text string")
    assert conditional_ranges(files).collect() == []


def test_compile_arguments_of_few(spark):
    rows = spark.createDataFrame([([],), (["gcc"],), (["gcc", "-o", "-o", "x", "-c"],)], "a array<string>")
    nothing = F.array().cast("array<string>")
    got = rows.select(R.compile_arguments(F.col("a"), F.lit("/w"), F.lit("f.c"), nothing, nothing, "cc").alias("x")).collect()
    assert [r.x for r in got] == [["cc", "-c", "/w/f.c"], ["gcc", "-c", "/w/f.c"], ["gcc", "x", "-c", "/w/f.c"]]


def test_paths(spark):
    got = spark.range(1).select(*(R.normal_path(F.lit(p)) for p in ("/a//b/./../c", "/../x", "../../y/..", "a/.."))).first()
    assert list(got) == ["/a/c", "/x", "../..", ""]
