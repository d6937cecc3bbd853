"""Texts through the shared folder, and sizes on ties."""

import glob

from pyspark.sql import functions as F

from buildscope.functions.scalars import human_size
from buildscope.plans import texts as T
from buildscope.streaming import telemetry as S


def test_texts_share_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "shared", lambda spark, name: f"{tmp_path}/{name}")
    odd = ["", "a\nb\r\n c\r", '{"x": "\\n"}', " \x00\x1e é 𝄞", " \t ", "\n"]
    rows = [(f"f {k}/\"{k}", odd[k % len(odd)]) for k in range(300)]
    got = T.through_texts(spark.createDataFrame(rows, "file string, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert len(glob.glob(f"{tmp_path}/texts/part-*")) <= 8


def test_sizes_on_ties(spark):
    want = {1023: "1023 B", 1280: "1.2 KB", 1792: "1.8 KB", 1281: "1.3 KB", 1179648: "1.12 MB", 1441792: "1.38 MB", 1179649: "1.13 MB", 1 << 20: "1.00 MB", (1 << 53) - 1: "8589934592.00 MB"}
    rows = spark.createDataFrame([(k, float(k)) for k in want], "k long, n double").select("k", human_size(F.col("n")).alias("s"), human_size(F.col("k")).alias("t"))
    assert {r.k: r.s for r in rows.collect()} == want == {r.k: r.t for r in rows.collect()}
