"""A file a text: written by all tasks, whatever the names."""

from collections import Counter

from buildscope.sinks import text as K
from buildscope.sources import builds as B


def back(spark, path):
    return Counter((r.file, r.text) for r in B.whole(spark, path).select(B.name_in("file").alias("file"), "text").collect())


def test_every_name_and_text_comes_back(spark, tmp_path):
    rows = [("a+b", "x"), ("a/b c", "y\nz"), ("é%2F", ""), ("", "no name"), ("twice", "1"), ("twice", "2"), ("twice", "2"), ("_k", "1"), (".k", "2")]
    for name in ("one", "file:" + str(tmp_path / "two")):
        at = name if ":" in name else str(tmp_path / name)
        K.write_whole(spark.createDataFrame(rows, "file string, text string"), at)
        assert back(spark, at) == Counter((f, t + "\n") for f, t in rows)
    none = str(tmp_path / "none")
    K.write_whole(spark.createDataFrame([], "file string, text string"), none)
    assert not back(spark, none)


def test_all_tasks_write(spark, tmp_path, monkeypatch):
    rows = spark.range(60).selectExpr("string(id) as file", "'t' as text")
    tasks = lambda: {s for j in spark.sparkContext.statusTracker().getJobIdsForGroup("notes") for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("notes", "notes")
    K.write_whole(rows, str(tmp_path / "a"))
    assert 4 in {i.numTasks for s in tasks() if (i := spark.sparkContext.statusTracker().getStageInfo(s)) and i.numCompletedTasks}
    spark.sparkContext.setJobGroup("spark", "notes by Spark's writer")

    def unknown(path):
        raise OSError(path)

    monkeypatch.setattr(K, "FileSystem", type("Unknown", (), {"from_uri": staticmethod(unknown)}))
    K.write_whole(rows, str(tmp_path / "b"))
    assert back(spark, str(tmp_path / "b")) == back(spark, str(tmp_path / "a"))
