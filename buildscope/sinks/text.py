"""Rows as lines of text formats. Lines are Columns, so any writer can take them; write_lines keeps their order in a file."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header and tags of the log formats.
LOG_HEADER = "iso_time,epoch_ms,kind,command,channel,series,value,text"
TAGS = {"rx": "<<", "tx": ">>", "err": "!!"}


def csv_field(value: Column) -> Column:
    """SNK1: quoted only if it has a quote, a comma or a line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *map(csv_field, values))


def quoted_line(*values: Column) -> Column:
    """SNK5: every field quoted."""
    return F.concat_ws(",", *(F.concat(F.lit('"'), F.regexp_replace(F.coalesce(v.cast("string"), F.lit("")), '"', '""'), F.lit('"')) for v in values))


def iso_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS")


def log_csv(at: Column, direction: Column, text: Column) -> Column:
    return F.concat_ws(",", csv_field(iso_time(at)), F.unix_millis(at).cast("string"), direction, F.lit(",,,"), csv_field(text))


def sample_csv(at: Column, command: Column, channel: Column, series: Column, value: Column) -> Column:
    return F.concat_ws(",", csv_field(iso_time(at)), F.unix_millis(at).cast("string"), F.lit("sample"), csv_field(command), channel.cast("string"), csv_field(series), value.cast("string"), F.lit(""))


def json_line(**values: Column) -> Column:
    """SNK2, SNK6: a compact object with the keys in the order given."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in values.items())))


def log_text(at: Column, direction: Column, text: Column, timestamps: bool = True) -> Column:
    """SNK3: a direction tag before the text."""
    tag = F.when(direction == "rx", TAGS["rx"]).when(direction == "tx", TAGS["tx"]).when(direction == "err", TAGS["err"]).otherwise("--")
    return F.concat_ws(" ", *([iso_time(at)] if timestamps else []), tag, text)


def safe_id(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), "[^A-Za-z0-9_]", "_")


def dot_lines(nodes: DataFrame, edges: DataFrame, node: str, label: str, a: str, b: str) -> DataFrame:
    """SNK7: rows (part, line) of a DOT graph: 0 its head, 1 nodes, 2 edges, 3 its end."""
    spark = nodes.sparkSession
    frame = lambda part, lines: spark.createDataFrame([(part, x) for x in lines], "part int, line string")
    own = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), safe_id(F.col(node)), F.lit(' [label="'), F.regexp_replace(F.col(label), '"', '\\\\"'), F.lit('"];')).alias("line"))
    links = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), safe_id(F.col(a)), F.lit(" -> "), safe_id(F.col(b)), F.lit(";")).alias("line"))
    return frame(0, ["digraph CallGraph {", "  rankdir=LR;"]).unionByName(own).unionByName(links).unionByName(frame(3, ["}"]))


def mermaid_lines(nodes: DataFrame, edges: DataFrame, node: str, label: str, a: str, b: str) -> DataFrame:
    """SNK7: the same as a Mermaid flow chart."""
    own = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), safe_id(F.col(node)), F.lit('("'), F.regexp_replace(F.col(label), '"', "'"), F.lit('")')).alias("line"))
    links = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), safe_id(F.col(a)), F.lit(" --> "), safe_id(F.col(b))).alias("line"))
    return nodes.sparkSession.createDataFrame([(0, "flowchart LR")], "part int, line string").unionByName(own).unionByName(links)


def write_lines(df: DataFrame, line: Column, path: str, order: Sequence = (), eol: str = "\r\n", rows_a_file: int = 0, header: str | None = None) -> None:
    """Lines under path; with an order, files and the lines in them follow it. rows_a_file bounds a file's lines (SNK4); a header comes first, once."""
    rows = df.orderBy(*order) if order else df
    out = rows.select(line.alias("value")).write.option("lineSep", eol)
    if rows_a_file:
        out = out.option("maxRecordsPerFile", rows_a_file)
    out.text(path)
    if header is not None:  # a file whose name comes before those of the parts
        head = df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1)
        head.write.option("lineSep", eol).text(f"{path}/head=0")


def notes(store: DataFrame, key: str, generated: Sequence[str], corrected: Sequence[str], body: str) -> DataFrame:
    """SNK9: rows (file, text): a note a key, its fields between --- lines, null ones left out, then its body."""
    fields = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in (*generated, *corrected)]
    return store.select(F.col(key).alias("file"), F.concat(F.lit("---\n"), F.concat_ws("\n", *fields), F.lit("\n---\n"), F.coalesce(body, F.lit(""))).alias("text"))


def write_files(rows: DataFrame, path: str, eol: str = "\n") -> None:
    """Lines (file, line_no, line) under path, a folder file=name a file; its parts, by name, follow line_no, so no task holds a file."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(F.coalesce("file", F.lit("")).alias("file"), "line_no", "line")  # a name that may be null would be sorted again
    own.repartitionByRange(n, "file", "line_no").sortWithinPartitions("file", "line_no").select("file", "line").write.partitionBy("file").option("lineSep", eol).text(path)


def write_whole(rows: DataFrame, path: str) -> None:
    """Texts (file, text) under path, each in a file of its own, file=name, ended by a line feed; the second of a name is in a folder copy=1, and so on.

    All tasks write, by Arrow: Spark's writer takes a folder and several processes a file, and the driver moves each.
    That writer is used, with a folder file=name a name, where Arrow does not know the file system.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(F.coalesce("file", F.lit("")).alias("file"), F.coalesce("text", F.lit("")).alias("text")).repartition(n, "file")  # a number given is not coalesced
    try:
        system, root = FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        own.write.partitionBy("file").options(**{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).text(path)
        return
    system.create_dir(root, recursive=True)

    def run(batches):
        there, at = FileSystem.from_uri(path)
        seen: Counter = Counter()
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                folder = f"{at}/copy={seen[file]}" if seen[file] else at
                if seen[file]:
                    there.create_dir(folder, recursive=True)
                seen[file] += 1
                with there.open_output_stream(f"{folder}/file={quote(file, safe='')}") as out:
                    out.write(f"{text}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    own.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def retained(files: DataFrame, size: str, newest: str, most: int, keep: int) -> DataFrame:
    """SNK4: of rotated files those that stay: the newest `keep` of those that have reached `most` bytes, and all that have not."""
    from ..operators.core import top_k

    full = files.where(F.col(size) >= most).withColumn("_one", F.lit(1))
    return top_k(full, ["_one"], [F.desc(newest)], keep, "_n").drop("_n", "_one").unionByName(files.where(F.col(size) < most))


def upserted(store: DataFrame, new: DataFrame, key: str, generated: Sequence[str], corrected: Sequence[str]) -> DataFrame:
    """SNK9: the store after an upsert by key: generated columns are the new ones where there are, a human's corrections stay."""
    n = new.select(key, *(F.col(c).alias(f"_{c}") for c in generated))
    return store.join(n, key, "full").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in generated), *corrected)
