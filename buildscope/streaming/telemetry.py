"""Structured Streaming over telemetry samples. Streams end in files of the shared folder, never in the driver's memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.core import dedupe_last
from ..operators.graph import shared


def series_state(events: DataFrame) -> DataFrame:
    """Running state of each series: count, least, greatest, last value, first and last time. A stream's aggregate or a batch's."""
    key = F.struct("ts", "event_id")
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.max_by("value", key).alias("last_value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def with_rate(state: DataFrame) -> DataFrame:
    """ST4, A14: samples a second between the first and the last; null if they are one."""
    span = F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))
    return state.select("user_id", "event_type", "n", "min_value", "max_value", "last_value", F.round(F.try_divide((F.col("n") - 1) * F.lit(1e6), span.cast("double")), 9).alias("rate"))


def series_stats(events: DataFrame) -> DataFrame:
    return with_rate(series_state(events))


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file, or a folder of them, as a stream."""
    stream, at = spark.readStream.schema(spark.read.parquet(path).schema), spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isFile():
        # a stream reads folders only: the one file of that name in its own
        stream, path = stream.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return stream.parquet(path)


def drained(stream: DataFrame, keys: Sequence[str] = (), also: Sequence[Callable[[DataFrame, int], None]] = ()) -> DataFrame:
    """Runs a stream until all there is has been read; the rows it gave as a table in the shared folder.

    With keys the stream updates its rows, and of each key the last update stays. A batch is
    written under its number, so one that is run again replaces itself. ST3: what `also`
    lists gets each batch too.
    """
    spark = stream.sparkSession
    path = shared(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        if also:
            batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        for f in also:
            f(batch, number)
        if also:
            batch.unpersist()

    query = stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/rows")
    return (dedupe_last(rows, keys, ["batch"]) if keys else rows).drop("batch")


def frames(chunks: DataFrame, port: str, order: str, text: str, longest: int = 1_000_000, kept: int = 100_000) -> DataFrame:
    """ST1: rows (port, line) of a stream of chunks; lines end with CR LF, LF or CR, and a tail without an end waits for the next chunk.

    The state of a port is its tail, cut to its last `kept` characters beyond `longest`.
    """
    import re

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = chunks.schema[port].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail = state.get[0] if state.exists else ""
        got = pd.concat(list(batches)).sort_values(order)
        out: list[str] = []
        for chunk in got[text]:
            tail += chunk or ""
            if len(tail) > longest:
                tail = tail[-kept:]
            *ended, tail = re.split(r"\r\n|\n|\r", tail)
            out += ended
        state.update((tail,))
        yield pd.DataFrame({port: [key[0]] * len(out), "line": out})

    return chunks.groupBy(port).applyInPandasWithState(run, f"{port} {kind}, line string", "tail string", "append", GroupStateTimeout.NoTimeout)


def ring(samples: DataFrame, series: str, order: Sequence[str], value: str, most: int) -> DataFrame:
    """ST5: rows (series, newest values, the oldest first) of a stream: the last `most` by order, whatever the batches they came in."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind, held = samples.schema[series].dataType.simpleString(), samples.schema[value].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = list(zip(*state.get, strict=True)) if state.exists else []
        got = pd.concat(list(batches))
        new = list(zip(got["_order"], got[value], strict=True))
        both = sorted([*old, *new], key=lambda x: x[0])[-most:]
        state.update(([o for o, _ in both], [v for _, v in both]))
        yield pd.DataFrame({series: [key[0]], "held": [[v for _, v in both]]})

    # an order that strings keep: whole numbers, lifted so that none is negative, and padded
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if samples.schema[c].dataType.simpleString().startswith("timestamp") else F.col(c).cast("long")
    parts = (F.lpad((number(c).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0") for c in order)
    rows = samples.select(series, value, F.concat(*parts).alias("_order"))
    return rows.groupBy(series).applyInPandasWithState(run, f"{series} {kind}, held array<{held}>", f"orders array<string>, vals array<{held}>", "update", GroupStateTimeout.NoTimeout)


def stale(state: DataFrame, last: str, now, seconds: int = 5) -> DataFrame:
    """ST6: series with whether their last update is more than so many seconds before now."""
    return state.withColumn("stale", F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(last).cast("timestamp")) > F.lit(seconds * 1_000_000))


def debounced(changes: DataFrame, path: str, at: str, gap_ms: int = 800) -> DataFrame:
    """ST8: rows (path, at): the last change of each run of changes less than a gap apart. A session window, so a stream needs a watermark."""
    return changes.groupBy(path, F.session_window(at, f"{gap_ms} milliseconds")).agg(F.max(at).alias(at)).select(path, at)


def content_changes(manifest: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """ST10: rows (key, action): `rewrite` where the content is new or has another hash, `prune` where it is gone; what is the same is not there."""
    both = current.select(key, F.col(digest).alias("_new")).join(manifest.select(key, F.col(digest).alias("_old")), key, "full")
    action = F.when(F.col("_new").isNull(), "prune").when(~F.col("_new").eqNullSafe(F.col("_old")), "rewrite")
    return both.select(key, action.alias("action")).where("action is not null")


def alarms(samples: DataFrame, by: str, order: Sequence[str], cpu: str, threads: str) -> DataFrame:
    """ST9: samples with the peak so far and whether a limit (80 % of CPU, 20 threads) is passed."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("peak", F.max(cpu).over(w)).withColumn("alarm", (F.col(cpu) > 80) | (F.col(threads) > 20))


def monitored(samples: DataFrame, by: str, order: str, cpu: str, threads: str, kept: int = 30) -> DataFrame:
    """ST9: rows (by, order, peak, alarm, growing) of a stream: the peak so far, whether a limit (80 % of CPU, 20 threads) is passed, and W3's growth of more than 15 % over the last `kept` samples.

    The state of a series is its peak and its last values; a batch's samples count in order.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {c: samples.schema[c].dataType.simpleString() for c in (by, order)}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak, last = state.get if state.exists else (None, [])
        last, out = list(last), []
        for at, value, n in pd.concat(list(batches)).sort_values(order)[[order, cpu, threads]].itertuples(index=False):
            peak = value if peak is None else max(peak, value)
            last = [*last, value][-kept:]
            growing = len(last) == kept and last[0] > 0 and last[-1] > 1.15 * last[0]
            out.append((key[0], at, peak, bool(value > 80 or n > 20), bool(growing)))
        state.update((peak, last))
        yield pd.DataFrame(out, columns=[by, order, "peak", "alarm", "growing"])

    return samples.select(by, order, F.col(cpu).cast("double").alias(cpu), threads).groupBy(by).applyInPandasWithState(run, f"{by} {kinds[by]}, {order} {kinds[order]}, peak double, alarm boolean, growing boolean", "peak double, last array<double>", "append", GroupStateTimeout.NoTimeout)


def rewrites(changes: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """ST10: rows (key, order, action) of a stream of saved contents: rewrite where a key's digest is new or another than its last, prune where it is null and the key was there."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {c: changes.schema[c].dataType.simpleString() for c in (key, order)}

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = (state.get[0] if state.exists else None), []
        for at, now in pd.concat(list(batches)).sort_values(order)[[order, digest]].itertuples(index=False):
            now = now if isinstance(now, str) else None
            if now != last:
                out.append((own[0], at, "prune" if now is None else "rewrite"))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, order, "action"])

    return changes.select(key, order, digest).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, action string", "last string", "append", GroupStateTimeout.NoTimeout)
