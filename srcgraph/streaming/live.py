"""Streaming jobs over the event log.

Folds of streaming/events.py run as native streaming aggregates (RocksDB state,
update mode). The rule that a session is closed by its first terminal event is applied
before them: `gate_sessions` writes accepted events to a table that the folds read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from srcgraph.schemas import EVENT_LOG
from srcgraph.streaming.events import accepted_events, closings, parse_events


def _trigger(writer, available_now: bool, every: str):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)


def _merges(spark, folder: str) -> list[int]:
    """Numbers of the `name=number` folders in `folder` that have been written to the end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    done = [s.getPath() for s in files.listStatus(path) if files.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
    return [int(p.getName().split("=")[1]) for p in done]


def gate_sessions(log: DataFrame, out_dir: str, checkpoint: str, available_now: bool = False,
                  every: str = "10 seconds", merge_every: int = 100) -> StreamingQuery:
    """Write the accepted part of a log stream under `out_dir/accepted`, closings under `out_dir/closings`.

    Every batch overwrites its own `batch=` folder, so a batch that is run again leaves
    the same rows. Closings hold one row per closed session and batch, never events,
    and are merged once `merge_every` batches have come since the last merge, so that no
    batch reads a long list of files; the number may change between runs.

    An event that comes in an earlier batch than the terminal event before it (by `seq`)
    has already been written; `accepted_events` over the whole log leaves it out.
    """
    spark = log.sparkSession

    def closed(first: int, last: int) -> DataFrame:
        """First terminal event per session over the merged closings before `first` and the batches since."""
        paths = [f"{out_dir}/closings/batch={b}" for b in range(first, last + 1)]
        if first > 0:
            paths.append(f"{out_dir}/merged/before={first}")
        rows = spark.read.schema("session_id bigint, close_seq bigint").parquet(*paths)
        return rows.groupBy("session_id").agg(F.min("close_seq").alias("close_seq"))

    def write(batch: DataFrame, batch_id: int) -> None:
        closings(parse_events(batch)).write.mode("overwrite").parquet(f"{out_dir}/closings/batch={batch_id}")
        first = max([b for b in _merges(spark, f"{out_dir}/merged") if b <= batch_id], default=0)
        if batch_id - first >= merge_every:
            closed(first, batch_id - 1).write.mode("overwrite").parquet(f"{out_dir}/merged/before={batch_id}")
            first = batch_id
        accepted_events(batch, closed(first, batch_id)).write.mode("overwrite").parquet(
            f"{out_dir}/accepted/batch={batch_id}"
        )

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now, every).start()


def accepted_stream(spark, out_dir: str) -> DataFrame:
    """What `gate_sessions` accepted, as a parsed stream."""
    return parse_events(spark.readStream.schema(EVENT_LOG).parquet(f"{out_dir}/accepted/*"))


def without_repeats(log: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Drop repeated deliveries that arrive within `delay` of each other."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def run_fold(events: DataFrame, fold: Callable[[DataFrame], DataFrame], out_dir: str, checkpoint: str,
             available_now: bool = False, every: str = "10 seconds", keys: list[str] | None = None,
             merge_every: int = 100) -> StreamingQuery:
    """Keep a fold up to date: each batch writes the keys it changed to its own `batch=` folder.

    With the fold's `keys`, the current rows are merged once `merge_every` batches have
    come since the last merge; `latest_fold` then reads the merge and the batches since.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batches/batch={batch_id}")
        if keys and batch_id - max(_merges(spark, f"{out_dir}/merged"), default=0) >= merge_every:
            _latest(spark, out_dir, keys, batch_id).write.mode("overwrite").parquet(f"{out_dir}/merged/before={batch_id}")

    writer = (
        fold(events).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, available_now, every).start()


def _latest(spark, out_dir: str, keys: list[str], before: int | None = None) -> DataFrame:
    """Rows of the last batch that wrote each key, with `batch`, over all batches (or those under `before`)."""
    first = max([m for m in _merges(spark, f"{out_dir}/merged") if before is None or m < before], default=0)
    batches = [b for b in _merges(spark, f"{out_dir}/batches") if b >= first and (before is None or b < before)]
    base = f"{out_dir}/batches"
    rows = spark.read.option("basePath", base).parquet(*[f"{base}/batch={b}" for b in batches]) if batches else None
    if first:
        merged = spark.read.parquet(f"{out_dir}/merged/before={first}")
        rows = merged if rows is None else rows.unionByName(merged)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "batch").alias("r"), F.max("batch").alias("batch")
    ).select(*keys, "r.*", "batch")


def latest_fold(spark, out_dir: str, keys: list[str]) -> DataFrame:
    """Current rows of a fold: the last batch that wrote a key wins."""
    return _latest(spark, out_dir, keys).drop("batch")


def split_late(log: DataFrame, out_dir: str, checkpoint: str, delay: str, available_now: bool = False,
               every: str = "10 seconds") -> StreamingQuery:
    """Write rows in time under `out_dir/in_time`, rows that came more than `delay` too late under `out_dir/late`.

    Late is what a watermark of that delay would drop: a row older, by more than `delay`, than the newest row of
    the batches before its own. No row is lost or given twice: a batch that runs again overwrites its own
    folders, and reads one number, the newest time that the last batch before it left. What reads `in_time`
    under the same delay drops nothing.
    """
    spark = log.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        before = max([b for b in _merges(spark, f"{out_dir}/newest") if b < batch_id], default=None)
        last = None if before is None else spark.read.parquet(f"{out_dir}/newest/batch={before}").first()["ts"]
        late = F.lit(False) if last is None else F.coalesce(F.col("ts") < F.lit(last) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        batch = batch.persist()
        batch.filter(~late).write.mode("overwrite").parquet(f"{out_dir}/in_time/batch={batch_id}")
        batch.filter(late).write.mode("overwrite").parquet(f"{out_dir}/late/batch={batch_id}")
        newest = batch.agg(F.greatest(F.max("ts"), F.lit(last).cast("timestamp")).alias("ts"))
        newest.write.mode("overwrite").parquet(f"{out_dir}/newest/batch={batch_id}")
        batch.unpersist()

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now, every).start()


def in_time(spark, out_dir: str) -> DataFrame:
    """What `split_late` found to be in time, as a stream of log rows."""
    return spark.readStream.schema(EVENT_LOG).parquet(f"{out_dir}/in_time/*")


def burst_stream(log: DataFrame, gap: str, delay: str) -> DataFrame:
    """`session_windows` of a stream: each burst of a session once the watermark has passed its end.

    An event that comes exactly `gap` after another joins its burst here, as is Spark's rule; there it starts anew.
    """
    return (
        log.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("session_id", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "n")
    )


def rate_stream(log: DataFrame, width: str, delay: str) -> DataFrame:
    """Event counts per kind and closed window; later rows than `delay` are not counted."""
    return (
        log.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event", "n")
    )
