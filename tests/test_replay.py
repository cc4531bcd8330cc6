"""The replayed log behind the streamed queries."""

import os

from pyspark.sql import functions as F

from srcgraph.plans.catalog import _Replay


def test_a_part_of_the_log_lies_in_many_files_and_is_one_batch(spark):
    log = spark.range(40_000).repartition(8).select(
        (F.col("id") % 50).alias("session_id"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"),
        F.lit("node:added").alias("event"), F.sha2(F.col("id").cast("string"), 512).alias("data"))
    seen, files = [], []
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "256k")
    try:
        replay = _Replay(spark, log, 2)

        def step(stream):
            files.append(len([f for f in os.listdir(f"{replay.folder}/log".removeprefix("file:")) if f.startswith("part-")]))
            write = lambda batch, _: seen.append(tuple(batch.agg(F.count("*"), F.min("seq"), F.max("seq")).first()))
            query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{replay.folder}/state")
            query.trigger(availableNow=True).start().awaitTermination()

        replay.through(step)
    finally:
        spark.conf.set(size, before)
    assert [s for s in seen if s[0]][-1] == (1, 0, 0)
    (n, low, high), (m, then, last) = [s for s in seen if s[0]][:2]
    assert (low, last, n + m, then) == (0, 39_999, 40_000, high + 1)
    assert len([s for s in seen if s[0]]) == 3
    assert files[0] > 2 and files[1] - files[0] > 2
