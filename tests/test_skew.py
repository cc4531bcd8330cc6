"""Hot keys: a third of all rows under one key must be split, not sent to one task."""

import pytest
from pyspark.sql import functions as F

from srcgraph.functions import joins
from srcgraph.functions.ranking import in_order, position, running_total
from srcgraph.operators import prompts, resolve
from srcgraph.streaming import events as ev

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def tight(spark):
    """Thresholds so small that a small table counts as skewed."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)



def run(df):
    """Run `df` itself, so that its own adaptive plan is the one looked at."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_hot_duplicate_is_split_in_the_id_map(tight):
    nodes = tight.range(0, 60_000, 1, 12).select(
        (F.col("id") % 7).alias("session_id"), F.col("id").alias("ord"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"),
        F.lit("api").alias("type"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("L"), F.col("id").cast("string"))).alias("label"),
        F.lit(0.5).alias("confidence"),
    ).withColumn("session_id", F.when(F.col("label") == "hot", 0).otherwise(F.col("session_id")))
    rows, plan = run(resolve.node_id_map(nodes, ("ord",)))
    assert "skew=true" in plan
    assert len(rows) == 60_000
    assert {r["survivor_id"] for r in rows if int(r["id"][1:]) % 3 == 0} == {"n0"}


def test_hot_session_is_split_when_events_are_cut_off(tight):
    log = tight.range(0, 60_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).cast("bigint").alias("session_id"), F.col("id").alias("seq"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
        F.when(F.col("id") == 30_000, F.lit("error")).otherwise(F.lit("node:added")).alias("event"),
        F.when(F.col("id") == 30_000, F.lit('{"message":"x"}')).otherwise(F.lit('{"id":"a"}')).alias("data"),
    )
    rows, plan = run(ev.accepted_events(ev.parse_events(log)).select("session_id", "seq", "data"))
    assert "skew=true" in plan
    hot = [r["seq"] for r in rows if r["session_id"] == 0]
    assert max(hot) == 30_000 and len(rows) == sum(1 for i in range(60_000) if not (i > 30_000 and (i % 3 == 0 or i % 1000 == 0)))


def test_findings_of_one_ord_lie_over_many_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        n = 1_000_000
        one = spark.range(0, n, 1, 8).select(
            F.lit(1).alias("session_id"), F.lit(7).cast("bigint").alias("ord"), (n - 1 - F.col("id")).alias("sub"))
        dealt = in_order(one, ["session_id"], ["ord", "sub"])
        per_task = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) == 8 and max(per_task) < n / 4
        assert dealt.groupBy("__block").count().agg(F.max("count")).first()[0] <= 1 << 16
        placed = position(one, ["session_id"], "ord", "place", ("sub",))
        assert placed.filter("place != sub + 1").isEmpty() and placed.count() == n
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan.split("BroadcastExchange")[0], "rows themselves go through no window"
        total = running_total(one, ["session_id"], "ord", F.lit(2), "t", ("sub",))
        assert total.filter("t != 2 * (sub + 1)").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_product_of_one_session_lies_over_many_tasks(spark, monkeypatch):
    """Parts of files times batches of nodes, where the batches are too many to be broadcast."""
    files = spark.range(0, 240, 1, 4).select(
        (F.col("id") % 3 + F.when(F.col("id") % 3 == 2, 40).otherwise(0)).alias("repo_id"), F.col("id").alias("ord"),
        F.concat(F.lit("/src/pages/Home"), F.col("id").cast("string"), F.lit("Page.tsx")).alias("path"),
        F.when(F.col("id") % 3 == 1, "x" * 60).otherwise("y" * 4000).alias("content"),
    ).withColumn("repo_id", F.when(F.col("ord") % 60 == 59, F.lit(None)).otherwise(F.col("repo_id")))
    nodes = spark.range(0, 1500, 1, 4).select(
        F.when(F.col("id") < 1460, 0).otherwise(1).cast("bigint").alias("session_id"), F.col("id").alias("ord"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.lit("api").alias("type"), F.lit("L").alias("label"))
    plain = prompts.feature_prompts(files, nodes, ["ord"]).collect()
    assert len(plain) == 80 * 2 * 49 + 80 * 2 + 80 * 2 and len({tuple(r) for r in plain}) == len(plain)
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    monkeypatch.setattr(joins, "PAIR_ROWS", 16, raising=False)
    monkeypatch.setattr(joins, "PAIR_LOOKUPS", 20, raising=False)
    limits = [k for k in SETTINGS if "BroadcastJoinThreshold" in k]
    before = {k: spark.conf.get(k, None) for k in limits}
    for k in limits:
        spark.conf.set(k, "-1")
    try:
        dealt = prompts.feature_prompts(files, nodes, ["ord"]).withColumn("__task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(repr, (tuple(r)[:-1] for r in dealt))) == sorted(repr(tuple(r)) for r in plain)
    per_task = {}
    for r in dealt:
        if r["repo_id"] == 0:
            per_task[r["__task"]] = per_task.get(r["__task"], 0) + 1
    assert len(per_task) > 8 and max(per_task.values()) < 80 * 2 * 49 / 4
