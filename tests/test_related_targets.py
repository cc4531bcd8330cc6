"""Targets of chosen entities out of ranges, against a plain loop."""

from pyspark.sql import functions as F

from srcgraph.operators import build

SCHEMA = "session_id bigint, source string, source_place bigint, first_target bigint, last_target bigint, n_targets bigint"


def ranges(spark, sizes):
    rows = [
        (s, f"{s}-{place}", place, place + 1, n, n - place) for s, n in sizes.items() for place in range(1, n + 1)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_equal_a_plain_loop_over_several_buckets(spark):
    sizes = {1: 2 * build.TARGET_BUCKET + 5, 2: 1, 3: 3}
    asked = [(1, 1), (1, 1023), (1, 1024), (1, 2047), (1, sizes[1]), (2, 1), (3, 2), (3, 2), (3, 9), (8, 1)]
    chosen = spark.createDataFrame([(s, f"{s}-{p}", "x") for s, p in asked] + [(None, None, "y")],
                                   "session_id bigint, source string, target string")
    got = build.related_targets(ranges(spark, sizes), chosen)
    want = {(s, f"{s}-{p}", f"{s}-{t}", t) for s, p in asked if p <= sizes.get(s, 0) for t in range(p + 1, sizes[s] + 1)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_no_entities_and_none_chosen(spark):
    some = ranges(spark, {1: 4})
    none = some.select("session_id", "source").limit(0)
    assert build.related_targets(some, none).collect() == []
    assert build.related_targets(some.limit(0), some.select("session_id", "source")).collect() == []


def test_pairs_are_joined_by_bucket_not_by_session(spark):
    plan = build.related_targets(ranges(spark, {1: 4}), ranges(spark, {1: 4}).filter(F.col("source_place") == 1))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in text and "Cross" not in text


def test_pairs_are_dealt_out_by_their_number(spark, monkeypatch):
    """All 1,124,250 pairs of one session of 1,500 entities: the small inputs do not put them into a few tasks."""
    monkeypatch.setattr(build, "PAIRS_A_TASK", 20_000)
    related = ranges(spark, {1: 1500})
    got = build.related_targets(related, related).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in got) == 1500 * 1499 // 2
    assert max(r["count"] for r in got) < 200_000
