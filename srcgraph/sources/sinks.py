"""Tables the jobs leave behind.

Rows are written in batches, and a batch names the groups (sessions) it replaces, also
those that are left without rows. A reader takes each group from the last batch that
named it, so a group is replaced whole, and a batch counts only once its list of groups
is there: a write that breaks off changes nothing.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.operators.report import entity_rows, fact_rows

BUCKETS = 64


def _write_groups(frames: dict[str, DataFrame], groups: DataFrame, path: str, column: str) -> None:
    """Replace `groups` (one column) by what the frames hold of them.

    Files gather rows by a hash of the group, sorted by it; REBALANCE splits a huge group
    over several tasks and files. The list of groups is written last.
    """
    batch = time.time_ns()
    for name, df in frames.items():
        bucket = F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(BUCKETS))
        rows = df.join(groups, [column], "left_semi").withColumn("__bucket", bucket).hint("rebalance", "__bucket")
        rows.drop("__bucket").sortWithinPartitions(column).write.parquet(f"{path}/{name}/batch={batch}")
    groups.coalesce(1).write.parquet(f"{path}/groups/batch={batch}")


def read_groups(spark: SparkSession, path: str, name: str, column: str) -> DataFrame:
    """Current rows of one of the frames."""
    last = spark.read.parquet(f"{path}/groups").groupBy(column).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/{name}").join(last, [column, "batch"], "left_semi").drop("batch")


def _named(groups: DataFrame | None, column: str, *frames: DataFrame) -> DataFrame:
    if groups is not None:
        return groups.select(column).distinct()
    named = frames[0].select(column)
    for df in frames[1:]:
        named = named.unionByName(df.select(column))
    return named.distinct()


def write_entities(nodes: DataFrame, path: str, groups: DataFrame | None = None) -> None:
    """Entity rows per group; `groups` (group_id) names those to replace, by default the ones with nodes."""
    rows = entity_rows(nodes)
    _write_groups({"rows": rows}, _named(groups, "group_id", rows), path, "group_id")


def write_facts(nodes: DataFrame, path: str, groups: DataFrame | None = None) -> None:
    rows = fact_rows(nodes)
    _write_groups({"rows": rows}, _named(groups, "group_id", rows), path, "group_id")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Current rows of an entity or fact table."""
    return read_groups(spark, path, "rows", "group_id")


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str, sessions: DataFrame | None = None) -> None:
    """Final nodes and edges per session; a session that is written again is replaced whole.

    sessions  (session_id) to replace, also those without nodes or edges; by default all
              that have any
    """
    named = _named(sessions, "session_id", nodes, edges)
    _write_groups({"nodes": nodes, "edges": edges}, named, path, "session_id")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Current nodes and edges of all sessions."""
    return read_groups(spark, path, "nodes", "session_id"), read_groups(spark, path, "edges", "session_id")


def write_events(log: DataFrame, path: str) -> None:
    """Append events to the log, one folder per day so that readers can prune."""
    (
        log.withColumn("day", F.to_date("ts")).hint("rebalance", "day")
        .write.mode("append").partitionBy("day").parquet(path)
    )
