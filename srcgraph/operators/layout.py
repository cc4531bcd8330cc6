"""Column layout and connectivity of the finished graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.ranking import position

# The column of each node type, and the geometry.
COLUMN_RANK = {"feature": 0, "service": 1, "api": 2, "database": 2, "infra": 3, "external": 3}
DEFAULT_RANK = 1
COLUMN_WIDTH = 320
ROW_STEP = 130
ROW_START = 40


def column_rank(type_: Column, default: int) -> Column:
    expr = F.when(F.lit(False), F.lit(None).cast("int"))
    for name, rank in COLUMN_RANK.items():
        expr = expr.when(type_ == name, rank)
    return expr.otherwise(default)


def layout_columns(nodes: DataFrame, ord_col: str = "ord", then: tuple[str, ...] = ()) -> DataFrame:
    """Add `x`, `y`: one column per rank, nodes stacked in order within session and column.

    `ord_col` must be unique per session together with `then`.
    """
    ranked = nodes.withColumn("rank", column_rank(F.col("type"), DEFAULT_RANK))
    placed = position(ranked, ["session_id", "rank"], ord_col, "place", then)
    return placed.select(
        *nodes.columns, "rank",
        (F.col("rank") * COLUMN_WIDTH).cast("double").alias("x"),
        ((F.col("place") - 1) * ROW_STEP + ROW_START).cast("double").alias("y"),
    )


def intra_column_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends stand in the same column; ends that are no known node never match."""
    rank = column_rank(F.col("type"), -1)
    ends = nodes.select("session_id", "id", rank.alias("rank"))
    source = ends.select("session_id", F.col("id").alias("source"), F.col("rank").alias("source_rank_no"))
    target = ends.select("session_id", F.col("id").alias("target"), F.col("rank").alias("target_rank_no"))
    return (
        edges.join(source, ["session_id", "source"]).join(target, ["session_id", "target"])
        .filter((F.col("source_rank_no") == F.col("target_rank_no")) & (F.col("source_rank_no") >= 0))
        .select(*edges.columns, F.col("source_rank_no").alias("rank"))
    )


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and total degree of every node; each edge counts at both ends."""
    ends = F.array(
        F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    counts = (
        edges.select("session_id", F.explode(ends).alias("e"))
        .groupBy("session_id", F.col("e.id").alias("id"))
        .agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    )
    zero = F.lit(0).cast("bigint")
    return nodes.select("session_id", "id").join(counts, ["session_id", "id"], "left").select(
        "session_id", "id",
        F.coalesce("out_degree", zero).alias("out_degree"),
        F.coalesce("in_degree", zero).alias("in_degree"),
        (F.coalesce("out_degree", zero) + F.coalesce("in_degree", zero)).alias("degree"),
    )
