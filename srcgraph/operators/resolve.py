"""Union, entity resolution, edge remap, review and consistency of the graph.

Nodes: `(session_id, <order columns>, id, type, label, confidence, …)`; ids are unique
per session. `order` names the columns that fix the sequence of nodes or edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.joins import keyed_join
from srcgraph.functions.text import label_key

ORDER = ("source_rank", "ord", "sub")
LOW_CONFIDENCE = 0.7


def union_findings(parts: list[DataFrame | None]) -> DataFrame:
    """All findings; sources that failed (None) contribute nothing. Order lives in the rows."""
    present = [p for p in parts if p is not None]
    return reduce(lambda a, b: a.unionByName(b), present)


def node_key() -> Column:
    return F.concat(F.col("type"), F.lit(":"), label_key(F.col("label")))


def _negated(order: tuple[str, ...]) -> list[Column]:
    return [-F.col(c).cast("bigint") for c in order]


def dedupe_nodes(nodes: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One node per type and label key: first id and place, all else from the most confident.

    Ties keep the earlier node. A null or NaN confidence never wins, and when the first
    node has one it is never replaced. Partial aggregation runs before the shuffle, so
    a key that holds a third of all nodes shuffles one row per task.
    """
    fixed = {"session_id", "id", *order}
    payload = F.struct(*[c for c in nodes.columns if c not in fixed])
    place = F.struct(*order)
    valid = F.col("confidence").isNotNull() & ~F.isnan("confidence")
    strength = F.when(valid, F.struct(F.col("confidence"), *_negated(order)))
    picked = (
        nodes.withColumn("__key", node_key())
        .groupBy("session_id", "__key")
        .agg(
            F.min_by(F.struct("id", *order), place).alias("first"),
            F.min_by(payload, place).alias("first_payload"),
            F.max_by(payload, strength).alias("best_payload"),
        )
    )
    first_confidence = F.col("first_payload.confidence")
    usable = first_confidence.isNotNull() & ~F.isnan(first_confidence)
    return picked.select(
        "session_id", "first.*",
        F.when(usable, F.col("best_payload")).otherwise(F.col("first_payload")).alias("p"),
    ).select("session_id", "id", *order, "p.*").select(*nodes.columns)


def node_id_map(nodes: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """`(session_id, id, survivor_id)` for every node.

    A pre-aggregated survivor per key, joined back. Only ids and keys travel; one key
    with very many nodes is a skewed join side that adaptive execution splits.
    """
    keyed = nodes.select("session_id", "id", *order, node_key().alias("__key"))
    survivors = keyed.groupBy("session_id", "__key").agg(
        F.min_by("id", F.struct(*order)).alias("survivor_id")
    )
    return keyed_join(keyed.select("session_id", "id", "__key"), survivors, ["session_id", "__key"]).drop("__key")


def remap_edges(edges: DataFrame, id_map: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Edges between survivors: unknown ids kept, self-loops dropped, first of equal edges kept.

    Direction is not normalised: A to B and B to A are two edges.
    """
    ids = id_map.filter(F.col("id") != F.col("survivor_id"))
    as_source = ids.select("session_id", F.col("id").alias("source"), F.col("survivor_id").alias("new_source"))
    as_target = ids.select("session_id", F.col("id").alias("target"), F.col("survivor_id").alias("new_target"))
    moved = (
        edges.join(as_source, ["session_id", "source"], "left")
        .join(as_target, ["session_id", "target"], "left")
        .withColumn("source", F.coalesce("new_source", "source"))
        .withColumn("target", F.coalesce("new_target", "target"))
        .filter(F.col("source") != F.col("target"))
    )
    key = ("session_id", "source", "target", "relationship_type")
    rest = [c for c in edges.columns if c not in key]
    first = moved.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("e"))
    return first.select(*key, "e.*").select(*edges.columns)


def low_confidence(nodes: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Nodes a reviewer should look at. NaN compares false, as in the reference."""
    return nodes.filter((F.col("confidence") < threshold) & ~F.isnan("confidence"))


def removed_ids(verdicts: DataFrame) -> DataFrame:
    """Distinct `(session_id, id)` to remove; `keep` lists decide nothing."""
    return verdicts.filter(F.col("decision") == "remove").select(
        "session_id", F.col("node_id").alias("id")
    ).distinct()


def apply_verdicts(nodes: DataFrame, edges: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph without the removed nodes and without any edge that touches one."""
    removed = removed_ids(verdicts)
    kept_nodes = nodes.join(removed, ["session_id", "id"], "left_anti")
    by_source = removed.withColumnRenamed("id", "source")
    by_target = removed.withColumnRenamed("id", "target")
    kept_edges = keyed_join(edges, by_source, ["session_id", "source"], "left_anti")
    return kept_nodes, keyed_join(kept_edges, by_target, ["session_id", "target"], "left_anti")
