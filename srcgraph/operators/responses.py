"""Findings out of recorded model answers: free text with one JSON array or object inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.schemas import ANSWER_SHAPES, PLAN_SHAPE, VERDICT_SHAPE

_ARRAY = r"(?s)\[.*\]"
_OBJECT = r"(?s)\{.*\}"


def json_array(text: Column) -> Column:
    """First `[` to last `]`, its elements as JSON texts; an empty array where that fails."""
    elements = F.from_json(F.regexp_extract(text, _ARRAY, 0), "array<string>")
    return F.coalesce(elements, F.array().cast("array<string>"))


def json_object(text: Column, shape: str) -> Column:
    """First `{` to last `}`, parsed; null where that fails."""
    return F.from_json(F.regexp_extract(text, _OBJECT, 0), shape)


def parse_responses(responses: DataFrame, agent: str) -> DataFrame:
    """One row per record: the answer's columns without `text`, then `sub` and the record's fields.

    Each element is parsed by itself: one that is null or no object is left out, the
    others stay.
    """
    rest = [c for c in responses.columns if c != "text"]
    return (
        responses.select(*rest, F.posexplode(json_array(F.col("text"))).alias("sub", "element"))
        .filter(F.startswith("element", F.lit("{")))
        .withColumn("r", F.from_json("element", ANSWER_SHAPES[agent]))
        .filter(F.col("r").isNotNull())
        .select(*rest, "sub", "r.*")
    )


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """`(…, decision, pos, node_id)` from review answers; an unparsable answer decides nothing."""
    rest = [c for c in responses.columns if c != "text"]
    empty = F.array().cast("array<string>")
    verdict = responses.select(*rest, json_object(F.col("text"), VERDICT_SHAPE).alias("v"))
    lists = F.array(*[
        F.struct(F.lit(d).alias("decision"), F.coalesce(F.col(f"v.{d}"), empty).alias("ids"))
        for d in ("keep", "remove")
    ])
    return (
        verdict.select(*rest, F.explode(lists).alias("l"))
        .select(*rest, "l.decision", F.posexplode_outer("l.ids").alias("pos", "node_id"))
        .filter(F.col("node_id").isNotNull())
    )


def parse_plans(responses: DataFrame) -> DataFrame:
    """`(…, role, pos, path)` from planning answers, paths still relative to the root."""
    rest = [c for c in responses.columns if c != "text"]
    empty = F.array().cast("array<string>")
    roles = {"entry": "entryPoints", "route": "routeFiles", "model": "modelFiles", "config": "configFiles"}
    plan = responses.select(*rest, json_object(F.col("text"), PLAN_SHAPE).alias("p"))
    lists = F.array(*[
        F.struct(F.lit(role).alias("role"), F.coalesce(F.col(f"p.{field}"), empty).alias("paths"))
        for role, field in roles.items()
    ])
    return (
        plan.select(*rest, F.explode(lists).alias("l"))
        .select(*rest, "l.role", F.posexplode_outer("l.paths").alias("pos", "path"))
        .filter(F.col("path").isNotNull())
    )
