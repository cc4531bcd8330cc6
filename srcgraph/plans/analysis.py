"""The whole analysis: files of many repositories to one resolved, laid-out graph.

A session is the analysis of one repository, so `session_id` is the repository id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.operators import build, extract, files as filing, layout, resolve, responses, rules
from srcgraph.session import shared_dir

READ_RULES = rules.ROUTE_RULES + rules.MODEL_RULES

# Room for any `ord` (below 2**59) under the source rank.
RANK_STEP = 1 << 59


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    related: DataFrame


class Workspace:
    """Written intermediate tables: each stage is computed once and survives lost executors."""

    def __init__(self, spark, base: str | None = None):
        self.spark = spark
        self.base = f"{base or shared_dir(spark)}/analysis-{uuid.uuid4().hex}"

    def saved(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def with_sequence(nodes: DataFrame) -> DataFrame:
    """Add `seq`: source rank and `ord` as one sortable number."""
    return nodes.withColumn("seq", F.col("source_rank").cast("bigint") * F.lit(RANK_STEP) + F.col("ord"))


def analyze(
    source: DataFrame,
    service_answers: DataFrame | None = None,
    feature_answers: DataFrame | None = None,
    verdict_answers: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    entry_points: DataFrame | None = None,
    endpoint_answers: DataFrame | None = None,
    entity_answers: DataFrame | None = None,
    external_answers: DataFrame | None = None,
    plan_answers: DataFrame | None = None,
    work_dir: str | None = None,
) -> Graph:
    """Run every stage. Answers are tables of recorded model responses `(session_id, ord, …, text)`.

    Endpoints, entities and external services come from the extraction rules, services
    and features from answers; records of endpoint, entity and external answers
    join what the rules found. Verdicts can be a function of the resolved nodes, which are then written
    and handed to it, so that a review needs no analysis of its own. File contents are read once: what rules, services and
    frameworks need of them is written and used from there on.
    """
    work = Workspace(source.sparkSession, work_dir)
    kept = filing.read_text(filing.scan_files(source))

    # the one step that reads contents
    read = work.saved("read", extract.scan(kept, READ_RULES))
    profile = work.saved("profile", filing.profile_from(read).select(
        F.col("repo_id").alias("session_id"), "framework", "primary_language", "family", F.lit("/").alias("root")
    ))
    families = profile.filter("family IS NOT NULL").select(F.col("session_id").alias("repo_id"), "family")
    found = work.saved("found", extract.matches_of(read, READ_RULES, families))
    hits = work.saved("hits", extract.hits_of(read))
    sdks, keys = extract.sdks_from_hits(hits), extract.env_keys_from_hits(hits)

    def answered(answers: DataFrame, agent: str) -> DataFrame:
        """Records of answers, in order after everything that rules have found."""
        return responses.parse_responses(answers, agent).withColumns({
            "ord": F.col("ord") + F.lit(build.LATER), "sub": F.col("sub").cast("bigint") + F.lit(1 << 40),
        })

    if plan_answers is not None and entry_points is None:
        planned = responses.parse_plans(plan_answers).filter("role = 'entry'")
        entry_points = planned.select("session_id", F.struct("ord", "pos").alias("pos"), "path")
    main = build.main_nodes(profile, entry_points)
    endpoints = build.endpoints_from_routes(found.filter("kind = 'route'").withColumnRenamed("value", "route"))
    if endpoint_answers is not None:
        endpoints = endpoints.unionByName(build.endpoints_from_answers(answered(endpoint_answers, "api")))
    endpoints = build.endpoint_nodes(endpoints)
    entities = build.entities_from_models(found.filter("kind = 'model'").withColumnRenamed("value", "model"))
    if entity_answers is not None:
        entities = entities.unionByName(
            build.entities_from_answers(answered(entity_answers, "data").filter(F.col("name").isNotNull()))
        )
    entities = build.entity_nodes(entities)
    externals = build.externals_from_sdks(sdks, keys)
    if external_answers is not None:
        records_ = answered(external_answers, "infra").filter(F.col("name").isNotNull())
        externals = externals.unionByName(build.externals_from_answers(records_, externals))
    externals = build.external_nodes(externals)
    services = None
    if service_answers is not None:
        records = responses.parse_responses(service_answers, "service").filter(F.col("name").isNotNull())
        services = build.service_nodes(records, profile)
    earlier = work.saved("earlier", resolve.union_findings([main, endpoints, entities, services, externals]))

    features = None
    if feature_answers is not None:
        picked = build.dedupe_features(responses.parse_responses(feature_answers, "features"))
        features = work.saved("features", build.feature_nodes(picked))
    nodes = resolve.union_findings([earlier, features])

    def of(agent: str) -> DataFrame:
        return nodes.filter(F.col("agent_source") == agent)

    hub = of("planner")
    edges = [
        build.endpoint_edges(of("api"), hub),
        build.service_edges(of("service"), hub) if services is not None else None,
        build.service_deps(records, of("service")) if services is not None else None,
        build.external_edges(of("infra"), hub),
        build.feature_uses(picked, of("features"), earlier) if features is not None else None,
    ]
    all_edges = resolve.union_findings(edges)

    id_map = work.saved("id_map", resolve.node_id_map(nodes))
    final_nodes = resolve.dedupe_nodes(nodes)
    final_edges = resolve.remap_edges(all_edges, id_map)
    removed = None
    if verdict_answers is not None:
        if callable(verdict_answers):
            final_nodes = work.saved("resolved_nodes", final_nodes)
            verdict_answers = verdict_answers(final_nodes)
        verdicts = responses.parse_verdicts(verdict_answers)
        removed = resolve.removed_ids(verdicts)
        final_nodes, final_edges = resolve.apply_verdicts(final_nodes, final_edges, verdicts)
    related = build.relates_to_resolved(of("data"), id_map, removed)
    final_nodes = work.saved("final_nodes", final_nodes)
    placed = layout.layout_columns(with_sequence(final_nodes), "seq", ("sub",))
    return Graph(placed, final_edges, related)
