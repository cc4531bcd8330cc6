"""Every operator as a query over the given tables: `name -> (spark, sf_dir) -> DataFrame`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions import text
from srcgraph.operators import (
    build, extract, factindex, files, layout, prompts, report, requests, resolve, responses, search,
)
from srcgraph.plans import fixtures
from srcgraph.plans.analysis import Workspace, analyze
from srcgraph.schemas import EVENT_LOG, EVENT_PAYLOADS
from srcgraph.session import shared_dir
from srcgraph.sources import sinks
from srcgraph.streaming import events as ev
from srcgraph.streaming import frames, live, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORD = ("ord",)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return fixtures.view(spark, sf, name)


def kept(spark: SparkSession, sf: str) -> DataFrame:
    """Source files the scan keeps."""
    return files.scan_files(view(spark, sf, "source_files"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The same files for queries that read their contents."""
    return files.scan_files(fixtures.view(spark, sf, "source_files", {"documents": "doc_id"}))


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    log = view(spark, sf, "event_log")
    return ev.parse_events(log.withColumn("ts", F.col("ts").cast("timestamp")))


def typed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Fixture nodes with the metadata struct of their kind."""
    n = view(spark, sf, "typed_nodes")
    kind = F.col("type")
    fields = F.transform(
        F.when(F.col("n_fields") > 0, F.sequence(F.lit(1), F.col("n_fields").cast("int")))
        .otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.concat(F.lit("f"), i.cast("string")).alias("name"),
            F.when(i % 2 == 0, "int").otherwise("string").alias("type"),
            (i % 3 == 0).alias("nullable"),
        ),
    )
    keys = F.transform(
        F.when(F.col("n_keys") > 0, F.sequence(F.lit(1), F.col("n_keys").cast("int")))
        .otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("KEY"), i.cast("string")),
    )
    middlewares = F.when(F.col("flag"), F.array(F.lit("cors"), F.col("brand"))).otherwise(
        F.array().cast("array<string>")
    )
    name, path = F.col("name"), F.col("file_path")
    meta = (
        F.when(kind == "service", build.metadata(
            "service", name=name, language=F.col("language"), framework=F.col("framework"), file_path=path))
        .when(kind == "api", build.metadata(
            "api", method=F.col("method"), path=F.coalesce("route", F.lit("/")),
            handler_name=F.concat(F.lit("h"), F.col("size").cast("string")), auth_required=F.col("flag"),
            middlewares=middlewares, file_path=path, line_number=F.lit(0)))
        .when(kind == "database", build.metadata(
            "database", name=name, db_type=F.col("db_type"), orm=F.col("orm"), fields=fields, file_path=path))
        .when(kind == "feature", build.metadata(
            "feature", name=name, route=F.col("route"), file_path=path, uses_auth=F.col("flag")))
        .otherwise(build.metadata(
            "external", name=F.col("brand"), category=F.col("category"), env_keys=keys,
            sdk_package=F.lower("brand")))
    )
    return n.select("session_id", "ord", "id", "type", "label", "confidence", "agent_source", meta.alias("metadata"))


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return files.repo_profile(texts(spark, sf)).select(
        F.col("repo_id").alias("session_id"), "framework", "primary_language", F.lit("/").alias("root")
    )


def or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


# --- files -------------------------------------------------------------------------

@query
def scan_files(spark, sf):
    return kept(spark, sf).select("repo_id", "ord", "path")


@query
def read_text(spark, sf):
    raw = texts(spark, sf).withColumn("content", F.col("content").cast("binary"))
    return files.read_text(raw).select("repo_id", "ord", "content")


@query
def detect_language(spark, sf):
    return files.with_language(kept(spark, sf)).select("repo_id", "ord", "language")


@query
def repo_languages(spark, sf):
    return files.repo_languages(kept(spark, sf))


@query
def detect_framework(spark, sf):
    return files.detect_framework(texts(spark, sf))


@query
def relative_path(spark, sf):
    root = F.when(F.col("ord") % 2 == 0, "/src").otherwise("/.cache")
    return files.relative_path(view(spark, sf, "source_files"), root).select("ord", "path", "rel_path")


@query
def short_path(spark, sf):
    n = view(spark, sf, "typed_nodes")
    mixed = F.when(F.col("ord") % 2 == 0, F.replace("file_path", F.lit("/"), F.lit("\\"))).otherwise(F.col("file_path"))
    return n.select("session_id", "id", text.short_path(mixed).alias("short"))


@query
def classify_files(spark, sf):
    return files.classify_files(kept(spark, sf))


@query
def content_gates(spark, sf):
    return prompts.content_gates(texts(spark, sf))


@query
def step_targets(spark, sf):
    return files.step_targets(kept(spark, sf))


@query
def feature_candidates(spark, sf):
    k = kept(spark, sf)
    planned = k.filter(F.col("path").rlike(r"^/src/routes/"))
    return files.feature_candidates(k, planned)


# --- extraction ----------------------------------------------------------------------

@query
def extract_routes(spark, sf):
    return extract.extract_routes(texts(spark, sf)).select("repo_id", "ord", "rule", "match_pos", "route")


@query
def extract_routes_by_file(spark, sf):
    return extract.extract_routes(texts(spark, sf), "file").select("repo_id", "ord", "rule", "match_pos", "route")


@query
def routes_per_method(spark, sf):
    """How many endpoints per method each repository exposes."""
    routes = extract.extract_routes(texts(spark, sf))
    method = F.when(F.col("rule") == "handle_func", "any").otherwise(F.substring_index("route", " ", 1))
    return routes.groupBy("repo_id", method.alias("method")).agg(F.count("*").alias("n_endpoints"))


@query
def extract_models(spark, sf):
    return extract.extract_models(texts(spark, sf)).select("repo_id", "ord", "rule", "match_pos", "model")


@query
def extract_imports(spark, sf):
    return extract.extract_imports(texts(spark, sf)).select("repo_id", "ord", "rule", "match_pos", "package")


@query
def top_packages(spark, sf):
    return extract.top_packages(extract.extract_imports(texts(spark, sf)), 10)


@query
def extract_env_vars(spark, sf):
    return extract.extract_env_vars(texts(spark, sf)).select("repo_id", "ord", "pos", "env_key")


@query
def detect_sdks(spark, sf):
    return extract.detect_sdks(texts(spark, sf))


@query
def sdk_env_keys(spark, sf):
    return extract.sdk_env_keys(texts(spark, sf))


# --- recorded answers ------------------------------------------------------------------

@query
def parse_responses(spark, sf):
    got = responses.parse_responses(view(spark, sf, "model_responses"), "service")
    return got.select("session_id", "ord", "sub", "name", "filePath", F.array_join("dependsOn", ",").alias("depends_on"))


@query
def parse_endpoint_responses(spark, sf):
    got = build.endpoints_from_answers(responses.parse_responses(view(spark, sf, "endpoint_responses"), "api"))
    return got.select(
        "session_id", "ord", "sub", or_empty("method"), or_empty("url_path"), or_empty("handler_name"),
        F.coalesce("auth_required", F.lit(False)).alias("auth_required"),
        F.array_join("middlewares", ",").alias("middlewares"),
    )


@query
def parse_entity_responses(spark, sf):
    got = build.entities_from_answers(responses.parse_responses(view(spark, sf, "entity_responses"), "data"))
    shown = F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"], f["nullable"].cast("string")))
    return got.select("session_id", "ord", "sub", "name", "db_type", "orm", F.array_join(shown, ",").alias("fields"))


@query
def parse_external_responses(spark, sf):
    got = build.externals_from_answers(responses.parse_responses(view(spark, sf, "external_responses"), "infra"))
    return got.select("session_id", "name", "category", "sdk_package", "ord", "sub",
                      F.array_join("env_keys", ",").alias("env_keys"))


@query
def parse_verdicts(spark, sf):
    return responses.parse_verdicts(view(spark, sf, "verdict_responses"))


@query
def parse_plans(spark, sf):
    return responses.parse_plans(view(spark, sf, "plan_responses"))


# --- prompts ---------------------------------------------------------------------------

@query
def planner_prompts(spark, sf):
    return prompts.planner_prompts(texts(spark, sf))


@query
def build_prompts(spark, sf):
    """Endpoint and model prompts in one table."""
    k = texts(spark, sf)
    return (
        prompts.api_prompts(k).withColumn("agent", F.lit("api"))
        .unionByName(prompts.data_prompts(k).withColumn("agent", F.lit("data")))
    )


def file_plans(spark, sf):
    return responses.parse_plans(view(spark, sf, "planner_answers"))


@query
def planned_prompts(spark, sf):
    """Endpoint and model prompts where planners have listed files of most repositories."""
    k, plans = texts(spark, sf), file_plans(spark, sf)
    return (
        prompts.api_prompts(k, plans).withColumn("agent", F.lit("api"))
        .unionByName(prompts.data_prompts(k, plans).withColumn("agent", F.lit("data")))
    )


@query
def planned_feature_prompts(spark, sf):
    """Screen prompts, planned route files among the candidates."""
    return prompts.feature_prompts(texts(spark, sf), view(spark, sf, "nodes"), ["ord"], file_plans(spark, sf))


@query
def service_prompts(spark, sf):
    return prompts.service_prompts(texts(spark, sf))


@query
def infra_prompts(spark, sf):
    k = texts(spark, sf)
    return prompts.infra_prompts(k, extract.detect_sdks(k))


@query
def feature_prompts(spark, sf):
    return prompts.feature_prompts(texts(spark, sf), view(spark, sf, "nodes"), ["ord"])


@query
def router_prompts(spark, sf):
    return prompts.router_prompts(texts(spark, sf))


@query
def critic_prompts(spark, sf):
    return prompts.critic_prompts(typed_nodes(spark, sf))


# --- builders --------------------------------------------------------------------------

def entries(spark, sf):
    plans = responses.parse_plans(view(spark, sf, "plan_responses")).filter("role = 'entry'")
    return plans.select("session_id", F.struct("ord", "pos").alias("pos"), "path")


@query
def main_nodes(spark, sf):
    nodes = build.main_nodes(profile(spark, sf), entries(spark, sf))
    return nodes.select("session_id", "id", "label", "confidence", F.col("metadata.service.language").alias("language"),
                        F.col("metadata.service.file_path").alias("file_path"))


def endpoint_nodes_of(spark, sf):
    return build.endpoint_nodes(build.endpoints_from_routes(extract.extract_routes(texts(spark, sf))))


def entity_nodes_of(spark, sf):
    return build.entity_nodes(build.entities_from_models(extract.extract_models(texts(spark, sf))))


def services_of(spark, sf):
    records = responses.parse_responses(view(spark, sf, "model_responses"), "service")
    return records, build.service_nodes(records, profile(spark, sf))


def external_nodes_of(spark, sf):
    hits = Workspace(spark).saved("hits", extract.sdk_hits(texts(spark, sf)))
    return build.external_nodes(
        build.externals_from_sdks(extract.sdks_from_hits(hits), extract.env_keys_from_hits(hits))
    )


def features_of(spark, sf):
    picked = build.dedupe_features(responses.parse_responses(view(spark, sf, "feature_responses"), "features"))
    return picked, build.feature_nodes(picked)


def earlier_of(spark, sf):
    """Nodes of all sources before the features."""
    known = profile(spark, sf)
    records = responses.parse_responses(view(spark, sf, "model_responses"), "service")
    return resolve.union_findings([
        build.main_nodes(known), endpoint_nodes_of(spark, sf), entity_nodes_of(spark, sf),
        build.service_nodes(records, known), external_nodes_of(spark, sf),
    ])


EDGE_VIEW = ("session_id", "id", "source", "target", "type", "label", "animated", "relationship_type", "direction")


@query
def endpoint_nodes(spark, sf):
    nodes = endpoint_nodes_of(spark, sf)
    return nodes.select("session_id", "ord", "sub", "id", "label", "confidence", "agent_source",
                        F.col("metadata.api.file_path").alias("file_path"))


@query
def endpoint_graph(spark, sf):
    return build.endpoint_edges(endpoint_nodes_of(spark, sf), build.main_nodes(profile(spark, sf))).select(*EDGE_VIEW)


@query
def entity_nodes(spark, sf):
    return entity_nodes_of(spark, sf).select(
        "session_id", "ord", "sub", "id", "label", "confidence", F.col("metadata.database.orm").alias("orm"),
        F.col("metadata.database.db_type").alias("db_type"))


def saved_entities(spark, sf):
    """Entity nodes as a written table: the order-dependent steps read them several times."""
    return Workspace(spark).saved("entities", entity_nodes_of(spark, sf).drop("metadata"))


@query
def relates_to(spark, sf):
    return build.relates_to(saved_entities(spark, sf))


@query
def related_targets(spark, sf):
    """The targets of the entities found in files whose number is divisible by ten."""
    entities = saved_entities(spark, sf)
    related = Workspace(spark).saved("related", build.relates_to(entities))
    chosen = entities.filter("ord % 10 = 0").select("session_id", F.col("id").alias("source"))
    return build.related_targets(related, chosen)


@query
def relates_to_raw_count(spark, sf):
    k = texts(spark, sf)
    passed = prompts.content_gates(k).filter("data_gate").select(F.col("repo_id").alias("session_id"), "ord")
    return build.relates_to_raw_count(passed, saved_entities(spark, sf))


@query
def relates_to_resolved(spark, sf):
    nodes = saved_entities(spark, sf)
    return build.relates_to_resolved(nodes, resolve.node_id_map(nodes))


@query
def service_nodes(spark, sf):
    return services_of(spark, sf)[1].select(
        "session_id", "ord", "sub", "id", "label", "confidence", F.col("metadata.service.language").alias("language"),
        F.col("metadata.service.framework").alias("framework"), F.col("metadata.service.file_path").alias("file_path"))


@query
def service_graph(spark, sf):
    return build.service_edges(services_of(spark, sf)[1], build.main_nodes(profile(spark, sf))).select(*EDGE_VIEW)


@query
def service_deps(spark, sf):
    records, nodes = services_of(spark, sf)
    return build.service_deps(records, nodes).select("session_id", "ord", "sub", "source", "target", "relationship_type")


@query
def external_nodes(spark, sf):
    return external_nodes_of(spark, sf).select(
        "session_id", "ord", "sub", "id", "type", "label", F.col("metadata.external.sdk_package").alias("sdk_package"),
        F.array_join("metadata.external.env_keys", ",").alias("env_keys"))


@query
def external_graph(spark, sf):
    return build.external_edges(external_nodes_of(spark, sf), build.main_nodes(profile(spark, sf))).select(*EDGE_VIEW)


@query
def feature_nodes(spark, sf):
    return features_of(spark, sf)[1].select(
        "session_id", "ord", "sub", "id", "label", "confidence", F.col("metadata.feature.uses_auth").alias("uses_auth"),
        F.coalesce("metadata.feature.route", F.lit("")).alias("route"),
        F.col("metadata.feature.file_path").alias("file_path"))


@query
def feature_uses(spark, sf):
    picked, nodes = features_of(spark, sf)
    return build.feature_uses(picked, nodes, earlier_of(spark, sf)).select(
        "session_id", "ord", "sub", "source", "target", "label", "relationship_type")


# --- resolution -------------------------------------------------------------------------

@query
def union_findings(spark, sf):
    parts = [earlier_of(spark, sf), features_of(spark, sf)[1]]
    return resolve.union_findings(parts).select("session_id", "source_rank", "ord", "sub", "id", "type", "label")


@query
def dedupe_nodes(spark, sf):
    return resolve.dedupe_nodes(view(spark, sf, "nodes"), ORD)


@query
def node_id_map(spark, sf):
    return resolve.node_id_map(view(spark, sf, "nodes"), ORD)


def resolved(spark, sf):
    nodes = view(spark, sf, "nodes")
    id_map = resolve.node_id_map(nodes, ORD)
    return resolve.dedupe_nodes(nodes, ORD), resolve.remap_edges(view(spark, sf, "edges"), id_map, ORD)


@query
def remap_edges(spark, sf):
    return resolved(spark, sf)[1]


@query
def low_confidence(spark, sf):
    return resolve.low_confidence(resolved(spark, sf)[0])


def reviewed(spark, sf):
    nodes, edges = resolved(spark, sf)
    return resolve.apply_verdicts(nodes, edges, responses.parse_verdicts(view(spark, sf, "verdict_responses")))


@query
def apply_verdicts(spark, sf):
    return reviewed(spark, sf)[0]


@query
def apply_verdicts_edges(spark, sf):
    return reviewed(spark, sf)[1]


@query
def critic_summary(spark, sf):
    verdicts = responses.parse_verdicts(view(spark, sf, "verdict_responses"))
    return report.critic_summary(resolved(spark, sf)[0], verdicts)


# --- layout and reports -------------------------------------------------------------------

@query
def layout_columns(spark, sf):
    return layout.layout_columns(resolved(spark, sf)[0]).select("session_id", "id", "rank", "x", "y")


@query
def intra_column_edges(spark, sf):
    return layout.intra_column_edges(view(spark, sf, "edges"), view(spark, sf, "nodes"))


@query
def node_degree(spark, sf):
    return layout.node_degree(view(spark, sf, "nodes"), view(spark, sf, "edges"))


@query
def finding_counts(spark, sf):
    counts = report.finding_counts(view(spark, sf, "nodes"), view(spark, sf, "edges"))
    return counts.withColumn("kind", F.coalesce("kind", F.lit("(all)")))


@query
def entity_rows(spark, sf):
    return report.entity_rows(typed_nodes(spark, sf))


@query
def fact_rows(spark, sf):
    return report.fact_rows(typed_nodes(spark, sf))


@query
def drop_groups(spark, sf):
    """Facts left after the groups of failed sessions are deleted."""
    failed = ev.session_outcome(event_log(spark, sf)).filter("outcome = 'error'")
    return report.drop_groups(report.fact_rows(typed_nodes(spark, sf)), failed.select(F.col("session_id").alias("group_id")))


@query
def node_detail(spark, sf):
    return report.node_detail(typed_nodes(spark, sf))


@query
def node_subtitle(spark, sf):
    return report.node_subtitle(typed_nodes(spark, sf))


def facts(spark, sf):
    return fixtures.view(spark, sf, "facts", {"documents": "doc_id"})


@query
def write_snapshot(spark, sf):
    """Resolved graph written as a snapshot; session 3 written again empty, session 4 without edges; then read back."""
    nodes, edges = resolved(spark, sf)
    path = f"{Workspace(spark).base}/snapshot"
    sinks.write_snapshot(nodes, edges, path)
    again = nodes.select("session_id").filter("session_id IN (3, 4)").distinct()
    sinks.write_snapshot(nodes.filter("session_id = 4"), edges.filter("false"), path, again)
    nodes, edges = sinks.read_snapshot(spark, path)
    return nodes.select(F.lit("node").alias("what"), "session_id", "ord", "id", F.col("type").alias("detail")).unionByName(
        edges.select(F.lit("edge").alias("what"), "session_id", "ord", F.col("source").alias("id"),
                     F.col("target").alias("detail")))


# --- retrieval ------------------------------------------------------------------------------

@query
def search_facts(spark, sf):
    return search.search_facts(facts(spark, sf), view(spark, sf, "questions"))


@query
def query_context(spark, sf):
    return search.query_context(facts(spark, sf), view(spark, sf, "questions"))


def _fact_index(spark, sf) -> str:
    """The facts as an index, added in two batches."""
    path, whole = f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}", facts(spark, sf)
    half = F.pmod(F.xxhash64("uuid"), F.lit(2))
    for batch in (0, 1):
        factindex.add_facts(whole.filter(half == batch), path, batch)
    return path


@query
def search_index(spark, sf):
    return factindex.search_index(spark, _fact_index(spark, sf), view(spark, sf, "questions"))


@query
def index_context(spark, sf):
    return factindex.index_context(spark, _fact_index(spark, sf), view(spark, sf, "questions"))


@query
def vector_topk(spark, sf):
    """The ten most typical vectors of every label: its mean embedding is the question."""
    vectors = fixtures.spread(fixtures.table(spark, sf, "embeddings"), "vec_id").select(
        F.col("label").alias("group_id"), F.col("vec_id").alias("uuid"), "embedding"
    )
    asked = search.group_centroids(vectors).withColumn("question_id", F.col("group_id"))
    return search.vector_topk(vectors, asked)


@query
def vector_neighbours(spark, sf):
    """The ten nearest of all vectors to every vector whose id is divisible by 100, itself among them."""
    vectors = fixtures.spread(fixtures.table(spark, sf, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("uuid"), "embedding"
    )
    asked = vectors.filter(F.col("uuid") % 100 == 0).select(
        F.col("uuid").alias("question_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return search.vector_neighbours(vectors, asked)


@query
def canned_questions(spark, sf):
    return search.canned_questions(view(spark, sf, "nodes"), view(spark, sf, "edges"), about="ring")


# --- requests --------------------------------------------------------------------------------

@query
def valid_repo_url(spark, sf):
    r = view(spark, sf, "analyze_requests")
    return r.select("request_id", "repo_url", text.is_repo_url(F.col("repo_url")).alias("valid"))


@query
def admit_requests(spark, sf):
    sessions = view(spark, sf, "sessions")
    analyze_part = requests.admit_requests(view(spark, sf, "analyze_requests"), sessions, "analyze")
    query_part = requests.admit_requests(view(spark, sf, "query_requests"), sessions, "query")
    slim = ["request_id", or_empty("session_id"), "ok", "status", or_empty("reason")]
    return (
        analyze_part.select(F.lit("analyze").alias("kind"), *slim)
        .unionByName(query_part.select(F.lit("query").alias("kind"), *slim))
    )


# --- event log ---------------------------------------------------------------------------------

def _ts(name: str) -> Column:
    return F.coalesce(F.date_format(name, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(name)


@query
def events_by_kind(spark, sf):
    got = ev.events_by_kind(event_log(spark, sf))
    return got.select("session_id", "seq", "event", "valid", or_empty("subject"), or_empty("detail"))


@query
def fold_nodes(spark, sf):
    return ev.fold_nodes(event_log(spark, sf))


@query
def fold_edges(spark, sf):
    return ev.fold_edges(event_log(spark, sf))


@query
def agent_status(spark, sf):
    return ev.agent_status(event_log(spark, sf))


@query
def status_board(spark, sf):
    log = event_log(spark, sf)
    board = ev.status_board(ev.agent_status(log), view(spark, sf, "sessions"))
    return board.select("session_id", "place", "agent", "title", or_empty("status"), or_empty("message"))


@query
def session_snapshot(spark, sf):
    return ev.session_snapshot(event_log(spark, sf))


@query
def session_outcome(spark, sf):
    got = ev.session_outcome(event_log(spark, sf))
    return got.select("session_id", "outcome", or_empty("close_seq"), _ts("closed_at"), or_empty("message"))


@query
def ignored_events(spark, sf):
    return ev.ignored_events(event_log(spark, sf)).select("session_id", "seq", "event", "close_seq")


class _Replay:
    """A log that arrives in `parts` parts by time, and a row a month later that lets time run on.

    Every part is written in files of about the size that adaptive execution advises, and becomes one batch:
    no task writes or reads a part of the log.
    """

    def __init__(self, spark, log, parts: int) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        self.log = log.select("session_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "event", "data")
        self.cuts = self.log.agg(
            F.percentile_approx("ts", [i / parts for i in range(1, parts)]).alias("cuts"), F.max("ts").alias("end")).first()
        self.arrived = 0

    def _parts(self):
        edges = [None, *(self.cuts["cuts"] or []), None]
        for low, high in zip(edges, edges[1:]):
            after = F.lit(True) if low is None else F.coalesce(F.col("ts") > F.lit(low), F.lit(True))
            until = F.lit(True) if high is None else F.coalesce(F.col("ts") <= F.lit(high), F.lit(False))
            yield self.log.filter(after & until).hint("rebalance")
        end = F.lit(self.cuts["end"]).cast("timestamp") + F.expr("INTERVAL 30 DAYS")
        yield self.spark.range(1).select(
            F.lit(None).cast("bigint").alias("session_id"), F.lit(0).cast("bigint").alias("seq"), end.alias("ts"),
            F.lit("end of log").alias("event"), F.lit("{}").alias("data"))

    def through(self, *steps: Callable[[DataFrame], None]) -> None:
        """Let part after part arrive, and run each of `steps` on the stream until it has caught up."""
        for part in self._parts():
            part.write.mode("append").parquet(f"{self.folder}/log")
            for step in steps:
                step(self.spark.readStream.schema(EVENT_LOG).parquet(f"{self.folder}/log"))


def _run(stream, out: str, state: str) -> None:
    writer = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True)
    stateful.start(writer, stream.sparkSession, out).awaitTermination()


def _gated(spark, sf):
    """The event log through the stateful gate, in two batches and the one that lets time run on."""
    replay = _Replay(spark, view(spark, sf, "event_log"), 2)
    folder = replay.folder
    replay.through(lambda log: _run(stateful.gated(log, "1 hour", keep="60 days"), f"{folder}/accepted", f"{folder}/gate"))
    return spark.read.schema(EVENT_LOG).parquet(f"{folder}/accepted").filter("session_id IS NOT NULL"), folder


@query
def gated_events(spark, sf):
    accepted, _ = _gated(spark, sf)
    return accepted.select("session_id", "seq", "event")


@query
def streamed_nodes(spark, sf):
    accepted, folder = _gated(spark, sf)
    fold = lambda log: stateful.folded(log, "node:added", F.col("node_added.id"), "1 hour")
    _Replay(spark, accepted, 2).through(lambda log: _run(fold(log), f"{folder}/nodes", f"{folder}/fold"))
    changes = spark.read.schema("session_id bigint, id string, ord bigint, data string").parquet(f"{folder}/nodes")
    last = changes.groupBy("session_id", "id").agg(F.max_by("data", "ord").alias("data"), F.max("ord").alias("ord"))
    node = F.from_json("data", EVENT_PAYLOADS["node:added"])
    return last.select("session_id", "id", "ord", node["type"].alias("type"), node["data"]["label"].alias("label"),
                       node["data"]["confidence"].alias("confidence"))


@query
def patch_nodes(spark, sf):
    return ev.patch_nodes(event_log(spark, sf))


@query
def session_status(spark, sf):
    got = ev.session_status(event_log(spark, sf))
    return got.select("session_id", "status", _ts("created_at"), _ts("completed_at"), or_empty("error_message"))


@query
def event_windows(spark, sf):
    """Tumbling hours and half-hour-sliding hours."""
    log = event_log(spark, sf)
    both = (
        ev.event_windows(log, "1 hour").withColumn("window_kind", F.lit("tumbling"))
        .unionByName(ev.event_windows(log, "1 hour", "30 minutes").withColumn("window_kind", F.lit("sliding")))
    )
    return both.select("window_kind", _ts("window_start"), _ts("window_end"), "event", "n")


@query
def session_windows(spark, sf):
    got = ev.session_windows(event_log(spark, sf), 4 * 3600)
    return got.select("session_id", _ts("burst_start"), _ts("burst_end"), "n")


@query
def streamed_bursts(spark, sf):
    """Bursts out of a stream whose late rows were set aside; the log's last row lets time run on, so that all are closed."""
    replay = _Replay(spark, view(spark, sf, "event_log"), 2)
    folder = replay.folder
    replay.through(
        lambda log: live.split_late(log, f"{folder}/split", f"{folder}/split-state", "1 hour", available_now=True).awaitTermination(),
        lambda _: _run(live.burst_stream(live.in_time(spark, f"{folder}/split"), "4 hours", "1 hour"), f"{folder}/bursts", f"{folder}/bursts-state"),
    )
    found = spark.read.schema("session_id bigint, burst_start timestamp, burst_end timestamp, n bigint").parquet(f"{folder}/bursts")
    return found.filter("session_id IS NOT NULL").select("session_id", _ts("burst_start"), _ts("burst_end"), "n")


@query
def dedupe_events(spark, sf):
    log = view(spark, sf, "event_log").drop("ts")
    twice = log.unionByName(log.withColumn("seq", F.col("seq") + F.lit(1_000_000_000)))
    return ev.dedupe_events(twice, ["session_id", "event", "data"])


@query
def decode_frames(spark, sf):
    return frames.decode_frames(frames.frame_lines(view(spark, sf, "raw_frames"))).drop("sub")


@query
def reassemble_stream(spark, sf):
    texts = frames.decode_frames(frames.frame_lines(view(spark, sf, "raw_frames")))
    chunks = texts.select("stream_id", F.col("chunk").alias("ord"), F.col("pos").alias("sub"), F.col("sub").alias("piece"), "text")
    return frames.reassemble_stream(chunks, then=("piece",))


# --- everything together -----------------------------------------------------------------------

def _analysis(spark, sf):
    return analyze(
        fixtures.view(spark, sf, "source_files", {"documents": "doc_id"}),
        service_answers=view(spark, sf, "model_responses"),
        feature_answers=view(spark, sf, "feature_responses"),
    )


@query
def system_nodes(spark, sf):
    return _analysis(spark, sf).nodes.select("session_id", "id", "type", "label", "confidence", "agent_source", "x", "y")


@query
def system_edges(spark, sf):
    return _analysis(spark, sf).edges.select("session_id", "source", "target", "type", "label", "relationship_type")


@query
def system_related(spark, sf):
    """Entities linked with each other, as ranges of places, after resolution."""
    return _analysis(spark, sf).related


def _reviewed(spark, sf):
    """The analysis with every kind of recorded answer; the review removes the resolved nodes whose ids start with 0."""
    given = dict(
        service_answers=view(spark, sf, "model_responses"), feature_answers=view(spark, sf, "feature_responses"),
        endpoint_answers=view(spark, sf, "endpoint_responses"), entity_answers=view(spark, sf, "entity_responses"),
        external_answers=view(spark, sf, "external_responses"), plan_answers=view(spark, sf, "plan_responses"),
    )
    source = fixtures.view(spark, sf, "source_files", {"documents": "doc_id"})

    def review(resolved: DataFrame) -> DataFrame:
        removes = F.startswith("id", F.lit("0"))
        listed = F.concat(F.lit('["'), F.col("id"), F.lit('"]'))
        return resolved.select("session_id", "ord", F.concat(
            F.lit('{"keep": '), F.when(removes, "[]").otherwise(listed),
            F.lit(', "remove": '), F.when(removes, listed).otherwise("[]"), F.lit("}"),
        ).alias("text"))

    return analyze(source, verdict_answers=review, **given)


@query
def reviewed_nodes(spark, sf):
    return _reviewed(spark, sf).nodes.select("session_id", "id", "type", "label", "confidence", "agent_source", "x", "y")


@query
def reviewed_edges(spark, sf):
    return _reviewed(spark, sf).edges.select("session_id", "source", "target", "type", "label", "relationship_type")


@query
def reviewed_related(spark, sf):
    """As system_related, with answered entities and without those that the review removes."""
    return _reviewed(spark, sf).related
