"""Presentation tables: entity and fact rows, node details and subtitles, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.joins import keyed_join
from srcgraph.functions.text import confidence_percent, short_path
from srcgraph.operators.resolve import removed_ids

FIELD_PREVIEW = 8


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def _joined(parts: list) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else _text(p) for p in parts])


def entity_rows(nodes: DataFrame) -> DataFrame:
    """Rows for the facts service's entity table, grouped by session."""
    return nodes.select(
        F.col("id").alias("uuid"),
        F.col("session_id").alias("group_id"),
        F.col("label").alias("name"),
        _joined([F.col("type"), ": ", F.col("label"), " (", F.col("agent_source"), ")"]).alias("summary"),
    )


def fact_text() -> Column:
    """One sentence per node, by metadata kind."""
    # The wording of the five sentences.
    m = "metadata."
    field_names = F.array_join(F.transform(F.col(m + "database.fields"), lambda f: f["name"]), ", ")
    route = F.col(m + "feature.route")
    at_route = F.when(F.coalesce(route, F.lit("")) != "", F.concat(F.lit(" at route "), route)).otherwise("")
    return (
        F.when(F.col(m + "type") == "ApiEndpoint", _joined([
            "API endpoint: ", F.col(m + "api.method"), " ", F.col(m + "api.path"),
            " — handler: ", F.col(m + "api.handler_name"),
            ", auth required: ", F.col(m + "api.auth_required"), ", file: ", F.col(m + "api.file_path"),
        ]))
        .when(F.col(m + "type") == "DatabaseEntity", _joined([
            "Database model: ", F.col(m + "database.name"), " (", F.col(m + "database.orm"), ", ",
            F.col(m + "database.db_type"), ") with fields: ", field_names, " — file: ",
            F.col(m + "database.file_path"),
        ]))
        .when(F.col(m + "type") == "Service", _joined([
            "Service: ", F.col(m + "service.name"), " (", F.col(m + "service.language"), ", ",
            F.col(m + "service.framework"), ") — entry: ", F.col(m + "service.file_path"),
        ]))
        .when(F.col(m + "type") == "ExternalDependency", _joined([
            "External dependency: ", F.col(m + "external.name"), " (", F.col(m + "external.category"),
            "), package: ", F.col(m + "external.sdk_package"), ", env keys: ",
            F.array_join(F.col(m + "external.env_keys"), ", "),
        ]))
        .when(F.col(m + "type") == "Feature", _joined([
            "Feature: ", F.col(m + "feature.name"), at_route, " — file: ", F.col(m + "feature.file_path"),
            ", auth: ", F.col(m + "feature.uses_auth"),
        ]))
    )


def fact_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.col("session_id").alias("group_id"), F.col("id").alias("uuid"), F.col("label").alias("name"),
        fact_text().alias("fact"),
    )


def drop_groups(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Facts of all groups but the listed ones."""
    return keyed_join(facts, groups.select("group_id").distinct(), ["group_id"], "left_anti")


def node_detail(nodes: DataFrame) -> DataFrame:
    """`(session_id, id, pos, field, value)`: what the detail panel shows, absent rows left out."""
    m = "metadata."
    tag = F.col(m + "type")
    api, db = tag == "ApiEndpoint", tag == "DatabaseEntity"
    svc, ext = tag == "Service", tag == "ExternalDependency"

    def row(field: str, cond: Column | None, value: Column) -> Column:
        value = _text(value)
        return F.struct(
            F.lit(field).alias("field"), (value if cond is None else F.when(cond, value)).alias("value")
        )

    fields = F.col(m + "database.fields")
    shown = F.array_join(
        F.transform(F.slice(fields, 1, FIELD_PREVIEW), lambda f: F.concat_ws(" ", f["name"], f["type"])), ", "
    )
    more = F.size(fields) - FIELD_PREVIEW
    preview = F.concat(
        shown, F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise("")
    )
    middlewares, env_keys = F.col(m + "api.middlewares"), F.col(m + "external.env_keys")
    # The titles and the order of the rows.
    rows = F.array(
        row("Type", None, F.col("type")),
        row("Source", None, F.col("agent_source")),
        row("Confidence", None, confidence_percent(F.col("confidence"))),
        row("Method", api, F.col(m + "api.method")),
        row("Path", api, F.col(m + "api.path")),
        row("Handler", api, F.col(m + "api.handler_name")),
        row("Auth", api, F.when(F.col(m + "api.auth_required"), "Required").otherwise("None")),
        row("Middleware", api & (F.size(middlewares) > 0), F.array_join(middlewares, ", ")),
        row("File", api, short_path(F.col(m + "api.file_path"))),
        row("ORM", db, F.col(m + "database.orm")),
        row("DB", db, F.col(m + "database.db_type")),
        row("File", db, short_path(F.col(m + "database.file_path"))),
        row("Fields", db & (F.size(fields) > 0), preview),
        row("Language", svc, F.col(m + "service.language")),
        row("Framework", svc, F.col(m + "service.framework")),
        row("File", svc, short_path(F.col(m + "service.file_path"))),
        row("Category", ext, F.col(m + "external.category")),
        row("Package", ext, F.col(m + "external.sdk_package")),
        row("Env vars", ext & (F.size(env_keys) > 0), F.array_join(env_keys, ", ")),
    )
    return (
        nodes.select("session_id", "id", F.posexplode(rows).alias("pos", "r"))
        .filter(F.col("r.value").isNotNull())
        .select("session_id", "id", "pos", "r.field", "r.value")
    )


def node_subtitle(nodes: DataFrame) -> DataFrame:
    """Second line of a node's card, and whether it carries the auth mark."""
    m = "metadata."
    tag = F.col(m + "type")

    def known(col: Column) -> Column:
        return F.when(col != "unknown", col)

    subtitle = (
        F.when(tag == "Service", F.concat_ws(
            " · ", known(F.col(m + "service.language")), known(F.col(m + "service.framework"))))
        .when(tag == "DatabaseEntity", F.concat_ws(" · ", m + "database.orm", m + "database.db_type"))
        .when(tag == "ExternalDependency", F.col(m + "external.category"))
        .when(tag == "Feature", F.col(m + "feature.route"))
        .when(tag == "ApiEndpoint", F.concat_ws(" ", m + "api.method", m + "api.path"))
    )
    auth = F.coalesce(F.col(m + "api.auth_required"), F.col(m + "feature.uses_auth"), F.lit(False))
    return nodes.select(
        "session_id", "id", F.coalesce(subtitle, F.lit("")).alias("subtitle"), auth.alias("auth_mark")
    )


def finding_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`(session_id, what, kind, n)`: nodes per type, edges per relationship, and totals (kind null).

    Totals come from the per-kind counts, not from a second pass over the rows.
    """
    per_kind = (
        nodes.select("session_id", F.lit("node").alias("what"), F.col("type").alias("kind"))
        .unionByName(
            edges.select("session_id", F.lit("edge").alias("what"), F.col("relationship_type").alias("kind"))
        )
        .groupBy("session_id", "what", "kind").agg(F.count("*").alias("n"))
    )
    totals = per_kind.groupBy("session_id", "what").agg(F.sum("n").alias("n")).select(
        "session_id", "what", F.lit(None).cast("string").alias("kind"), "n"
    )
    return per_kind.unionByName(totals)


def critic_summary(nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Nodes left and distinct ids removed per session, with the closing message."""
    removed = removed_ids(verdicts)
    n_removed = verdicts.groupBy("session_id").agg(
        F.count_distinct(F.when(F.col("decision") == "remove", F.col("node_id"))).alias("n_removed")
    )
    kept = nodes.select("session_id", "id").join(removed, ["session_id", "id"], "left_anti")
    counts = kept.groupBy("session_id").agg(F.count("*").alias("n_verified")).join(
        n_removed, "session_id", "full_outer"
    )
    verified = F.coalesce("n_verified", F.lit(0).cast("bigint"))
    removed_n = F.coalesce("n_removed", F.lit(0).cast("bigint"))
    # The wording of the message.
    message = F.concat(
        F.lit("Verified "), verified.cast("string"), F.lit(" nodes"),
        F.when(F.col("n_removed").isNotNull(), F.concat(
            F.lit(", removed "), removed_n.cast("string"), F.lit(" low-confidence findings"))).otherwise(""),
    )
    return counts.select(
        "session_id", verified.alias("n_verified"), removed_n.alias("n_removed"), message.alias("message")
    )
