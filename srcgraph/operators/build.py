"""Nodes and edges from findings.

Findings carry `(session_id, ord, sub)`: the file's place and the place inside it.
The source rank fixes the order between kinds of findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.joins import keyed_join
from srcgraph.functions.ranking import position, running_total
from srcgraph.functions.text import content_id, label_key
from srcgraph.operators.rules import INFRA_CATEGORIES
from srcgraph.schemas import METADATA, METADATA_VARIANTS
from srcgraph.session import cut

# Order of the finding sources, and confidence by source.
SOURCE_RANK = {"planner": 0, "api": 1, "data": 2, "service": 3, "infra": 4, "features": 5}
CONFIDENCE = {"planner": 1.0, "api": 0.85, "data": 0.9, "service": 0.8, "infra": 0.85, "features": 0.8}

# Added to `ord` where a later pass must sort behind a whole earlier one.
LATER = 1 << 58


def _list_place(outer: Column, inner: Column) -> Column:
    """One bigint that sorts by `outer`, then by a position in a list."""
    return outer.cast("bigint") * F.lit(1 << 31) + inner


def metadata(variant: str, **fields: Column) -> Column:
    """Metadata struct with one variant filled and the others null."""
    tag, ddl = METADATA_VARIANTS[variant]
    filled = F.struct(*[col.alias(name) for name, col in fields.items()]).cast(ddl)
    parts = [F.lit(tag).alias("type")]
    for name, (_, other) in METADATA_VARIANTS.items():
        parts.append((filled if name == variant else F.lit(None).cast(other)).alias(name))
    return F.struct(*parts).cast(METADATA)


def _node(df: DataFrame, agent: str, type_: Column, label: Column, meta: Column,
          confidence: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    file_path = F.col("file_path") if "file_path" in df.columns else F.lit("")
    return df.select(
        F.col("session_id"),
        F.lit(SOURCE_RANK[agent]).alias("source_rank"),
        F.col("ord").cast("bigint").alias("ord"),
        F.col("sub").cast("bigint").alias("sub"),
        content_id(F.col("session_id"), F.lit(agent), type_, file_path, F.col("ord"), F.col("sub"), label).alias("id"),
        type_.alias("type"),
        label.alias("label"),
        (confidence if confidence is not None else F.lit(CONFIDENCE[agent])).cast("double").alias("confidence"),
        F.lit(agent).alias("agent_source"),
        meta.alias("metadata"),
        *keep,
    )


def _edge(df: DataFrame, agent: str, source: Column, target: Column, type_: str, relationship: str,
          label: str | None = None, animated: bool = False, direction: str = "unidirectional") -> DataFrame:
    return df.select(
        F.col("session_id"),
        F.lit(SOURCE_RANK[agent]).alias("source_rank"),
        F.col("ord").cast("bigint").alias("ord"),
        F.col("sub").cast("bigint").alias("sub"),
        content_id(F.col("session_id"), source, target, F.lit(relationship), F.col("ord"), F.col("sub")).alias("id"),
        source.alias("source"),
        target.alias("target"),
        F.lit(type_).alias("type"),
        F.lit(label or relationship).alias("label"),
        F.lit(animated).alias("animated"),
        F.lit(relationship).alias("relationship_type"),
        F.lit(direction).alias("direction"),
    )


def main_nodes(profile: DataFrame, entry_points: DataFrame | None = None) -> DataFrame:
    """The service node that stands for a whole repository.

    profile       (session_id, framework, primary_language, root)
    entry_points  optional (session_id, pos, path); the first one becomes the file path
    """
    df = profile
    if entry_points is not None:
        first = entry_points.groupBy("session_id").agg(F.min_by("path", "pos").alias("entry"))
        df = df.join(first, "session_id", "left")
    else:
        df = df.withColumn("entry", F.lit(None).cast("string"))
    label = F.when(F.col("framework") != "unknown", F.col("framework")).otherwise("Application")
    df = df.withColumn("ord", F.lit(0)).withColumn("sub", F.lit(0)).withColumn(
        "file_path", F.coalesce("entry", "root")
    )
    meta = metadata(
        "service", name=label, language=F.coalesce("primary_language", F.lit("unknown")),
        framework=F.col("framework"), file_path=F.col("file_path"),
    )
    return _node(df, "planner", F.lit("service"), label, meta)


def _from_main(nodes: DataFrame, main: DataFrame, agent: str, **edge) -> DataFrame:
    """Edges from each session's main node to `nodes`."""
    hub = main.select("session_id", F.col("id").alias("main_id"))
    slim = nodes.select("session_id", "ord", "sub", "id")
    return _edge(keyed_join(slim, hub, ["session_id"]), agent, F.col("main_id"), F.col("id"), **edge)


# --- endpoints -----------------------------------------------------------------

def endpoints_from_routes(routes: DataFrame) -> DataFrame:
    """Endpoint findings from extracted routes, without asking a model."""
    by_rule = F.col("rule")
    method = F.when(by_rule == "handle_func", F.lit(None)).otherwise(F.substring_index("route", " ", 1))
    path = F.when(by_rule == "handler_export", F.lit(None)).when(by_rule == "handle_func", F.col("route")).otherwise(
        F.substring(F.col("route"), F.length(method) + 2, F.length("route"))
    )
    return _number(routes).select(
        F.col("repo_id").alias("session_id"), "ord", "sub", F.col("path").alias("file_path"),
        method.alias("method"), path.alias("url_path"),
        F.lit(None).cast("string").alias("handler_name"),
        F.lit(None).cast("boolean").alias("auth_required"),
        F.array().cast("array<string>").alias("middlewares"),
    )


def _number(findings: DataFrame) -> DataFrame:
    """`sub` from rule rank and match position: unique within a file, in pattern order."""
    return findings.withColumn("sub", _list_place(F.col("rule_rank"), F.col("match_pos")))


def endpoints_from_answers(records: DataFrame) -> DataFrame:
    """Endpoint findings from parsed answers `(session_id, ord, file_path, sub, …)`."""
    return records.select(
        "session_id", "ord", "sub", "file_path", "method", F.col("path").alias("url_path"),
        F.col("handlerName").alias("handler_name"),
        F.expr("try_cast(authRequired AS boolean)").alias("auth_required"),
        F.coalesce("middlewares", F.array().cast("array<string>")).alias("middlewares"),
    )


def endpoint_nodes(endpoints: DataFrame) -> DataFrame:
    label = F.concat_ws(" ", "method", "url_path")
    meta = metadata(
        "api", method=F.col("method"), path=F.col("url_path"), handler_name=F.col("handler_name"),
        auth_required=F.col("auth_required"), middlewares=F.col("middlewares"),
        file_path=F.col("file_path"), line_number=F.lit(0),
    )
    return _node(endpoints, "api", F.lit("api"), label, meta)


def endpoint_edges(nodes: DataFrame, main: DataFrame) -> DataFrame:
    return _from_main(nodes, main, "api", type_="dependency", relationship="HANDLES")


# --- database entities -----------------------------------------------------------

def entities_from_models(models: DataFrame) -> DataFrame:
    """Entity findings from extracted models; the rule names the mapper."""
    return _number(models).select(
        F.col("repo_id").alias("session_id"), "ord", "sub", F.col("path").alias("file_path"),
        F.col("model").alias("name"),
        F.when(F.col("rule") == "mongoose", "mongodb").otherwise("unknown").alias("db_type"),
        F.col("rule").alias("orm"),
        F.array().cast("array<struct<name:string,type:string,nullable:boolean>>").alias("fields"),
    )


def entities_from_answers(records: DataFrame) -> DataFrame:
    fields = F.transform(
        F.coalesce("fields", F.array().cast("array<struct<name:string,type:string,nullable:string>>")),
        lambda f: F.struct(
            f["name"].alias("name"), f["type"].alias("type"), (F.lower(f["nullable"]) == "true").alias("nullable")
        ),
    )
    return records.select(
        "session_id", "ord", "sub", "file_path", "name",
        F.col("dbType").alias("db_type"), "orm", fields.alias("fields"),
    )


def entity_nodes(entities: DataFrame) -> DataFrame:
    meta = metadata(
        "database", name=F.col("name"), db_type=F.col("db_type"), orm=F.col("orm"),
        fields=F.col("fields"), file_path=F.col("file_path"),
    )
    return _node(entities, "data", F.lit("database"), F.col("name"), meta)


def relates_to(entities: DataFrame) -> DataFrame:
    """RELATES_TO in closed form: each entity relates to all later ones of its session.

    One row per entity instead of one per pair: its position, and the positions of
    its targets as a range. The pairs are exactly those ranges read out; their number
    is `sum(n_targets)`. Writing them out would be quadratic in the session.
    """
    placed = position(
        entities.select("session_id", "ord", "sub", "id"), ["session_id"], "ord", "place", then=("sub",)
    )
    totals = entities.groupBy("session_id").agg(F.count("*").alias("last_target"))
    return keyed_join(placed, totals, ["session_id"]).select(
        "session_id", F.col("id").alias("source"), F.col("place").alias("source_place"),
        (F.col("place") + 1).alias("first_target"), "last_target",
        (F.col("last_target") - F.col("place")).alias("n_targets"),
    )


#: Places of one bucket when ranges of targets are read back.
TARGET_BUCKET = 1024
PAIRS_A_TASK = 1 << 20


def related_targets(related: DataFrame, chosen: DataFrame) -> DataFrame:
    """The targets of some entities, out of the ranges that `relates_to` keeps: (session_id, source, target, target_place).

    related  what `relates_to` gives, written: it is read once for the ranges and once for the targets
    chosen   (session_id, source): whose targets are wanted, each pair once however often it is given

    A range is met as buckets of 1,024 places: a chosen entity is sent once per bucket of its range, a target once,
    and a bucket's whole range is dealt out by places, so that no task holds a session. Rows grow with the pairs asked
    for, not with those of the session. Entities that are unknown, or the last of their session, have no rows.

    Both sides are small beside their pairs, so adaptive execution, which goes by bytes read, would put all pairs into a
    few tasks: the number of tasks follows the pairs, and a session's chosen entities are dealt in slices, of
    which one meets a bucket in at most about an eighth of the `PAIRS_A_TASK` pairs of a task.
    """
    keys = ["session_id", "source"]
    wanted = cut(related.filter("n_targets > 0").join(chosen.select(*keys).distinct(), keys))
    per_session = wanted.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("n_targets").alias("pairs"))
    held = per_session.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).first()
    slices = 8 * held["most"] * TARGET_BUCKET // PAIRS_A_TASK + 1
    tasks = max(related.sparkSession.sparkContext.defaultParallelism, held["pairs"] // PAIRS_A_TASK + 1)
    on = ["session_id", "bucket", "slice"]
    ranges = wanted.select(
        *keys, "first_target", "last_target", F.pmod(F.xxhash64("source"), F.lit(slices)).alias("slice"),
        F.explode(F.sequence(
            F.expr(f"first_target div {TARGET_BUCKET}"), F.expr(f"last_target div {TARGET_BUCKET}")
        )).alias("bucket"),
    )
    targets = related.select(
        "session_id", F.col("source").alias("target"), F.col("source_place").alias("target_place"),
        F.expr(f"source_place div {TARGET_BUCKET}").alias("bucket"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))).alias("slice"),
    )
    return (
        ranges.repartition(tasks, *on).join(targets.repartition(tasks, *on).hint("merge"), on)
        .filter("target_place between first_target and last_target")
        .select(*keys, "target", "target_place")
    )


def relates_to_raw_count(files: DataFrame, entities: DataFrame) -> DataFrame:
    """How many RELATES_TO edges are sent when all pairs so far are sent again after every file.

    files  (session_id, ord): the files that passed the gate, with or without entities
    """
    per_file = (
        files.select("session_id", "ord", F.lit(0).alias("n"))
        .unionByName(entities.select("session_id", "ord", F.lit(1).alias("n")))
        .groupBy("session_id", "ord").agg(F.sum("n").alias("n"))
    )
    so_far = running_total(per_file, ["session_id"], "ord", F.col("n"), "seen")
    pairs = F.expr("seen * (seen - 1) div 2")
    return so_far.groupBy("session_id").agg(
        F.max("seen").alias("n_entities"),
        F.max(pairs).alias("distinct_pairs"),
        F.sum(pairs).alias("raw_pairs"),
    )


def relates_to_resolved(entities: DataFrame, id_map: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """RELATES_TO between survivors, in closed form; `removed` ids take no part.

    Survivor A points at survivor B when some entity of A stands before some entity
    of B: first place of A < last place of B. Each row gives A's first and last
    place and the number of other survivors it points at.
    """
    placed = position(
        entities.select("session_id", "ord", "sub", "id"), ["session_id"], "ord", "place", then=("sub",)
    )
    survivors = (
        placed.join(id_map.select("session_id", "id", "survivor_id"), ["session_id", "id"])
        .groupBy("session_id", "survivor_id")
        .agg(F.min("place").alias("first_place"), F.max("place").alias("last_place"))
    )
    if removed is not None:
        survivors = survivors.join(
            removed.select("session_id", F.col("id").alias("survivor_id")), ["session_id", "survivor_id"], "left_anti"
        )
    # Count the last places beyond each first place along one line of both kinds of points.
    line = survivors.select("session_id", "survivor_id", F.col("last_place").alias("at"), F.lit(1).alias("is_last")) \
        .unionByName(
            survivors.select("session_id", "survivor_id", F.col("first_place").alias("at"), F.lit(0).alias("is_last"))
        )
    counted = running_total(line, ["session_id"], "at", F.col("is_last"), "lasts", then=("is_last",))
    totals = survivors.groupBy("session_id").agg(F.count("*").alias("n_survivors"))
    before = counted.filter("is_last = 0").select("session_id", "survivor_id", "lasts")
    return (
        keyed_join(survivors.join(before, ["session_id", "survivor_id"]), totals, ["session_id"])
        .select(
            "session_id", F.col("survivor_id").alias("source"), "first_place", "last_place",
            (F.col("n_survivors") - F.col("lasts") - 1).alias("n_targets"),
        )
    )


# --- services ----------------------------------------------------------------------

def service_nodes(services: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """services (session_id, ord, sub, name, filePath, dependsOn); profile gives language and framework."""
    df = services.withColumn("file_path", F.col("filePath"))
    if profile is not None:
        known = profile.select("session_id", "framework", "primary_language")
        df = keyed_join(df, known, ["session_id"], "left")
    else:
        df = df.withColumn("framework", F.lit(None).cast("string")).withColumn(
            "primary_language", F.lit(None).cast("string")
        )
    unknown = F.lit("unknown")
    meta = metadata(
        "service", name=F.col("name"), language=F.coalesce("primary_language", unknown),
        framework=F.coalesce("framework", unknown), file_path=F.col("file_path"),
    )
    return _node(df, "service", F.lit("service"), F.col("name"), meta)


def service_edges(nodes: DataFrame, main: DataFrame) -> DataFrame:
    return _from_main(nodes, main, "service", type_="dependency", relationship="DEPENDS_ON")


def service_deps(services: DataFrame, nodes: DataFrame) -> DataFrame:
    """Service to service by exact name. A repeated name stands for its last node, at both ends."""
    place = F.struct("ord", "sub")
    by_name = (
        nodes.select("session_id", F.col("label").alias("name"), "id", "ord", "sub")
        .groupBy("session_id", "name").agg(F.max_by("id", place).alias("id"))
    )
    wanted = services.select(
        "session_id", "ord", "sub", "name", F.posexplode_outer("dependsOn").alias("dep_pos", "dep")
    ).filter(F.col("dep").isNotNull())
    sources = by_name.withColumnRenamed("id", "source_id")
    targets = by_name.select("session_id", F.col("name").alias("dep"), F.col("id").alias("target_id"))
    named = keyed_join(wanted, sources, ["session_id", "name"])
    linked = keyed_join(named, targets, ["session_id", "dep"]).filter(F.col("source_id") != F.col("target_id"))
    # Later than every main-to-service edge; the record's place and the list's order decide among themselves.
    numbered = linked.withColumn("ord", F.col("ord") + F.lit(LATER)).withColumn(
        "sub", _list_place(F.col("sub"), F.col("dep_pos"))
    )
    return _edge(numbered, "service", F.col("source_id"), F.col("target_id"),
                 type_="dependency", relationship="DEPENDS_ON")


# --- external services -----------------------------------------------------------

def external_type(category: Column) -> Column:
    return F.when(category.isin(*INFRA_CATEGORIES), "infra").otherwise("external")


def externals_from_sdks(sdks: DataFrame, env_keys: DataFrame | None = None) -> DataFrame:
    """External findings from detected services, config evidence first.

    A node lists each environment key of its service once, in order of first sight;
    `sdk_env_keys` holds every occurrence.
    """
    df = sdks.select(
        F.col("repo_id").alias("session_id"), "name", "category", "sdk_package",
        ((~F.col("in_config")).cast("bigint") * F.lit(LATER) + F.col("ord")).alias("ord"),
        F.col("rule_rank").alias("sub"),
    )
    if env_keys is None:
        return df.withColumn("env_keys", F.array().cast("array<string>"))
    first = env_keys.groupBy("repo_id", "name", "env_key").agg(F.min(F.struct("ord", "pos")).alias("at"))
    # One entry per distinct name: repeats, however many, are gone before this.
    lists = first.groupBy(F.col("repo_id").alias("session_id"), "name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", "env_key"))), lambda k: k["env_key"]
        ).alias("env_keys")
    )
    return df.join(lists, ["session_id", "name"], "left").withColumn(
        "env_keys", F.coalesce("env_keys", F.array().cast("array<string>"))
    )


def externals_from_answers(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """External findings from parsed answers, each name once, names already known left out."""
    place = F.struct("ord", "sub")
    first = records.groupBy("session_id", "name").agg(
        F.min_by(
            F.struct("category", "envKeys", "sdkPackage", "ord", "sub"), place
        ).alias("r")
    )
    df = first.select(
        "session_id", "name", F.col("r.category").alias("category"), F.col("r.sdkPackage").alias("sdk_package"),
        F.col("r.ord").alias("ord"), F.col("r.sub").alias("sub"),
        F.coalesce("r.envKeys", F.array().cast("array<string>")).alias("env_keys"),
    )
    if known is not None:
        df = df.join(known.select("session_id", "name"), ["session_id", "name"], "left_anti")
    return df


def external_nodes(externals: DataFrame) -> DataFrame:
    meta = metadata(
        "external", name=F.col("name"), category=F.col("category"), env_keys=F.col("env_keys"),
        sdk_package=F.col("sdk_package"),
    )
    return _node(externals, "infra", external_type(F.col("category")), F.col("name"), meta)


def external_edges(nodes: DataFrame, main: DataFrame) -> DataFrame:
    return _from_main(nodes, main, "infra", type_="dataFlow", relationship="CONNECTS_TO", animated=True)


# --- features --------------------------------------------------------------------

def dedupe_features(records: DataFrame) -> DataFrame:
    """Named features once per label key; the first pass wins over the router pass, earlier over later.

    records (session_id, pass, ord, sub, file_path, name, route, usesAuth, usesServices, confidence)
    """
    fields = ("name", "route", "file_path", "usesAuth", "usesServices", "confidence", "pass", "ord", "sub")
    named = records.filter(F.coalesce(F.col("name"), F.lit("")) != "").withColumn("key", label_key(F.col("name")))
    first = named.groupBy("session_id", "key").agg(
        F.min_by(F.struct(*fields), F.struct("pass", "ord", "sub")).alias("f")
    )
    return first.select("session_id", "f.*")


def feature_nodes(features: DataFrame) -> DataFrame:
    """features: the output of dedupe_features."""
    confidence = F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(CONFIDENCE["features"]))
    uses_auth = F.coalesce(F.expr("try_cast(usesAuth AS boolean)"), F.lit(False))
    df = _feature_order(features)
    meta = metadata(
        "feature", name=F.col("name"), route=F.col("route"), file_path=F.col("file_path"), uses_auth=uses_auth
    )
    return _node(df, "features", F.lit("feature"), F.col("name"), meta, confidence)


def _feature_order(features: DataFrame) -> DataFrame:
    return features.withColumn("ord", F.col("pass").cast("bigint") * F.lit(LATER) + F.col("ord"))


def feature_uses(features: DataFrame, nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """Feature to node by label key; a label carried by several nodes stands for the last one.

    existing  nodes of all earlier sources, in their order (source_rank, ord, sub)
    """
    place = F.struct("source_rank", "ord", "sub")
    by_label = (
        existing.select("session_id", label_key(F.col("label")).alias("key"), "id", "source_rank", "ord", "sub")
        .groupBy("session_id", "key").agg(F.max_by("id", place).alias("target_id"))
    )
    own = nodes.select("session_id", "ord", "sub", "id")
    wanted = (
        _feature_order(features)
        .select("session_id", "ord", "sub", F.posexplode_outer("usesServices").alias("use_pos", "use"))
        .filter(F.col("use").isNotNull())
        .withColumn("key", label_key(F.col("use")))
    )
    linked = keyed_join(wanted, by_label, ["session_id", "key"]).join(own, ["session_id", "ord", "sub"])
    numbered = linked.withColumn("sub", _list_place(F.col("sub"), F.col("use_pos")))
    return _edge(numbered, "features", F.col("id"), F.col("target_id"),
                 type_="dependency", relationship="DEPENDS_ON", label="USES")
