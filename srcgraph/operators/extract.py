"""Regex extraction: file contents to finding rows, one scan for any set of rules.

Contents never reach a shuffle. Rules of every language family run in the scan
(each behind a cheap literal test); the few matches are then joined with the
repository's primary language, which decides which of them stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.joins import keyed_join
from srcgraph.functions.text import detect_language, language_family
from srcgraph.operators.files import CONFIG_PATH, contains_any, evidence, primary_language, with_language
from srcgraph.operators.rules import (
    ENV_RULES, IMPORT_RULES, MODEL_RULES, ROUTE_RULES, SDK_RULES, Rule, env_needle, sdk_package,
)
from srcgraph.functions.ranking import first_n


def _matches(rule: Rule) -> Column:
    """Array of the whole texts of all matches; empty without running the regex if no guard occurs."""
    content = F.col("content")
    if rule.value.startswith("="):
        found = F.when(content.rlike(rule.pattern), F.array(F.lit(rule.value[1:])))
    else:
        found = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(0))
    return F.when(contains_any(content, rule.guards), found)


def _value(rule: Rule) -> Column:
    """Finding from one match. Matching the short text again gives the same groups."""
    text = F.col("match")
    if rule.value.startswith("="):
        return text
    if rule.value == "upper1 2":
        return F.concat_ws(
            " ",
            F.upper(F.regexp_extract(text, rule.pattern, 1)),
            F.regexp_extract(text, rule.pattern, 2),
        )
    return F.regexp_extract(text, rule.pattern, 1)


def extract(files: DataFrame, rules: tuple[Rule, ...], language_mode: str = "repo") -> DataFrame:
    """`(repo_id, ord, path, kind, rule, rule_rank, match_pos, value)` for every match.

    `rule_rank` counts within a kind, so findings do not depend on what else is extracted.

    language_mode "repo" applies the rules of the repository's primary language to
    all its files; "file" goes by each file's own extension.
    """
    found = files.select("repo_id", "ord", "path", _found(rules))
    primary = None
    if language_mode == "repo" and any(rule.family for rule in rules):
        primary = primary_language(files).select("repo_id", "family")
    return matches_of(found, rules, primary)


def _found(rules: tuple[Rule, ...]) -> Column:
    """`found`: per rule with a match its number and the whole texts of its matches."""
    every = F.array(*[F.struct(F.lit(i).alias("rule_no"), _matches(rule).alias("hits")) for i, rule in enumerate(rules)])
    return F.filter(every, lambda f: F.size(f["hits"]) > 0).alias("found")


def scan(files: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Everything that is read out of contents, one row per file, in one scan; write it to a table.

    For `files.profile_from`, `matches_of` (with the same rules) and `hits_of`.
    """
    content, known = F.col("content"), F.col("language") != "unknown"
    marked = with_language(files).withColumns({
        "is_config": F.col("path").rlike(CONFIG_PATH), "__lower": F.lower(content),
    })
    return marked.select(
        "repo_id", "ord", "path", "language", "is_config", *evidence(), _found(rules),
        F.when(F.col("is_config") | known, _sdks()).alias("sdks"),
        F.when(F.col("is_config"), env_keys_of(content)).alias("keys"),
    )


def matches_of(found: DataFrame, rules: tuple[Rule, ...], primary: DataFrame | None) -> DataFrame:
    """What `extract` gives, from `(repo_id, ord, path, found)` and each repository's `(repo_id, family)`.

    Without `primary`, rules go by each file's own extension.
    """
    families = {i: rule.family for i, rule in enumerate(rules)}
    rows = (
        found.select("repo_id", "ord", "path", F.explode("found").alias("f"))
        .select("repo_id", "ord", "path", "f.rule_no", F.posexplode("f.hits").alias("match_pos", "match"))
    )
    ranks = [[r.kind for r in rules[:i]].count(rule.kind) for i, rule in enumerate(rules)]

    def by_rule(pick, values=rules) -> Column:
        expr = None
        for i, value in enumerate(values):
            case = F.col("rule_no") == i
            expr = F.when(case, pick(value)) if expr is None else expr.when(case, pick(value))
        return expr

    rows = rows.select(
        "repo_id", "ord", "path",
        by_rule(lambda r: F.lit(r.kind)).alias("kind"),
        by_rule(lambda r: F.lit(r.name)).alias("rule"),
        by_rule(lambda r: F.lit(r.family)).alias("rule_family"),
        by_rule(F.lit, ranks).alias("rule_rank"), "match_pos",
        by_rule(_value).alias("value"),
    )
    if any(families.values()):
        if primary is None:
            own = language_family(detect_language(F.col("path")))
            rows = rows.filter(F.col("rule_family").isNull() | (F.col("rule_family") == own))
        else:
            how = "inner" if all(families.values()) else "left"
            rows = keyed_join(rows, primary, ["repo_id"], how).filter(
                F.col("rule_family").isNull() | (F.col("rule_family") == F.col("family"))
            ).drop("family")
    return rows.drop("rule_family")


def extract_routes(files: DataFrame, language_mode: str = "repo") -> DataFrame:
    """HTTP routes as `METHOD path`, `METHOD` or `path`, whichever the rule yields."""
    return extract(files, ROUTE_RULES, language_mode).withColumnRenamed("value", "route")


def extract_models(files: DataFrame, language_mode: str = "repo") -> DataFrame:
    return extract(files, MODEL_RULES, language_mode).withColumnRenamed("value", "model")


def extract_imports(files: DataFrame, language_mode: str = "repo") -> DataFrame:
    """File to package edges; relative script imports are left out."""
    relative = (F.col("rule") == "es_import") & F.startswith(F.col("value"), F.lit("."))
    return extract(files, IMPORT_RULES, language_mode).filter(~relative).withColumnRenamed("value", "package")


def top_packages(imports: DataFrame, n: int) -> DataFrame:
    """The `n` most imported packages per repository, ties by name."""
    counts = imports.groupBy("repo_id", "package").agg(
        F.count("*").alias("n_imports"), F.count_distinct("ord").alias("n_files")
    )
    return first_n(counts, ["repo_id"], [F.desc("n_imports"), F.asc("package")], n)


def env_keys_of(content: Column) -> Column:
    """Distinct environment keys of one text, in order of first sight per rule."""
    parts = []
    for rule in ENV_RULES:
        keys = F.when(
            contains_any(content, rule.guards), F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(1))
        )
        parts.append(F.coalesce(keys, F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def extract_env_vars(files: DataFrame) -> DataFrame:
    """`(repo_id, ord, path, pos, env_key)`: each key once per file."""
    keys = files.select("repo_id", "ord", "path", env_keys_of(F.col("content")).alias("keys"))
    return keys.select("repo_id", "ord", "path", F.posexplode_outer("keys").alias("pos", "env_key")).filter(
        F.col("env_key").isNotNull()
    )


def _needles(pattern: str) -> list[str]:
    """Texts of an alternation, without those that contain another one."""
    words = pattern.split("|")
    return [w for w in words if not any(o != w and o in w for o in words)]


def _sdks() -> Column:
    """Numbers of the services found in `content`.

    Plain searches in the lower-cased text `__lower` go first; the case-blind regex, which
    alone decides, then runs only where one of them succeeds.
    """
    content = F.col("content")
    return F.filter(
        F.array(*[
            F.when(contains_any(F.col("__lower"), _needles(pattern)) & content.rlike(f"(?i){pattern}"), F.lit(i))
            for i, (_, _, pattern) in enumerate(SDK_RULES)
        ]),
        lambda x: x.isNotNull(),
    )


def _by_sdk(pick) -> Column:
    """A text per rule, looked up by the rule's number in `sdk`."""
    listed = ", ".join("'" + pick(*rule).replace("'", "''") + "'" for rule in SDK_RULES)
    return F.expr(f"element_at(array({listed}), sdk + 1)")


def sdk_hits(files: DataFrame) -> DataFrame:
    """Hits in config files and in known source files: `(repo_id, ord, sdk, is_config, keys)`.

    The one scan behind detect_sdks and sdk_env_keys; write it to a table to use both.
    """
    content = F.col("content")
    marked = with_language(files).withColumns({
        "is_config": F.col("path").rlike(CONFIG_PATH), "__lower": F.lower(content),
    })
    read = marked.filter(F.col("is_config") | (F.col("language") != "unknown"))
    return hits_of(read.select(
        "repo_id", "ord", "language", "is_config", _sdks().alias("sdks"),
        F.when(F.col("is_config"), env_keys_of(content)).alias("keys"),
    ))


def hits_of(read: DataFrame) -> DataFrame:
    """What `sdk_hits` gives, from `(repo_id, ord, language, is_config, sdks, keys)` per file."""
    # A known file named like a config file takes part in both roles.
    both = F.col("is_config") & (F.col("language") != "unknown")
    roles = F.when(both, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.col("is_config")))
    hits = read.select("repo_id", "ord", roles.alias("role"), "keys", F.explode("sdks").alias("sdk"))
    return hits.select("repo_id", "ord", "sdk", F.explode("role").alias("is_config"), "keys")


def _own_keys() -> Column:
    """Environment keys that belong to the service of this row."""
    needle = _by_sdk(lambda name, *_: env_needle(name))
    return F.filter(F.col("keys"), lambda k: F.contains(F.upper(k), needle))


def detect_sdks(files: DataFrame) -> DataFrame:
    """`(repo_id, name, category, sdk_package, in_config, rule_rank, ord, n_env_keys)`.

    A service seen in a config file takes its package from the rule and counts the
    environment keys of every config file that shows it; one seen only in source
    files is named after itself and has no keys. `ord` is the first file that counts.
    """
    return sdks_from_hits(sdk_hits(files))


def sdks_from_hits(hits: DataFrame) -> DataFrame:
    n_keys = F.when(F.col("is_config"), F.size(_own_keys())).otherwise(0)
    found = (
        hits.withColumn("n_keys", n_keys)
        .groupBy("repo_id", "sdk")
        .agg(
            F.bool_or("is_config").alias("in_config"),
            F.min(F.when(F.col("is_config"), F.col("ord"))).alias("config_ord"),
            F.min("ord").alias("any_ord"),
            F.sum("n_keys").alias("n_env_keys"),
        )
    )
    package = F.when(F.col("in_config"), _by_sdk(lambda n, c, p: sdk_package(p))).otherwise(
        _by_sdk(lambda n, c, p: n.lower())
    )
    return found.select(
        "repo_id",
        _by_sdk(lambda n, c, p: n).alias("name"),
        _by_sdk(lambda n, c, p: c).alias("category"),
        package.alias("sdk_package"),
        "in_config",
        F.col("sdk").alias("rule_rank"),
        F.coalesce("config_ord", "any_ord").alias("ord"),
        "n_env_keys",
    )


def sdk_env_keys(files: DataFrame) -> DataFrame:
    """`(repo_id, name, ord, pos, env_key)`: keys of each service, file by file, repeats kept."""
    return env_keys_from_hits(sdk_hits(files))


def env_keys_from_hits(hits: DataFrame) -> DataFrame:
    return (
        hits.filter("is_config")
        .select("repo_id", "ord", _by_sdk(lambda n, c, p: n).alias("name"),
                F.posexplode_outer(_own_keys()).alias("pos", "env_key"))
        .filter(F.col("env_key").isNotNull())
        .select("repo_id", "name", "ord", "pos", "env_key")
    )
