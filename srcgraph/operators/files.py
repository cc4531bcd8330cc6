"""File tables: which files count, what they are, what each repository is made of.

Input everywhere: `(repo_id, ord, path, content)`, `ord` unique per repository.
Steps that only need paths never read `content`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.text import LANGUAGE_FAMILY, detect_language, language_family, strip_root

# Path and content marks of file roles.
MODEL_PATH = r"(?i)model|schema|entity|migration"
CONFIG_PATH = r"(?i)package\.json|requirements\.txt|go\.mod|docker-compose|\.env\.example|Dockerfile"
FEATURE_PATHS = (
    r"Page\.(tsx|jsx|ts|js)$",
    r"Screen\.(tsx|jsx|ts|js)$",
    r"View\.(tsx|jsx|ts|js)$",
    r"Dashboard\.(tsx|jsx|ts|js)$",
    r"/pages/[^/]+\.(tsx|jsx|ts|js)$",
    r"/app/[^/]*page\.(tsx|jsx|ts|js)$",
)
ROUTE_PATHS = (
    r"router\.(tsx|jsx|ts|js)$",
    r"routes\.(tsx|jsx|ts|js)$",
    r"App\.(tsx|jsx|ts|js)$",
    r"index\.(tsx|jsx)$",
    r"layout\.(tsx|jsx)$",
)
ROUTER_CONFIG_PATH = r"App\.(tsx|jsx)$|router\.(tsx|jsx|ts|js)$|routes\.(tsx|jsx|ts|js)$"
SCREEN_MARKS = (
    "<Route",
    "createBrowserRouter",
    "createHashRouter",
    "useRoutes(",
    "from 'react-router",
    'from "react-router',
    "/pages/",
    "export default function",
    "export default page",
    "generateStaticParams",
)
ROUTER_MARKS = ("<Route", "createBrowserRouter", "useRoutes")
MIN_SCREEN_CHARS = 50

# Framework evidence, strongest first: (framework, where, text).
FRAMEWORK_EVIDENCE = (
    ("express+prisma", "path", ("prisma/schema.prisma",)),
    ("fastapi", "content", ("from 'fastapi'", "from fastapi")),
    ("nextjs", "content", ("from 'next'",)),
    ("nextjs", "path", ("next.config",)),
    ("express", "content", ("express()",)),
    ("gin", "content", ("gin.Default()", "gin.New()")),
    ("nestjs", "content", ("NestFactory.create",)),
)

_HIDDEN = r"(^|/)(\.|node_modules(/|$)|__pycache__(/|$))"


def any_of(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def matches_any(col: Column, patterns) -> Column:
    return any_of(col.rlike(p) for p in patterns)


def contains_any(col: Column, needles) -> Column:
    return any_of(F.contains(col, F.lit(n)) for n in needles)


def scan_files(files: DataFrame) -> DataFrame:
    """Drop hidden names, `node_modules` and `__pycache__`."""
    return files.filter(~F.col("path").rlike(_HIDDEN))


def read_text(files: DataFrame) -> DataFrame:
    """Bytes to text, bad bytes replaced, unreadable or empty files left out."""
    text = F.coalesce(F.make_valid_utf8(F.col("content").cast("string")), F.lit(""))
    return files.withColumn("content", text).filter(F.col("content") != "")


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", detect_language(F.col("path")))


def known_files(files: DataFrame) -> DataFrame:
    """Files in a language the rules cover."""
    return with_language(files).filter(F.col("language") != "unknown")


def repo_languages(files: DataFrame) -> DataFrame:
    """Distinct known languages per repository in order of first sight: `rank` 0 is the primary one."""
    first_seen = (
        known_files(files.select("repo_id", "ord", "path"))
        .groupBy("repo_id", "language").agg(F.min("ord").alias("first_ord"))
    )
    # At most one row per language and repository reaches this list.
    seen = F.array_sort(F.collect_list(F.struct("first_ord", "language")))
    return (
        first_seen.groupBy("repo_id").agg(seen.alias("seen"))
        .select("repo_id", F.posexplode("seen").alias("rank", "s"))
        .select("repo_id", "rank", F.col("s.language").alias("language"), F.col("s.first_ord").alias("first_ord"))
    )


def primary_language(files: DataFrame) -> DataFrame:
    """One row per repository with any known file: the language of its first one.

    The language travels as a number, so that the aggregate can hash instead of sort.
    """
    first = known_files(files.select("repo_id", "ord", "path")).groupBy("repo_id").agg(_first_language())
    return _decoded(first)


def _first_language() -> Column:
    names = F.array(*[F.lit(n) for n in LANGUAGE_FAMILY])
    known = F.col("language") != "unknown"
    code = F.array_position(names, F.col("language")).cast("int")
    return F.min_by(code, F.when(known, F.col("ord"))).alias("code")


def _decoded(df: DataFrame) -> DataFrame:
    """`code` to `primary_language` and `family`; null where a repository has no known file."""
    names = F.array(*[F.lit(n) for n in LANGUAGE_FAMILY])
    return df.withColumn("primary_language", F.try_element_at(names, F.col("code"))).drop("code").withColumn(
        "family", language_family(F.col("primary_language"))
    )


def detect_framework(files: DataFrame) -> DataFrame:
    """Framework per repository: paths of all files, contents of known ones, first evidence wins.

    Each piece of evidence becomes a boolean in the scan, so only booleans are shuffled.
    """
    return _profiled(files).select("repo_id", "framework")


def repo_profile(files: DataFrame) -> DataFrame:
    """One row per repository: framework and primary language (null when no file is known)."""
    return _decoded(_profiled(files))


def evidence() -> list[Column]:
    """One flag per piece of framework evidence, over `language`, `path` and `content`."""
    flags = []
    for i, (_, where, needles) in enumerate(FRAMEWORK_EVIDENCE):
        flag = contains_any(F.col("path" if where == "path" else "content"), needles)
        if where == "content":
            flag = (F.col("language") != "unknown") & flag
        flags.append(F.coalesce(flag, F.lit(False)).alias(f"e{i}"))
    return flags


def _profiled(files: DataFrame) -> DataFrame:
    return _from_evidence(with_language(files).select("repo_id", "ord", "language", *evidence()))


def _from_evidence(marked: DataFrame) -> DataFrame:
    flags = [f"e{i}" for i in range(len(FRAMEWORK_EVIDENCE))]
    found = marked.groupBy("repo_id").agg(_first_language(), *[F.bool_or(f).alias(f) for f in flags])
    framework = F.when(F.lit(False), F.lit(None).cast("string"))
    for flag, (name, _, _) in zip(flags, FRAMEWORK_EVIDENCE, strict=True):
        framework = framework.when(F.col(flag), name)
    return found.select("repo_id", "code", framework.otherwise("unknown").alias("framework"))


def profile_from(marked: DataFrame) -> DataFrame:
    """What repo_profile gives, from files `(repo_id, ord, language, e0, e1, ...)` whose contents were already read."""
    return _decoded(_from_evidence(marked))


def relative_path(files: DataFrame, root: Column) -> DataFrame:
    return files.withColumn("rel_path", strip_root(F.col("path"), root))


def classify_files(files: DataFrame) -> DataFrame:
    """Role flags from the path alone."""
    path = F.col("path")
    return files.select(
        "repo_id", "ord", "path",
        path.rlike(MODEL_PATH).alias("is_model"),
        path.rlike(CONFIG_PATH).alias("is_config"),
        matches_any(path, FEATURE_PATHS).alias("is_feature"),
        matches_any(path, ROUTE_PATHS).alias("is_route"),
        path.rlike(ROUTER_CONFIG_PATH).alias("is_router_config"),
    )


def screen_gate(path: Column, content: Column) -> Column:
    """Whether a feature candidate is worth asking about."""
    long_enough = F.length(content) >= MIN_SCREEN_CHARS
    return long_enough & (matches_any(path, FEATURE_PATHS) | contains_any(content, SCREEN_MARKS))


def router_gate(content: Column) -> Column:
    return (F.length(content) >= MIN_SCREEN_CHARS) & contains_any(content, ROUTER_MARKS)


def step_targets(files: DataFrame) -> DataFrame:
    """`(repo_id, agent, ord, path)`: the files each step looks at, from paths alone, in one scan."""
    path, known = F.col("path"), F.col("language") != "unknown"
    model, config = path.rlike(MODEL_PATH), path.rlike(CONFIG_PATH)
    roles = {
        "plan": known, "api": known, "data": model, "service": known, "infra_config": config, "infra_source": known,
    }
    steps = F.filter(
        F.array(*[F.when(cond, F.lit(name)) for name, cond in roles.items()]), lambda s: s.isNotNull()
    )
    return with_language(files.select("repo_id", "ord", "path")).select(
        "repo_id", F.explode(steps).alias("agent"), "ord", "path"
    )


def feature_candidates(files: DataFrame, planned_routes: DataFrame | None = None) -> DataFrame:
    """Screen files, then route files, then the planner's route files; each path once, earliest place wins."""
    path = F.col("path")
    paths = files.select("repo_id", "ord", "path")
    screens = paths.filter(matches_any(path, FEATURE_PATHS)).withColumn("pass", F.lit(0))
    routes = paths.filter(matches_any(path, ROUTE_PATHS)).withColumn("pass", F.lit(1))
    candidates = screens.unionByName(routes)
    if planned_routes is not None:
        candidates = candidates.unionByName(
            planned_routes.select("repo_id", "ord", "path").withColumn("pass", F.lit(2))
        )
    return candidates.groupBy("repo_id", "path").agg(F.min(F.struct("pass", "ord")).alias("at")).select(
        "repo_id", "path", F.col("at.pass").alias("pass"), F.col("at.ord").alias("ord")
    )
