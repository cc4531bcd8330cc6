"""Oracle SQL: each query stated a second time, for DuckDB, without the library's code.

Only the fixture views are shared text. Rules and constants are spelled out again.
"""

from __future__ import annotations

from srcgraph.plans.fixtures import with_clause

ORACLES: dict[str, str] = {}


def _q(text: str) -> str:
    return text.replace("'", "''")


def _add(name: str, views: tuple[str, ...], body: str, *ctes: str) -> None:
    parts = [with_clause(*views)] if views else []
    parts += ctes
    head = f"WITH {', '.join(parts)}\n" if parts else ""
    ORACLES[name] = head + body


# --- files -------------------------------------------------------------------------

KEPT = """kept AS (
  SELECT * FROM source_files
  WHERE len(list_filter(string_split(path, '/'), lambda s: starts_with(s, '.') OR s IN ('node_modules', '__pycache__'))) = 0)"""
LANG = """lang AS (
  SELECT repo_id, ord, path, content, CASE
    WHEN NOT contains(file_name[2:], '.') THEN 'unknown'
    WHEN ext IN ('ts','tsx') THEN 'typescript' WHEN ext IN ('js','jsx','mjs','cjs') THEN 'javascript'
    WHEN ext = 'py' THEN 'python' WHEN ext = 'go' THEN 'go' ELSE 'unknown' END AS language
  FROM (SELECT *, string_split(path, '/')[-1] AS file_name, lower(string_split(path, '.')[-1]) AS ext FROM kept))"""
PRIM = """prim AS (
  SELECT repo_id, arg_min(language, ord) AS primary_language,
    CASE WHEN arg_min(language, ord) IN ('typescript','javascript') THEN 'script' ELSE arg_min(language, ord) END AS family
  FROM lang WHERE language <> 'unknown' GROUP BY repo_id)"""
FILES = ("source_files",)
BASE = (KEPT, LANG, PRIM)


def _framework(known: str) -> str:
    return f"""framework AS (
  SELECT repo_id, CASE
    WHEN contains(paths, 'prisma/schema.prisma') THEN 'express+prisma'
    WHEN contains(texts, 'from ''fastapi''') OR contains(texts, 'from fastapi') THEN 'fastapi'
    WHEN contains(texts, 'from ''next''') OR contains(paths, 'next.config') THEN 'nextjs'
    WHEN contains(texts, 'express()') THEN 'express'
    WHEN contains(texts, 'gin.Default()') OR contains(texts, 'gin.New()') THEN 'gin'
    WHEN contains(texts, 'NestFactory.create') THEN 'nestjs' ELSE 'unknown' END AS framework
  FROM (SELECT repo_id, string_agg(path, chr(10)) AS paths FROM kept GROUP BY repo_id)
  LEFT JOIN (SELECT repo_id, string_agg(content, chr(10)) AS texts FROM {known} GROUP BY repo_id) USING (repo_id))"""


FRAMEWORK = _framework("(SELECT * FROM lang WHERE language <> 'unknown')")

_add("scan_files", FILES, "SELECT repo_id, ord, path FROM kept", KEPT)
_add("read_text", FILES, "SELECT repo_id, ord, content FROM kept WHERE content <> ''", KEPT)
_add("detect_language", FILES, "SELECT repo_id, ord, language FROM lang", *BASE)
_add("repo_languages", FILES, """
SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY first_ord) - 1 AS INTEGER) AS rank, language, first_ord
FROM (SELECT repo_id, language, min(ord) AS first_ord FROM lang WHERE language <> 'unknown' GROUP BY ALL)""", *BASE)
_add("detect_framework", FILES, "SELECT * FROM framework", *BASE, FRAMEWORK)
_add("relative_path", FILES, """
SELECT ord, path, CASE WHEN starts_with(path, root) THEN path[len(root) + 1:] ELSE path END AS rel_path
FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN '/src' ELSE '/.cache' END AS root FROM source_files)""")
_add("short_path", ("typed_nodes",), """
SELECT session_id, id, array_to_string(string_split(file_path, '/')[-3:], '/') AS short FROM typed_nodes""")

# Path patterns and marks of file roles.
FEATURE_RE = r"Page\.(tsx|jsx|ts|js)$|Screen\.(tsx|jsx|ts|js)$|View\.(tsx|jsx|ts|js)$|Dashboard\.(tsx|jsx|ts|js)$|/pages/[^/]+\.(tsx|jsx|ts|js)$|/app/[^/]*page\.(tsx|jsx|ts|js)$"
ROUTE_RE = r"router\.(tsx|jsx|ts|js)$|routes\.(tsx|jsx|ts|js)$|App\.(tsx|jsx|ts|js)$|index\.(tsx|jsx)$|layout\.(tsx|jsx)$"
ROUTER_RE = r"App\.(tsx|jsx)$|router\.(tsx|jsx|ts|js)$|routes\.(tsx|jsx|ts|js)$"
MODEL_WORDS = "(contains(lower(path), 'model') OR contains(lower(path), 'schema') OR contains(lower(path), 'entity') OR contains(lower(path), 'migration'))"
CONFIG_WORDS = ("(" + " OR ".join(f"contains(lower(path), '{w}')" for w in (
    "package.json", "requirements.txt", "go.mod", "docker-compose", ".env.example", "dockerfile")) + ")")

_add("classify_files", FILES, f"""
SELECT repo_id, ord, path, {MODEL_WORDS} AS is_model, {CONFIG_WORDS} AS is_config,
  regexp_matches(path, '{FEATURE_RE}') AS is_feature, regexp_matches(path, '{ROUTE_RE}') AS is_route,
  regexp_matches(path, '{ROUTER_RE}') AS is_router_config
FROM kept""", KEPT)

# --- extraction --------------------------------------------------------------------

# The patterns of the extraction rules, stated again.
EXPRESS = _q(r"""(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['"`]([^'"`]+)['"`]""")
HANDLER = r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH)"
DECORATOR = _q(r"""@(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""")
HANDLE_FUNC = r'(?:http\.HandleFunc|r\.(?:GET|POST|PUT|DELETE|PATCH))\s*\(\s*"([^"]+)"'
PRISMA = r"model\s+(\w+)\s*\{"
TYPEORM = r"@Entity\([^)]*\)\s*(?:export\s+)?class\s+(\w+)"
SEQUELIZE = r"class\s+(\w+)\s+extends\s+Model"
SQLALCHEMY = r"class\s+(\w+)\s*\(\s*(?:Base|db\.Model|Model)\s*\)"
ES_IMPORT = _q(r"""(?:import|require)\s*(?:\{[^}]*\}|[\w*]+)\s*(?:from\s*)?['"`]([^'"`]+)['"`]""")
PY_IMPORT = r"(?m)^(?:import|from)\s+([\w.]+)"
GO_IMPORT = r'"([\w./]+)"'
ENV_NODE = r"process\.env\.(\w+)"
ENV_PY = _q(r"""os\.environ(?:\.get)?\s*\(\s*['"](\w+)['"]""")
ENV_GO = r'os\.Getenv\s*\(\s*"(\w+)"'


def _hits(rule: str, rank: int, pattern: str, family: str, value: str = "g1[i]", source: str = "repo") -> str:
    """One rule's matches; `g1` and `g2` are the lists of groups 1 and 2."""
    two = f"regexp_extract_all(content, '{pattern}', 2)" if "g2" in value else "NULL"
    own = ("CASE WHEN l.language IN ('typescript','javascript') THEN 'script' ELSE l.language END" if source == "file"
           else "p.family")
    return f"""
  SELECT repo_id, ord, path, '{rule}' AS rule, {rank} AS rule_rank, CAST(i - 1 AS INTEGER) AS match_pos, {value} AS value
  FROM (SELECT l.repo_id, l.ord, l.path, regexp_extract_all(content, '{pattern}', 1) AS g1, {two} AS g2
        FROM lang l JOIN prim p USING (repo_id) WHERE {own} = '{family}') h, unnest(range(1, len(g1) + 1)) t(i)"""


def _routes(source: str = "repo") -> str:
    both = "upper(g1[i]) || ' ' || g2[i]"
    return "routes AS (" + " UNION ALL ".join([
        _hits("express", 0, EXPRESS, "script", both, source), _hits("handler_export", 1, HANDLER, "script", source=source),
        _hits("decorator", 2, DECORATOR, "python", both, source), _hits("handle_func", 3, HANDLE_FUNC, "go", source=source),
    ]) + ")"


ROUTES = _routes()
MODELS = "models AS (" + " UNION ALL ".join([
    _hits("prisma", 0, PRISMA, "script"), _hits("typeorm", 1, TYPEORM, "script"), _hits("sequelize", 2, SEQUELIZE, "script"),
    r"""
  SELECT repo_id, ord, path, 'mongoose' AS rule, 3 AS rule_rank, 0 AS match_pos, 'MongooseSchema' AS value
  FROM lang JOIN prim USING (repo_id) WHERE family = 'script' AND regexp_matches(content, 'new\s+Schema\s*\(')""",
    _hits("sqlalchemy", 4, SQLALCHEMY, "python"),
]) + ")"
IMPORTS = "imports AS (SELECT * FROM (" + " UNION ALL ".join([
    _hits("es_import", 0, ES_IMPORT, "script"), _hits("py_import", 1, PY_IMPORT, "python"), _hits("go_import", 2, GO_IMPORT, "go"),
]) + ") WHERE NOT (rule = 'es_import' AND value[1] = '.'))"

_add("extract_routes", FILES, "SELECT repo_id, ord, rule, match_pos, value AS route FROM routes", *BASE, ROUTES)
_add("extract_routes_by_file", FILES, "SELECT repo_id, ord, rule, match_pos, value AS route FROM routes", KEPT, LANG,
     PRIM.replace("prim AS (", "prim AS (SELECT DISTINCT repo_id, NULL AS family FROM kept UNION SELECT NULL, NULL WHERE false), unused AS ("),
     _routes("file"))
_add("routes_per_method", FILES, """
SELECT repo_id, CASE WHEN rule = 'handle_func' THEN 'any' ELSE string_split(value, ' ')[1] END AS method, count(*) AS n_endpoints
FROM routes GROUP BY ALL""", *BASE, ROUTES)
_add("extract_models", FILES, "SELECT repo_id, ord, rule, match_pos, value AS model FROM models", *BASE, MODELS)
_add("extract_imports", FILES, "SELECT repo_id, ord, rule, match_pos, value AS package FROM imports", *BASE, IMPORTS)
_add("top_packages", FILES, """
SELECT repo_id, value AS package, count(*) AS n_imports, count(DISTINCT ord) AS n_files FROM imports GROUP BY repo_id, value
QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n_imports DESC, package) <= 10""", *BASE, IMPORTS)

ENV = f"""env AS (
  SELECT repo_id, ord, CAST(row_number() OVER (PARTITION BY repo_id, ord ORDER BY first_at) - 1 AS INTEGER) AS pos, env_key
  FROM (SELECT repo_id, ord, env_key, min(place) AS first_at FROM (
    SELECT repo_id, ord, i AS place, keys[i] AS env_key FROM (
      SELECT repo_id, ord, regexp_extract_all(content, '{ENV_NODE}', 1) || regexp_extract_all(content, '{ENV_PY}', 1)
        || regexp_extract_all(content, '{ENV_GO}', 1) AS keys FROM kept), unnest(range(1, len(keys) + 1)) t(i))
    GROUP BY ALL))"""
_add("extract_env_vars", FILES, "SELECT * FROM env", KEPT, ENV)

# The services, their categories, patterns and packages.
SDKS = [
    ("AWS", "cloud", "aws-sdk|@aws-sdk", "aws-sdk"), ("Google Cloud", "cloud", "@google-cloud", "google-cloud"),
    ("Azure", "cloud", "azure-", "azure-"), ("Stripe", "payment", "stripe", "stripe"),
    ("Email Service", "email", "nodemailer|sendgrid|@sendgrid|mailgun|resend", "nodemailer"),
    ("Twilio", "other", "twilio", "twilio"), ("Firebase", "cloud", "firebase|@firebase", "firebase"),
    ("Supabase", "cloud", "supabase", "supabase"), ("Redis", "queue", "ioredis|redis", "ioredis"),
    ("Message Queue", "queue", "amqplib|rabbitmq|bull|bullmq", "amqplib"), ("OpenAI", "other", "openai", "openai"),
    ("Anthropic", "other", "@anthropic-ai", "anthropic-ai"), ("Sentry", "monitoring", "sentry", "sentry"),
    ("Datadog", "monitoring", "datadog", "datadog"), ("Auth Provider", "auth", "auth0|passport|@auth0", "auth0"),
    ("Clerk", "auth", "clerk", "clerk"),
]
SDK_TABLE = "sdk_rules(rule_rank, name, category, pattern, package) AS (VALUES " + ", ".join(
    f"({i}, '{n}', '{c}', '{p}', '{k}')" for i, (n, c, p, k) in enumerate(SDKS)) + ")"


def _sdk_ctes(config_files: str, source_files: str) -> tuple[str, ...]:
    return (SDK_TABLE, f"""config_hits AS (
  SELECT f.repo_id, f.ord, s.*, len([k FOR k IN regexp_extract_all(content, '{ENV_NODE}', 1) || regexp_extract_all(content, '{ENV_PY}', 1)
      || regexp_extract_all(content, '{ENV_GO}', 1) IF contains(upper(k), regexp_replace(upper(s.name), ' ', '_'))]) AS unused
  FROM {config_files} f JOIN sdk_rules s ON regexp_matches(f.content, s.pattern, 'i'))""",
            f"""source_hits AS (SELECT f.repo_id, f.ord, s.* FROM {source_files} f JOIN sdk_rules s ON regexp_matches(f.content, s.pattern, 'i'))""",
            """sdk_keys AS (
  SELECT h.repo_id, h.name, h.ord, CAST(row_number() OVER (PARTITION BY h.repo_id, h.name, h.ord ORDER BY e.pos) - 1 AS INTEGER) AS pos, e.env_key
  FROM config_hits h JOIN env e ON e.repo_id = h.repo_id AND e.ord = h.ord
  WHERE contains(upper(e.env_key), regexp_replace(upper(h.name), ' ', '_')))""",
            """phase_one AS (SELECT repo_id, name, category, package AS sdk_package, true AS in_config, rule_rank, min(ord) AS ord FROM config_hits GROUP BY ALL)""",
            """sdks AS (
  SELECT p.*, coalesce(k.n, 0) AS n_env_keys FROM phase_one p LEFT JOIN (SELECT repo_id, name, count(*) AS n FROM sdk_keys GROUP BY ALL) k USING (repo_id, name)
  UNION ALL
  SELECT repo_id, name, category, lower(name), false, rule_rank, min(ord), 0 FROM source_hits s
  WHERE NOT EXISTS (SELECT 1 FROM phase_one p WHERE p.repo_id = s.repo_id AND p.name = s.name) GROUP BY ALL)""")


SDK = _sdk_ctes(f"(SELECT * FROM kept WHERE {CONFIG_WORDS})", "(SELECT * FROM lang WHERE language <> 'unknown')")
SDK_OUT = "SELECT repo_id, name, category, sdk_package, in_config, rule_rank, ord, n_env_keys FROM sdks"
_add("detect_sdks", FILES, SDK_OUT, *BASE, ENV, *SDK)
_add("sdk_env_keys", FILES, "SELECT * FROM sdk_keys", *BASE, ENV, *SDK)

# --- gates and targets ---------------------------------------------------------------

ROUTE_GATE = f"""(CASE p.family
    WHEN 'script' THEN regexp_matches(content, '{EXPRESS}') OR regexp_matches(content, '{HANDLER}')
    WHEN 'python' THEN regexp_matches(content, '{DECORATOR}')
    WHEN 'go' THEN regexp_matches(content, '{HANDLE_FUNC}') ELSE false END OR contains(content, 'route') OR contains(content, 'endpoint'))"""
MODEL_GATE = rf"""(CASE p.family
    WHEN 'script' THEN regexp_matches(content, '{PRISMA}') OR regexp_matches(content, '{TYPEORM}') OR regexp_matches(content, '{SEQUELIZE}') OR regexp_matches(content, 'new\s+Schema\s*\(')
    WHEN 'python' THEN regexp_matches(content, '{SQLALCHEMY}') ELSE false END OR contains(content, 'Schema') OR contains(content, 'model'))"""
# The marks of a screen.
SCREEN_GATE = f"""(length(content) >= 50 AND (regexp_matches(path, '{FEATURE_RE}') OR """ + " OR ".join(
    f"contains(content, '{_q(m)}')" for m in (
        "<Route", "createBrowserRouter", "createHashRouter", "useRoutes(", "from 'react-router", 'from "react-router', "/pages/",
        "export default function", "export default page", "generateStaticParams")) + "))"
ROUTER_GATE = "(length(content) >= 50 AND (contains(content, '<Route') OR contains(content, 'createBrowserRouter') OR contains(content, 'useRoutes')))"
GATES = f"""gates AS (
  SELECT l.repo_id, l.ord, l.path, {ROUTE_GATE} AS api_gate, {MODEL_GATE} AS data_gate, {SCREEN_GATE} AS feature_gate, {ROUTER_GATE} AS router_gate
  FROM lang l LEFT JOIN prim p USING (repo_id))"""
_add("content_gates", FILES, "SELECT * FROM gates", *BASE, GATES)


_known = "language <> 'unknown'"
_add("step_targets", FILES, " UNION ALL ".join(
    f"SELECT repo_id, '{agent}' AS agent, ord, path FROM lang WHERE {where}" for agent, where in (
        ("plan", _known), ("api", _known), ("data", MODEL_WORDS), ("service", _known), ("infra_config", CONFIG_WORDS),
        ("infra_source", _known))), *BASE)
_candidates = f"""
SELECT repo_id, path, pass, ord FROM (
  SELECT *, 0 AS pass FROM kept WHERE regexp_matches(path, '{FEATURE_RE}')
  UNION ALL SELECT *, 1 FROM kept WHERE regexp_matches(path, '{ROUTE_RE}')
  {{more}})
QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY pass, ord) = 1"""
_add("feature_candidates", FILES, _candidates.format(more="UNION ALL SELECT *, 2 FROM kept WHERE starts_with(path, '/src/routes/')"), KEPT)

# --- answers -----------------------------------------------------------------------


def _array(view: str, extra: str = "") -> str:
    """Records of the JSON arrays in a view's texts."""
    return f"""rec AS (
  SELECT session_id, ord{extra}, CAST(i - 1 AS INTEGER) AS sub, json_extract(arr, '$[' || CAST(i - 1 AS VARCHAR) || ']') AS r
  FROM (SELECT *, CASE WHEN json_valid(span) THEN span ELSE '[]' END AS arr FROM (
    SELECT *, CASE WHEN a > 0 AND b > a THEN text[a:b] ELSE '[]' END AS span FROM (
      SELECT *, strpos(text, '[') AS a, length(text) - strpos(reverse(text), ']') + 1 AS b FROM {view}))),
    unnest(range(1, CAST(json_array_length(arr) AS BIGINT) + 1)) t(i)
  WHERE json_type(arr, '$[' || CAST(i - 1 AS VARCHAR) || ']') = 'OBJECT')"""


SERVICE_REC = _array("model_responses")
_s = "json_extract_string(r, '$.{}')".format
_add("parse_responses", ("model_responses",), f"""
SELECT session_id, ord, sub, {_s('name')} AS name, {_s('filePath')} AS "filePath",
  array_to_string(CAST(json_extract(r, '$.dependsOn') AS VARCHAR[]), ',') AS depends_on FROM rec""", SERVICE_REC)
_add("parse_endpoint_responses", ("endpoint_responses",), f"""
SELECT session_id, ord, sub, coalesce({_s('method')}, '') AS method, coalesce({_s('path')}, '') AS url_path,
  coalesce({_s('handlerName')}, '') AS handler_name, coalesce({_s('authRequired')} = 'true', false) AS auth_required,
  coalesce(array_to_string(CAST(json_extract(r, '$.middlewares') AS VARCHAR[]), ','), '') AS middlewares FROM rec""",
     _array("endpoint_responses"))
_add("parse_entity_responses", ("entity_responses",), f"""
SELECT session_id, ord, sub, {_s('name')} AS name, {_s('dbType')} AS db_type, {_s('orm')} AS orm,
  array_to_string([concat(json_extract_string(f, '$.name'), ':', json_extract_string(f, '$.type'), ':', json_extract_string(f, '$.nullable'))
    FOR f IN CAST(json_extract(r, '$.fields') AS JSON[])], ',') AS fields FROM rec""", _array("entity_responses"))
_add("parse_external_responses", ("external_responses",), f"""
SELECT session_id, {_s('name')} AS name, {_s('category')} AS category, {_s('sdkPackage')} AS sdk_package, ord, CAST(sub AS INTEGER) AS sub,
  array_to_string(CAST(json_extract(r, '$.envKeys') AS VARCHAR[]), ',') AS env_keys FROM rec
QUALIFY row_number() OVER (PARTITION BY session_id, name ORDER BY ord, sub) = 1""", _array("external_responses"))


def _object(view: str) -> str:
    return f"""obj AS (
  SELECT session_id, ord, span AS o FROM (
    SELECT *, CASE WHEN a > 0 AND b > a THEN text[a:b] ELSE '' END AS span FROM (
      SELECT *, strpos(text, '{{') AS a, length(text) - strpos(reverse(text), '}}') + 1 AS b FROM {view})) WHERE json_valid(span))"""


VERDICTS = (_object("verdict_responses"), """verdicts AS (
  SELECT session_id, ord, decision, CAST(i - 1 AS INTEGER) AS pos, ids[i] AS node_id FROM (
    SELECT session_id, ord, 'keep' AS decision, CAST(json_extract(o, '$.keep') AS VARCHAR[]) AS ids FROM obj
    UNION ALL SELECT session_id, ord, 'remove', CAST(json_extract(o, '$.remove') AS VARCHAR[]) FROM obj),
  unnest(range(1, len(ids) + 1)) t(i))""")
_add("parse_verdicts", ("verdict_responses",), "SELECT * FROM verdicts", *VERDICTS)
def _plans(view: str) -> tuple[str, str]:
    return _object(view), "plans AS (" + " UNION ALL ".join(
        f"SELECT session_id, ord, '{role}' AS role, CAST(i - 1 AS INTEGER) AS pos, ids[i] AS path FROM "
        f"(SELECT *, CAST(json_extract(o, '$.{field}') AS VARCHAR[]) AS ids FROM obj), unnest(range(1, len(ids) + 1)) t(i)"
        for role, field in (("entry", "entryPoints"), ("route", "routeFiles"), ("model", "modelFiles"), ("config", "configFiles"))) + ")"


PLANS = _plans("plan_responses")
_add("parse_plans", ("plan_responses",), "SELECT * FROM plans", *PLANS)

# --- prompts -----------------------------------------------------------------------

API_ASK = ("List every HTTP endpoint this file defines.",
           "Answer with a JSON array of {method, path, handlerName, authRequired, middlewares}; [] if there are none.")
DATA_ASK = ("List every database model or schema this file defines.",
            "Answer with a JSON array of {name, dbType, orm, fields: [{name, type, nullable}]}; [] if there are none.")
FEATURE_TELL = "Answer with a JSON array of {name, route, filePath, usesAuth, usesServices, confidence}; [] if it is no screen."


def _parts(source: str, size: int) -> str:
    return f"(SELECT f.*, CAST(p AS INTEGER) AS part, substring(content, p * {size} + 1, {size}) AS piece FROM {source} f, unnest(range(0, CAST(ceil(length(content) / {size}.0) AS BIGINT))) t(p))"


def _file_prompts(targets: str, gate: str, ask: tuple[str, str], agent: str) -> str:
    rows = f"(SELECT l.* FROM {targets} l LEFT JOIN prim p USING (repo_id) WHERE {gate})"
    return f"""SELECT repo_id, ord, path, part, concat('{ask[0]}', chr(10), 'File: ', path, chr(10), piece, chr(10), '{ask[1]}') AS prompt, '{agent}' AS agent
FROM {_parts(rows, 3000)}"""


_add("build_prompts", FILES, _file_prompts(f"(SELECT * FROM lang WHERE {_known})", ROUTE_GATE, API_ASK, "api") + " UNION ALL "
     + _file_prompts(f"(SELECT * FROM lang WHERE {MODEL_WORDS})", MODEL_GATE, DATA_ASK, "data"), *BASE)
LISTED = """listed AS (
  SELECT DISTINCT repo_id, k.path, role FROM kept k JOIN plans p ON p.session_id = k.repo_id
    AND k.path = CASE WHEN starts_with(p.path, '/') THEN p.path ELSE '/' || p.path END)"""


def _planned(otherwise: str, role: str) -> str:
    """A repository's listed files, or where none of them exists those that `otherwise` holds for."""
    return f"""(SELECT * FROM lang WHERE CASE WHEN repo_id IN (SELECT repo_id FROM listed WHERE role = '{role}')
  THEN (repo_id, path) IN (SELECT (repo_id, path) FROM listed WHERE role = '{role}') ELSE {otherwise} END)"""


_add("planned_prompts", ("source_files", "planner_answers"),
     _file_prompts(_planned(_known, "route"), ROUTE_GATE, API_ASK, "api") + " UNION ALL "
     + _file_prompts(_planned(MODEL_WORDS, "model"), MODEL_GATE, DATA_ASK, "data"), *BASE, *_plans("planner_answers"), LISTED)
_add("planner_prompts", FILES, f"""
SELECT repo_id, batch, concat('Sort these files into entry points, route files, model files and config files.', chr(10), 'Framework: ', framework, chr(10),
  string_agg(path, chr(10) ORDER BY ord), chr(10), 'Answer with JSON {{entryPoints, routeFiles, modelFiles, configFiles}} of paths as given.') AS prompt
FROM (SELECT *, (row_number() OVER (PARTITION BY repo_id ORDER BY ord) - 1) // 50 AS batch FROM lang WHERE {_known}) JOIN framework USING (repo_id)
GROUP BY repo_id, batch, framework""", *BASE, FRAMEWORK)
_add("service_prompts", FILES, f"""
SELECT repo_id, batch, part, concat('Name the separate internal services or modules of this codebase.', chr(10), 'Framework: ', framework, chr(10),
  string_agg(concat('--- ', path, chr(10), piece), chr(10) || chr(10) ORDER BY ord), chr(10),
  'Answer with a JSON array of {{name, filePath, description, dependsOn}}; [] if it is one piece.') AS prompt
FROM {_parts(f"(SELECT *, (row_number() OVER (PARTITION BY repo_id ORDER BY ord) - 1) // 15 AS batch FROM lang WHERE {_known})", 1500)} JOIN framework USING (repo_id)
GROUP BY repo_id, batch, part, framework""", *BASE, FRAMEWORK)
_add("infra_prompts", FILES, f"""
SELECT repo_id, batch, concat('Which external services do these environment variables point to?', chr(10), string_agg(env_key, ', ' ORDER BY n), chr(10),
  'Answer with a JSON array of {{name, category, envKeys, sdkPackage}}; [] if none is clear.') AS prompt
FROM (SELECT *, (n - 1) // 200 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ord, pos) AS n FROM (
  SELECT e.* FROM env e JOIN lang l USING (repo_id, ord) WHERE {_known}
    AND NOT EXISTS (SELECT 1 FROM sdks h WHERE h.repo_id = e.repo_id)
  QUALIFY row_number() OVER (PARTITION BY e.repo_id, e.env_key ORDER BY e.ord, e.pos) = 1)))
GROUP BY repo_id, batch""", *BASE, ENV, *SDK)
def _feature_prompts(candidate: str) -> str:
    return f"""
SELECT repo_id, ord, path, part, coalesce(batch, 0) AS batch, concat('List the screens a user sees in this file.', chr(10), 'File: ', path, chr(10), piece, chr(10), 'Known nodes: ',
  coalesce(summary, '[]'), chr(10), '{FEATURE_TELL}') AS prompt
FROM {_parts(f"(SELECT * FROM kept WHERE ({candidate}) AND {SCREEN_GATE})", 3000)} f
LEFT JOIN (SELECT session_id, batch, concat('[', string_agg(concat('{{"id":"', id, '","type":"', type, '","label":"', label, '"}}'), ',' ORDER BY ord), ']') AS summary
  FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1) // 30 AS batch FROM nodes) GROUP BY session_id, batch) s ON s.session_id = f.repo_id"""


SCREENS = f"regexp_matches(path, '{FEATURE_RE}') OR regexp_matches(path, '{ROUTE_RE}')"
_add("feature_prompts", ("source_files", "nodes"), _feature_prompts(SCREENS), KEPT)
_add("planned_feature_prompts", ("source_files", "nodes", "planner_answers"), _feature_prompts(
    SCREENS + " OR (repo_id, path) IN (SELECT (repo_id, path) FROM listed WHERE role = 'route')"), KEPT, *_plans("planner_answers"), LISTED)
_add("router_prompts", FILES, f"""
SELECT repo_id, ord, path, part, concat('List every route this router file declares.', chr(10), 'File: ', path, chr(10), piece, chr(10), '{FEATURE_TELL}') AS prompt
FROM {_parts(f"(SELECT * FROM kept WHERE regexp_matches(path, '{ROUTER_RE}') AND {ROUTER_GATE})", 4000)}""", KEPT)
_add("critic_prompts", ("typed_nodes",), """
SELECT session_id, batch, concat('These findings have low confidence. Which ones should stay?', chr(10), '[',
  string_agg(concat('{"id":"', id, '","type":"', type, '","label":"', label, '","source":"', agent_source, '"}'), ',' ORDER BY ord), ']', chr(10),
  'Answer with JSON {keep, remove} of ids.') AS prompt
FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1) // 50 AS batch FROM typed_nodes WHERE confidence < 0.7)
GROUP BY session_id, batch""")

# --- builders ----------------------------------------------------------------------


def _sha(*parts: str) -> str:
    return "sha256(concat(" + ", ".join(f"length(coalesce(CAST({p} AS VARCHAR), '')), ':', {p}" for p in parts) + "))"


BIG = "288230376151711744"      # 2**58
LIST = "2147483648"             # 2**31
PROFILE = "profile AS (SELECT k.repo_id AS session_id, framework, primary_language FROM framework k LEFT JOIN prim USING (repo_id))"


def _main(entry: str = "NULL") -> str:
    label = "CASE WHEN framework <> 'unknown' THEN framework ELSE 'Application' END"
    return f"""main_nodes AS (
  SELECT session_id, 0 AS source_rank, CAST(0 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS sub,
    {_sha('session_id', "'planner'", "'service'", 'file_path', '0', '0', 'label')} AS id,
    'service' AS type, label, CAST(1 AS DOUBLE) AS confidence, 'planner' AS agent_source, language, file_path FROM (
    SELECT session_id, {label} AS label, coalesce(primary_language, 'unknown') AS language, coalesce({entry}, '/') AS file_path
    FROM profile{' LEFT JOIN entries USING (session_id)' if entry != 'NULL' else ''}))"""


MAIN = (FRAMEWORK, PROFILE, _main())
_add("main_nodes", ("source_files", "plan_responses"),
     "SELECT session_id, id, label, confidence, language, file_path FROM main_nodes", *BASE, FRAMEWORK, PROFILE, *PLANS,
     """entries AS (SELECT session_id, path AS entry FROM plans WHERE role = 'entry'
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord, pos) = 1)""", _main("entry"))


def _nodes(name: str, source: str, agent: str, rank: int, type_: str, label: str, path: str, conf: str, extra: str = "") -> str:
    return f"""{name} AS (
  SELECT *, {_sha('session_id', f"'{agent}'", 'type', path, 'ord', 'sub', 'label')} AS id FROM (
    SELECT session_id, {rank} AS source_rank, CAST(ord AS BIGINT) AS ord, CAST(sub AS BIGINT) AS sub, {type_} AS type, {label} AS label,
      CAST({conf} AS DOUBLE) AS confidence, '{agent}' AS agent_source{extra} FROM {source}))"""


ENDPOINTS = (ROUTES, _nodes(
    "endpoints", f"(SELECT *, repo_id AS session_id, CAST(rule_rank AS BIGINT) * {LIST} + match_pos AS sub, path AS file_path FROM routes)",
    "api", 1, "'api'", "value", "file_path", "0.85", ", file_path"))
ENTITIES = (MODELS, _nodes(
    "entities", f"(SELECT *, repo_id AS session_id, CAST(rule_rank AS BIGINT) * {LIST} + match_pos AS sub, path AS file_path FROM models)",
    "data", 2, "'database'", "value", "file_path", "0.9",
    ", file_path, rule AS orm, CASE rule WHEN 'mongoose' THEN 'mongodb' ELSE 'unknown' END AS db_type"))
SERVICES = (SERVICE_REC.replace("rec AS", "service_rec AS"), _nodes(
    "services", f"(SELECT *, {_s('name')} AS name, {_s('filePath')} AS file_path FROM service_rec LEFT JOIN profile USING (session_id))",
    "service", 3, "'service'", "name", "file_path", "0.8",
    ", file_path, coalesce(primary_language, 'unknown') AS language, coalesce(framework, 'unknown') AS framework"))
EXTERNALS = (ENV, *SDK, """first_keys AS (
  SELECT repo_id, name, string_agg(env_key, ',' ORDER BY ord, pos) AS env_keys FROM (
    SELECT * FROM sdk_keys QUALIFY row_number() OVER (PARTITION BY repo_id, name, env_key ORDER BY ord, pos) = 1) GROUP BY ALL)""", _nodes(
    "externals", f"(SELECT s.repo_id AS session_id, s.name, s.category, s.sdk_package, CASE WHEN in_config THEN 0 ELSE {BIG} END + ord AS ord, rule_rank AS sub, coalesce(env_keys, '') AS env_keys FROM sdks s LEFT JOIN first_keys USING (repo_id, name))",
    "infra", 4, "CASE WHEN category IN ('queue', 'cloud') THEN 'infra' ELSE 'external' END", "name", "''", "0.85", ", sdk_package, env_keys"))
FEATURES = (_array("feature_responses", ", pass, file_path").replace("rec AS", "feature_rec AS"), f"""picked AS (
  SELECT *, {_s('name')} AS name FROM feature_rec WHERE coalesce({_s('name')}, '') <> ''
  QUALIFY row_number() OVER (PARTITION BY session_id, lower(trim({_s('name')})) ORDER BY pass, ord, sub) = 1)""", _nodes(
    "features", f"(SELECT session_id, pass * {BIG} + ord AS ord, sub, name, r, file_path FROM picked)", "features", 5, "'feature'", "name", "file_path",
    f"coalesce(CAST({_s('confidence')} AS DOUBLE), 0.8)",
    f", file_path, coalesce({_s('usesAuth')} = 'true', false) AS uses_auth, coalesce({_s('route')}, '') AS route, r"))


def _star(nodes: str, type_: str, rel: str, animated: str) -> str:
    return f"""SELECT n.session_id, {_sha('n.session_id', 'm.id', 'n.id', f"'{rel}'", 'n.ord', 'n.sub')} AS id, m.id AS source, n.id AS target,
  '{type_}' AS type, '{rel}' AS label, {animated} AS animated, '{rel}' AS relationship_type, 'unidirectional' AS direction
FROM {nodes} n JOIN main_nodes m USING (session_id)"""


_add("endpoint_nodes", FILES, "SELECT session_id, ord, sub, id, label, confidence, agent_source, file_path FROM endpoints", *BASE, *ENDPOINTS)
_add("endpoint_graph", FILES, _star("endpoints", "dependency", "HANDLES", "false"), *BASE, *MAIN, *ENDPOINTS)
_add("entity_nodes", FILES, "SELECT session_id, ord, sub, id, label, confidence, orm, db_type FROM entities", *BASE, *ENTITIES)
_add("relates_to", FILES, """
SELECT session_id, source, source_place, source_place + 1 AS first_target, n AS last_target, n - source_place AS n_targets FROM (
  SELECT session_id, id AS source, row_number() OVER (PARTITION BY session_id ORDER BY ord, sub) AS source_place,
    count(*) OVER (PARTITION BY session_id) AS n FROM entities)""", *BASE, *ENTITIES)
_add("related_targets", FILES, """
, placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord, sub) AS place FROM entities)
SELECT a.session_id, a.id AS source, b.id AS target, b.place AS target_place
FROM placed a JOIN placed b ON b.session_id = a.session_id AND b.place > a.place WHERE a.ord % 10 = 0""", *BASE, *ENTITIES)
_add("relates_to_raw_count", FILES, """
SELECT session_id, max(seen) AS n_entities, max(seen * (seen - 1) // 2) AS distinct_pairs, CAST(sum(seen * (seen - 1) // 2) AS BIGINT) AS raw_pairs FROM (
  SELECT g.repo_id AS session_id, g.ord, (SELECT count(*) FROM entities e WHERE e.session_id = g.repo_id AND e.ord <= g.ord) AS seen
  FROM gates g WHERE data_gate) GROUP BY session_id""", *BASE, GATES, *ENTITIES)
_add("relates_to_resolved", FILES, """
, placed AS (SELECT session_id, lower(label) AS k, id, row_number() OVER (PARTITION BY session_id ORDER BY ord, sub) AS place FROM entities),
surv AS (SELECT session_id, k, arg_min(id, place) AS source, min(place) AS first_place, max(place) AS last_place FROM placed GROUP BY session_id, k)
SELECT session_id, source, first_place, last_place,
  (SELECT count(*) FROM surv b WHERE b.session_id = a.session_id AND b.source <> a.source AND b.last_place > a.first_place) AS n_targets FROM surv a""",
     *BASE, *ENTITIES)
_add("service_nodes", ("source_files", "model_responses"),
     "SELECT session_id, ord, sub, id, label, confidence, language, framework, file_path FROM services", *BASE, FRAMEWORK, PROFILE, *SERVICES)
_add("service_graph", ("source_files", "model_responses"), _star("services", "dependency", "DEPENDS_ON", "false"), *BASE, *MAIN, *SERVICES)
SERVICE_DEPS = f"""service_deps AS (
  SELECT w.session_id, {BIG} + w.ord AS ord, CAST(w.sub AS BIGINT) * {LIST} + w.pos AS sub, a.id AS source, b.id AS target, 'DEPENDS_ON' AS relationship_type
  FROM (SELECT session_id, ord, sub, {_s('name')} AS name, i - 1 AS pos, deps[i] AS dep FROM (
      SELECT *, CAST(json_extract(r, '$.dependsOn') AS VARCHAR[]) AS deps FROM service_rec), unnest(range(1, len(deps) + 1)) t(i)) w
  JOIN last_named a ON a.session_id = w.session_id AND a.label = w.name
  JOIN last_named b ON b.session_id = w.session_id AND b.label = w.dep WHERE a.id <> b.id)"""
LAST_NAMED = "last_named AS (SELECT * FROM services QUALIFY row_number() OVER (PARTITION BY session_id, label ORDER BY ord DESC, sub DESC) = 1)"
_add("service_deps", ("source_files", "model_responses"), "SELECT * FROM service_deps",
     *BASE, FRAMEWORK, PROFILE, *SERVICES, LAST_NAMED, SERVICE_DEPS)
_add("external_nodes", FILES, "SELECT session_id, ord, sub, id, type, label, sdk_package, env_keys FROM externals", *BASE, *EXTERNALS)
_add("external_graph", FILES, _star("externals", "dataFlow", "CONNECTS_TO", "true"), *BASE, *MAIN, *EXTERNALS)
_add("feature_nodes", ("feature_responses",),
     "SELECT session_id, ord, sub, id, label, confidence, uses_auth, route, file_path FROM features", *FEATURES)


def _uses(existing: str) -> str:
    return f"""uses AS (
  SELECT w.session_id, w.ord, w.sub * {LIST} + w.pos AS sub, w.id AS source, t.id AS target, 'USES' AS label, 'DEPENDS_ON' AS relationship_type
  FROM (SELECT session_id, ord, sub, id, i - 1 AS pos, lower(trim(svc[i])) AS k FROM (
      SELECT *, CAST(json_extract(r, '$.usesServices') AS VARCHAR[]) AS svc FROM features), unnest(range(1, len(svc) + 1)) t(i)) w
  JOIN (SELECT session_id, lower(trim(label)) AS k, id FROM {existing}
        QUALIFY row_number() OVER (PARTITION BY session_id, lower(trim(label)) ORDER BY source_rank DESC, ord DESC, sub DESC) = 1) t
    ON t.session_id = w.session_id AND t.k = w.k)"""


_COMMON = "session_id, source_rank, ord, sub, id, type, label"
EARLIER = ("main_nodes", "endpoints", "entities", "services", "externals")
_EARLIER_CTES = (*BASE, *MAIN, *ENDPOINTS, *ENTITIES, *SERVICES, *EXTERNALS)
_add("feature_uses", ("source_files", "model_responses", "feature_responses"), "SELECT * FROM uses", *_EARLIER_CTES,
     "earlier AS (" + " UNION ALL ".join(f"SELECT {_COMMON} FROM {t}" for t in EARLIER) + ")", *FEATURES, _uses("earlier"))
_add("union_findings", ("source_files", "model_responses", "feature_responses"),
     " UNION ALL ".join(f"SELECT {_COMMON} FROM {t}" for t in (*EARLIER, "features")), *_EARLIER_CTES, *FEATURES)

# --- resolution --------------------------------------------------------------------

DEDUPED = """keyed AS (SELECT *, lower(trim(label)) AS k FROM nodes),
deduped AS (
  SELECT a.session_id, a.ord, a.id, a.type, b.label, b.confidence FROM
    (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY session_id, type, k ORDER BY ord) = 1) a
  JOIN (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY session_id, type, k ORDER BY confidence DESC, ord) = 1) b
    ON a.session_id = b.session_id AND a.type = b.type AND a.k = b.k)"""
ID_MAP = """id_map AS (SELECT session_id, id, first_value(id) OVER (PARTITION BY session_id, type, lower(trim(label)) ORDER BY ord) AS survivor_id FROM nodes)"""
REMAPPED = """remapped AS (
  SELECT session_id, ord, source, target, relationship_type FROM (
    SELECT e.session_id, e.ord, coalesce(s.survivor_id, e.source) AS source, coalesce(t.survivor_id, e.target) AS target, e.relationship_type
    FROM edges e LEFT JOIN id_map s ON s.session_id = e.session_id AND s.id = e.source
    LEFT JOIN id_map t ON t.session_id = e.session_id AND t.id = e.target)
  WHERE source <> target QUALIFY row_number() OVER (PARTITION BY session_id, source, target, relationship_type ORDER BY ord) = 1)"""
_add("dedupe_nodes", ("nodes",), "SELECT * FROM deduped", DEDUPED)
_add("node_id_map", ("nodes",), "SELECT * FROM id_map", ID_MAP)
_add("remap_edges", ("edges",), "SELECT * FROM remapped", ID_MAP, REMAPPED)
_add("low_confidence", ("nodes",), "SELECT * FROM deduped WHERE confidence < 0.7", DEDUPED)
GONE = "gone AS (SELECT DISTINCT session_id, node_id FROM verdicts WHERE decision = 'remove')"
_left = "SELECT * FROM deduped d WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.session_id = d.session_id AND g.node_id = d.id)"
_add("apply_verdicts", ("nodes", "verdict_responses"), _left, DEDUPED, *VERDICTS, GONE)
_add("apply_verdicts_edges", ("edges", "verdict_responses"), """
SELECT * FROM remapped e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.session_id = e.session_id AND g.node_id IN (e.source, e.target))""",
     ID_MAP, REMAPPED, *VERDICTS, GONE)
_add("critic_summary", ("nodes", "verdict_responses"), f"""
SELECT session_id, coalesce(n, 0) AS n_verified, coalesce(m, 0) AS n_removed,
  concat('Verified ', coalesce(n, 0), ' nodes', CASE WHEN m IS NULL THEN '' ELSE concat(', removed ', m, ' low-confidence findings') END) AS message
FROM (SELECT session_id, count(*) AS n FROM ({_left}) GROUP BY 1)
FULL JOIN (SELECT session_id, count(DISTINCT CASE WHEN decision = 'remove' THEN node_id END) AS m FROM verdicts GROUP BY 1) USING (session_id)""",
     DEDUPED, *VERDICTS, GONE)

# --- layout and reports --------------------------------------------------------------

RANK = "CASE type WHEN 'feature' THEN 0 WHEN 'service' THEN 1 WHEN 'api' THEN 2 WHEN 'database' THEN 2 WHEN 'infra' THEN 3 WHEN 'external' THEN 3 ELSE 1 END"
_add("layout_columns", ("nodes",), f"""
SELECT session_id, id, rank, CAST(rank * 320 AS DOUBLE) AS x,
  CAST((row_number() OVER (PARTITION BY session_id, rank ORDER BY ord) - 1) * 130 + 40 AS DOUBLE) AS y FROM (SELECT *, {RANK} AS rank FROM deduped)""", DEDUPED)
_add("intra_column_edges", ("edges",), f"""
SELECT e.*, a.rank FROM edges e JOIN (SELECT *, {RANK} AS rank FROM nodes) a ON a.session_id = e.session_id AND a.id = e.source
JOIN (SELECT *, {RANK} AS rank FROM nodes) b ON b.session_id = e.session_id AND b.id = e.target WHERE a.rank = b.rank""")
_add("node_degree", ("edges",), """
SELECT session_id, id, o AS out_degree, i AS in_degree, o + i AS degree FROM (
  SELECT session_id, id, (SELECT count(*) FROM edges e WHERE e.session_id = n.session_id AND e.source = n.id) AS o,
    (SELECT count(*) FROM edges e WHERE e.session_id = n.session_id AND e.target = n.id) AS i FROM nodes n)""")
_add("finding_counts", ("edges",), """
SELECT session_id, 'node' AS what, CASE WHEN grouping(type) = 1 THEN '(all)' ELSE type END AS kind, count(*) AS n FROM nodes GROUP BY GROUPING SETS ((session_id, type), (session_id))
UNION ALL
SELECT session_id, 'edge', CASE WHEN grouping(relationship_type) = 1 THEN '(all)' ELSE relationship_type END, count(*) FROM edges
GROUP BY GROUPING SETS ((session_id, relationship_type), (session_id))""")
_add("entity_rows", ("typed_nodes",), """
SELECT id AS uuid, session_id AS group_id, label AS name, concat(type, ': ', label, ' (', agent_source, ')') AS summary FROM typed_nodes""")
_field_names = "array_to_string([concat('f', i) FOR i IN range(1, n_fields + 1)], ', ')"
_keys = "array_to_string([concat('KEY', i) FOR i IN range(1, n_keys + 1)], ', ')"
FACTS = f"""node_facts AS (
  SELECT session_id AS group_id, id AS uuid, label AS name, CASE type
    WHEN 'api' THEN concat('API endpoint: ', method, ' ', coalesce(route, '/'), ' — handler: h', size, ', auth required: ', flag, ', file: ', file_path)
    WHEN 'database' THEN concat('Database model: ', name, ' (', orm, ', ', db_type, ') with fields: ', {_field_names}, ' — file: ', file_path)
    WHEN 'service' THEN concat('Service: ', name, ' (', language, ', ', framework, ') — entry: ', file_path)
    WHEN 'feature' THEN concat('Feature: ', name, CASE WHEN route IS NULL THEN '' ELSE concat(' at route ', route) END, ' — file: ', file_path, ', auth: ', flag)
    ELSE concat('External dependency: ', brand, ' (', category, '), package: ', lower(brand), ', env keys: ', {_keys}) END AS fact
  FROM typed_nodes)"""
_add("fact_rows", ("typed_nodes",), "SELECT * FROM node_facts", FACTS)
_short = "array_to_string(string_split(file_path, '/')[-3:], '/')"
_add("node_detail", ("typed_nodes",), f"""
SELECT session_id, id, pos, field, value FROM (
  SELECT session_id, id, unnest([
    {{'pos': 0, 'field': 'Type', 'value': type}}, {{'pos': 1, 'field': 'Source', 'value': agent_source}},
    {{'pos': 2, 'field': 'Confidence', 'value': concat(CAST(floor(confidence * 100 + 0.5) AS BIGINT), '%')}},
    {{'pos': 3, 'field': 'Method', 'value': CASE WHEN type = 'api' THEN method END}},
    {{'pos': 4, 'field': 'Path', 'value': CASE WHEN type = 'api' THEN coalesce(route, '/') END}},
    {{'pos': 5, 'field': 'Handler', 'value': CASE WHEN type = 'api' THEN concat('h', size) END}},
    {{'pos': 6, 'field': 'Auth', 'value': CASE WHEN type = 'api' THEN CASE WHEN flag THEN 'Required' ELSE 'None' END END}},
    {{'pos': 7, 'field': 'Middleware', 'value': CASE WHEN type = 'api' AND flag THEN concat('cors, ', brand) END}},
    {{'pos': 8, 'field': 'File', 'value': CASE WHEN type = 'api' THEN {_short} END}},
    {{'pos': 9, 'field': 'ORM', 'value': CASE WHEN type = 'database' THEN orm END}},
    {{'pos': 10, 'field': 'DB', 'value': CASE WHEN type = 'database' THEN db_type END}},
    {{'pos': 11, 'field': 'File', 'value': CASE WHEN type = 'database' THEN {_short} END}},
    {{'pos': 12, 'field': 'Fields', 'value': CASE WHEN type = 'database' AND n_fields > 0 THEN
       concat(array_to_string([concat('f', i, ' ', CASE WHEN i % 2 = 0 THEN 'int' ELSE 'string' END) FOR i IN range(1, least(n_fields, 8) + 1)], ', '),
              CASE WHEN n_fields > 8 THEN concat(', +', n_fields - 8, ' more') ELSE '' END) END}},
    {{'pos': 13, 'field': 'Language', 'value': CASE WHEN type = 'service' THEN language END}},
    {{'pos': 14, 'field': 'Framework', 'value': CASE WHEN type = 'service' THEN framework END}},
    {{'pos': 15, 'field': 'File', 'value': CASE WHEN type = 'service' THEN {_short} END}},
    {{'pos': 16, 'field': 'Category', 'value': CASE WHEN type IN ('infra', 'external') THEN category END}},
    {{'pos': 17, 'field': 'Package', 'value': CASE WHEN type IN ('infra', 'external') THEN lower(brand) END}},
    {{'pos': 18, 'field': 'Env vars', 'value': CASE WHEN type IN ('infra', 'external') AND n_keys > 0 THEN {_keys} END}}
  ], recursive := true) FROM typed_nodes) WHERE value IS NOT NULL""")
_add("node_subtitle", ("typed_nodes",), """
SELECT session_id, id, coalesce(CASE type WHEN 'service' THEN concat_ws(' · ', nullif(language, 'unknown'), nullif(framework, 'unknown'))
    WHEN 'database' THEN concat(orm, ' · ', db_type) WHEN 'feature' THEN route WHEN 'api' THEN concat(method, ' ', coalesce(route, '/')) ELSE category END, '') AS subtitle,
  type IN ('api', 'feature') AND flag AS auth_mark FROM typed_nodes""")

_add("write_snapshot", ("edges",), """
SELECT 'node' AS what, session_id, ord, id, type AS detail FROM deduped WHERE session_id <> 3
UNION ALL SELECT 'edge', session_id, ord, source, target FROM remapped WHERE session_id NOT IN (3, 4)""", DEDUPED, ID_MAP, REMAPPED)

# --- retrieval -----------------------------------------------------------------------

TOP = r"""fact_words AS (SELECT group_id, uuid, list_filter(regexp_split_to_array(lower(fact), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM facts),
sizes AS (SELECT group_id, count(*) AS n, avg(len(words)) AS avg_len FROM fact_words GROUP BY group_id),
tf AS (SELECT group_id, uuid, size, word, count(*) AS tf FROM (SELECT group_id, uuid, len(words) AS size, unnest(words) AS word FROM fact_words) GROUP BY ALL),
df AS (SELECT group_id, word, count(*) AS df FROM tf GROUP BY ALL),
asked AS (SELECT DISTINCT group_id, question_id, word FROM (
  SELECT group_id, question_id, unnest(regexp_split_to_array(lower(question), '[^\p{L}\p{N}]+')) AS word FROM questions) WHERE word <> ''),
scored AS (SELECT a.group_id, a.question_id, t.uuid,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg_len)))), 6) AS score
  FROM asked a JOIN tf t USING (group_id, word) JOIN df USING (group_id, word) JOIN sizes s ON s.group_id = a.group_id
  GROUP BY ALL),
top AS (SELECT group_id, question_id, CAST(row_number() OVER (PARTITION BY group_id, question_id ORDER BY score DESC, uuid) AS INTEGER) AS rank, uuid, score FROM scored
  QUALIFY rank <= 10)"""
_add("search_facts", ("facts", "questions"), "SELECT * FROM top", TOP)
_add("query_context", ("facts", "questions"), """
SELECT q.group_id, q.question_id, coalesce(n, 0) AS n_facts, concat('Answer from these components only.', chr(10), coalesce(context, '[]'), chr(10), 'Question: ', question) AS prompt
FROM questions q LEFT JOIN (
  SELECT t.group_id, t.question_id, count(*) AS n,
    concat('[', string_agg(CAST(json_object('uuid', t.uuid, 'fact', f.fact) AS VARCHAR), ',' ORDER BY rank), ']') AS context
  FROM top t JOIN facts f ON f.group_id = t.group_id AND f.uuid = t.uuid GROUP BY ALL) c USING (group_id, question_id)""", TOP)
_add("vector_topk", (), """
SELECT label AS group_id, label AS question_id, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS uuid, score FROM (
  SELECT e.label, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.vector), 6) AS score FROM embeddings e JOIN (
    SELECT label, list(m ORDER BY i) AS vector FROM (
      SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i) GROUP BY ALL) GROUP BY label) c USING (label))
QUALIFY rank <= 10""")
_add("vector_neighbours", (), """
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, uuid) AS INTEGER) AS rank, uuid, score FROM (
  SELECT q.vec_id AS question_id, e.vec_id AS uuid, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
QUALIFY rank <= 10""")
_add("canned_questions", ("edges",), """
SELECT s.session_id, 'Which services touch user data?' AS question, s.id, s.label, count(*) AS weight
FROM nodes s JOIN edges e ON e.session_id = s.session_id AND e.source = s.id JOIN nodes t ON t.session_id = e.session_id AND t.id = e.target
WHERE s.type = 'service' AND t.type IN ('database', 'api') AND contains(lower(t.label), 'ring') GROUP BY ALL
UNION ALL
SELECT * FROM (SELECT n.session_id, 'What are the main API endpoints?' AS question, n.id, n.label,
    (SELECT count(*) FROM edges e WHERE e.session_id = n.session_id AND e.source = n.id) + (SELECT count(*) FROM edges e WHERE e.session_id = n.session_id AND e.target = n.id) AS weight
  FROM nodes n WHERE type = 'api') WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, id) <= 10
UNION ALL
SELECT n.session_id, 'What external services are used?', n.id, n.label, (SELECT count(*) FROM edges e WHERE e.session_id = n.session_id AND e.target = n.id)
FROM nodes n WHERE type IN ('infra', 'external')""")

# --- requests ------------------------------------------------------------------------

_host = r"regexp_extract(repo_url, '^[a-zA-Z]+://([^/?#]+)', 1)"
_valid = rf"""coalesce(({_host} = 'github.com' OR (lower({_host}) = 'github.com' AND regexp_matches(repo_url, '^https?://')))
  AND regexp_matches(regexp_extract(repo_url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '^/[\w.-]+/[\w.-]+(\.git)?$'), false)"""
_add("valid_repo_url", ("analyze_requests",), f"SELECT request_id, repo_url, {_valid} AS valid FROM analyze_requests")
_add("admit_requests", ("analyze_requests", "query_requests", "sessions"), f"""
SELECT kind, request_id, coalesce(CAST(session_id AS VARCHAR), '') AS session_id, status = 200 AS ok, status, reason FROM (
  SELECT 'analyze' AS kind, request_id, session_id,
    CASE WHEN session_id IS NULL OR repo_url IS NULL OR repo_url = '' THEN 400 WHEN session_id NOT IN (SELECT session_id FROM sessions) THEN 404 WHEN NOT {_valid} THEN 400 ELSE 200 END AS status,
    CASE WHEN session_id IS NULL OR repo_url IS NULL OR repo_url = '' THEN 'sessionId and repoUrl are required' WHEN session_id NOT IN (SELECT session_id FROM sessions) THEN 'Session not found'
      WHEN NOT {_valid} THEN 'Invalid GitHub repository URL' ELSE '' END AS reason FROM analyze_requests
  UNION ALL
  SELECT 'query', request_id, session_id,
    CASE WHEN session_id IS NULL OR question IS NULL OR question = '' THEN 400 WHEN session_id NOT IN (SELECT session_id FROM sessions) THEN 404 ELSE 200 END,
    CASE WHEN session_id IS NULL OR question IS NULL OR question = '' THEN 'sessionId and question are required' WHEN session_id NOT IN (SELECT session_id FROM sessions) THEN 'Session not found' ELSE '' END
  FROM query_requests)""")

# --- event log -----------------------------------------------------------------------

LOG = """log AS (
  SELECT *, CASE WHEN json_valid(data) THEN data END AS j,
    json_valid(data) AND event IN ('agent:update', 'node:added', 'edge:added', 'node:updated', 'analysis:complete', 'error') AS valid FROM event_log)"""


def _j(path: str) -> str:
    return f"json_extract_string(j, '$.{path}')"


_add("events_by_kind", ("event_log",), f"""
SELECT session_id, seq, event, valid,
  coalesce(CASE event WHEN 'agent:update' THEN {_j('agentName')} WHEN 'analysis:complete' THEN {_j('sessionId')} WHEN 'error' THEN {_j('message')} ELSE {_j('id')} END, '') AS subject,
  coalesce(CASE event WHEN 'agent:update' THEN {_j('status')} WHEN 'node:added' THEN {_j('type')} WHEN 'edge:added' THEN {_j('data.relationshipType')}
    WHEN 'node:updated' THEN CAST(CAST({_j('data.confidence')} AS DECIMAL(12,2)) AS VARCHAR) END, '') AS detail FROM log""", LOG)


def _last(event: str, key: str, fields: str, source: str = "log") -> str:
    return f"""SELECT session_id, {_j(key)} AS {{key}}, seq AS {{seq}}, {fields} FROM {source} WHERE valid AND event = '{event}'
  QUALIFY row_number() OVER (PARTITION BY session_id, {_j(key)} ORDER BY seq DESC) = 1"""


_NODE_FIELDS = f"{_j('type')} AS type, {_j('data.label')} AS label, CAST({_j('data.confidence')} AS DOUBLE) AS confidence"
_add("fold_nodes", ("event_log",), _last("node:added", "id", _NODE_FIELDS).format(key="id", seq="ord"), LOG)
_add("fold_edges", ("event_log",), _last(
    "edge:added", "id", f"{_j('source')} AS source, {_j('target')} AS target, {_j('data.relationshipType')} AS relationship_type").format(key="id", seq="ord"), LOG)
STATUS = "latest AS (" + _last("agent:update", "agentName", f"{_j('status')} AS status, {_j('message')} AS message").format(key="agent", seq="seq") + ")"
_add("agent_status", ("event_log",), "SELECT session_id, agent, seq, status, message FROM latest", LOG, STATUS)
_add("status_board", ("event_log", "sessions"), """
SELECT s.session_id, b.place, b.agent, b.title, coalesce(l.status, '') AS status, coalesce(l.message, '') AS message
FROM sessions s CROSS JOIN (VALUES (0, 'orchestrator', 'Orchestrator'), (1, 'planner', 'Planner'), (2, 'api', 'API Agent'), (3, 'data', 'Data Agent'),
  (4, 'service', 'Service Agent'), (5, 'infra', 'Infra Agent'), (6, 'features', 'Features Agent'), (7, 'critic', 'Critic'), (8, 'diagram', 'Layout')) b(place, agent, title)
LEFT JOIN latest l ON l.session_id = s.session_id AND l.agent = b.agent""", LOG, STATUS)
CLOSED = """closed AS (SELECT session_id, event AS outcome, seq AS close_seq, ts AS closed_at, j FROM log WHERE valid AND event IN ('analysis:complete', 'error')
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) = 1)"""
OUTCOME = f"""outcome AS (SELECT s.session_id, coalesce(c.outcome, 'open') AS outcome, c.close_seq, c.closed_at,
    CASE WHEN c.outcome = 'error' THEN {_j('message')} END AS message FROM (SELECT DISTINCT session_id FROM log) s LEFT JOIN closed c USING (session_id))"""
_add("session_outcome", ("event_log",), """
SELECT session_id, outcome, coalesce(CAST(close_seq AS VARCHAR), '') AS close_seq, coalesce(strftime(closed_at, '%Y-%m-%d %H:%M:%S'), '') AS closed_at, coalesce(message, '') AS message
FROM outcome""", LOG, CLOSED, OUTCOME)
_add("ignored_events", ("event_log",), "SELECT session_id, seq, event, close_seq FROM log JOIN closed c USING (session_id) WHERE seq > close_seq".replace(
    "event,", "log.event,"), LOG, CLOSED)
_add("session_snapshot", ("event_log",), "SELECT f.*, o.outcome FROM (" + _last(
    "node:added", "id", _NODE_FIELDS, "(SELECT l.* FROM log l JOIN outcome o USING (session_id) WHERE l.seq <= coalesce(o.close_seq, l.seq))").format(key="id", seq="ord")
    + ") f JOIN outcome o USING (session_id)", LOG, CLOSED, OUTCOME)
_add("gated_events", ("event_log",), """
SELECT l.session_id, l.seq, l.event FROM log l LEFT JOIN closed c USING (session_id) WHERE l.seq <= coalesce(c.close_seq, l.seq)""", LOG, CLOSED)
_add("streamed_nodes", ("event_log",), _last(
    "node:added", "id", _NODE_FIELDS, "(SELECT l.* FROM log l JOIN outcome o USING (session_id) WHERE l.seq <= coalesce(o.close_seq, l.seq))").format(key="id", seq="ord"),
    LOG, CLOSED, OUTCOME)
_add("patch_nodes", ("event_log",), f"""
SELECT session_id, id, max_by(type, seq) FILTER (type IS NOT NULL) AS type, max_by(label, seq) FILTER (label IS NOT NULL) AS label,
  max_by(confidence, seq) FILTER (confidence IS NOT NULL) AS confidence, count(*) FILTER (event = 'node:updated') AS n_patches
FROM (SELECT session_id, seq, event, {_j('id')} AS id, {_NODE_FIELDS} FROM log WHERE valid AND event IN ('node:added', 'node:updated'))
GROUP BY session_id, id HAVING count(*) FILTER (event = 'node:added') > 0""", LOG)
_add("session_status", ("event_log",), """
SELECT session_id, CASE outcome WHEN 'analysis:complete' THEN 'complete' WHEN 'error' THEN 'error' ELSE CASE WHEN n_run > 0 THEN 'running' ELSE 'pending' END END AS status,
  strftime(t0, '%Y-%m-%d %H:%M:%S') AS created_at, coalesce(strftime(closed_at, '%Y-%m-%d %H:%M:%S'), '') AS completed_at, coalesce(message, '') AS error_message
FROM outcome JOIN (SELECT session_id, min(ts) AS t0, count(*) FILTER (event = 'agent:update') AS n_run FROM log GROUP BY 1) USING (session_id)""", LOG, CLOSED, OUTCOME)
_add("event_windows", ("event_log",), """
SELECT window_kind, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, event, count(*) AS n FROM (
  SELECT 'tumbling' AS window_kind, time_bucket(INTERVAL 1 HOUR, ts) AS w, event FROM event_log
  UNION ALL SELECT 'sliding', time_bucket(INTERVAL 30 MINUTE, ts), event FROM event_log
  UNION ALL SELECT 'sliding', time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, event FROM event_log) GROUP BY ALL""")
_add("session_windows", ("event_log",), """
SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS burst_start, strftime(max(ts) + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS burst_end, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, seq) AS burst FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, seq) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM event_log))
GROUP BY session_id, burst""")
_add("dedupe_events", ("event_log",), "SELECT session_id, min(seq) AS seq, event, data FROM event_log GROUP BY session_id, event, data")
FRAMES = """frame_lines AS (
  SELECT l.stream_id, c.chunk, CAST(l.i - 1 - c.feeds AS INTEGER) AS pos, l.line
  FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY stream_id ORDER BY i) - length(line) - 1 AS start FROM (
      SELECT stream_id, i, all_lines[i] AS line, len(all_lines) AS n FROM (
        SELECT stream_id, string_split(string_agg(text, '' ORDER BY chunk), chr(10)) AS all_lines FROM raw_frames GROUP BY stream_id),
      unnest(range(1, len(all_lines) + 1)) t(i))) l
  JOIN (SELECT stream_id, chunk, length(text) AS size, sum(length(text)) OVER before AS done,
      coalesce(sum(length(text) - length(replace(text, chr(10), ''))) OVER before - (length(text) - length(replace(text, chr(10), ''))), 0) AS feeds
    FROM raw_frames WINDOW before AS (PARTITION BY stream_id ORDER BY chunk)) c
    ON c.stream_id = l.stream_id AND l.start >= c.done - c.size AND l.start < c.done
  WHERE l.i < l.n AND l.line <> ''),
ends AS (SELECT stream_id, min(chunk * 1000000 + pos) AS stop FROM frame_lines WHERE line = 'data: [DONE]' GROUP BY stream_id),
frames AS (SELECT f.stream_id, chunk, pos, json_extract_string(CASE WHEN json_valid(line[7:]) THEN line[7:] END, '$.text') AS text
  FROM frame_lines f LEFT JOIN ends e ON e.stream_id = f.stream_id
  WHERE starts_with(line, 'data: ') AND (e.stop IS NULL OR chunk * 1000000 + pos < e.stop))"""
_add("decode_frames", ("raw_frames",), "SELECT * FROM frames WHERE text IS NOT NULL", FRAMES)
_add("reassemble_stream", ("raw_frames",), """
SELECT stream_id, part, string_agg(text, '' ORDER BY chunk, pos) AS text FROM (
  SELECT *, CAST(sum(length(text) + 1024) OVER (PARTITION BY stream_id ORDER BY chunk, pos) - length(text) - 1024 AS BIGINT) // 1048576 AS part
  FROM frames WHERE text IS NOT NULL) GROUP BY stream_id, part""", FRAMES)
_add("drop_groups", ("typed_nodes", "event_log"), """
SELECT * FROM node_facts WHERE group_id NOT IN (SELECT session_id FROM outcome WHERE outcome = 'error')""", FACTS, LOG, CLOSED, OUTCOME)

ORACLES["streamed_bursts"] = ORACLES["session_windows"]
ORACLES["search_index"] = ORACLES["search_facts"]
ORACLES["index_context"] = ORACLES["query_context"]

# --- everything together ---------------------------------------------------------------

ALL_VIEWS = ("source_files", "model_responses", "feature_responses")
EARLIER = "earlier AS (" + " UNION ALL ".join(
    f"SELECT {_COMMON}, confidence, agent_source FROM {t}" for t in ("main_nodes", "endpoints", "entities", "services", "externals")) + ")"
SYSTEM = (*BASE, FRAMEWORK, PROFILE, _main(), *ENDPOINTS, *ENTITIES, *SERVICES, *EXTERNALS, *FEATURES, EARLIER,
          f"every_node AS (SELECT *, lower(trim(label)) AS k FROM earlier UNION ALL SELECT {_COMMON}, confidence, agent_source, lower(trim(label)) FROM features)")
SYSTEM_DEDUPED = """survivors AS (
  SELECT a.session_id, a.source_rank, a.ord, a.sub, a.id, a.type, b.label, b.confidence, b.agent_source FROM
    (SELECT * FROM every_node QUALIFY row_number() OVER (PARTITION BY session_id, type, k ORDER BY source_rank, ord, sub) = 1) a
  JOIN (SELECT * FROM every_node QUALIFY row_number() OVER (PARTITION BY session_id, type, k ORDER BY confidence DESC, source_rank, ord, sub) = 1) b
    ON a.session_id = b.session_id AND a.type = b.type AND a.k = b.k)"""
_add("system_nodes", ALL_VIEWS, f"""
SELECT session_id, id, type, label, confidence, agent_source, CAST(rank * 320 AS DOUBLE) AS x,
  CAST((row_number() OVER (PARTITION BY session_id, rank ORDER BY source_rank, ord, sub) - 1) * 130 + 40 AS DOUBLE) AS y
FROM (SELECT *, {RANK} AS rank FROM survivors)""", *SYSTEM, SYSTEM_DEDUPED)


def _raw_star(nodes: str, rank: int, type_: str, rel: str) -> str:
    return f"SELECT n.session_id, {rank} AS source_rank, n.ord, n.sub, m.id AS source, n.id AS target, '{type_}' AS type, '{rel}' AS label, '{rel}' AS rel FROM {nodes} n JOIN main_nodes m USING (session_id)"


_add("system_edges", ALL_VIEWS, """
SELECT session_id, source, target, type, label, rel AS relationship_type FROM (
  SELECT e.* REPLACE (coalesce(s.sid, e.source) AS source, coalesce(t.sid, e.target) AS target) FROM every_edge e
  LEFT JOIN sys_map s ON s.session_id = e.session_id AND s.id = e.source LEFT JOIN sys_map t ON t.session_id = e.session_id AND t.id = e.target)
WHERE source <> target QUALIFY row_number() OVER (PARTITION BY session_id, source, target, rel ORDER BY source_rank, ord, sub) = 1""",
     *SYSTEM, LAST_NAMED, SERVICE_DEPS, _uses("earlier"), "every_edge AS (" + " UNION ALL ".join([
         _raw_star("endpoints", 1, "dependency", "HANDLES"), _raw_star("services", 3, "dependency", "DEPENDS_ON"),
         "SELECT session_id, 3, ord, sub, source, target, 'dependency', 'DEPENDS_ON', 'DEPENDS_ON' FROM service_deps",
         _raw_star("externals", 4, "dataFlow", "CONNECTS_TO"),
         "SELECT session_id, 5, ord, sub, source, target, 'dependency', 'USES', 'DEPENDS_ON' FROM uses"]) + ")",
     "sys_map AS (SELECT session_id, id, first_value(id) OVER (PARTITION BY session_id, type, k ORDER BY source_rank, ord, sub) AS sid FROM every_node)")

ORACLES["system_related"] = ORACLES["relates_to_resolved"]

# The same with endpoint, entity, external and plan answers, and with a review that removes ids that start with 0.
ANSWERED = "1099511627776"      # 2**40
RECORDS = tuple(_array(f"{kind}_responses", more).replace("rec AS", f"{kind}_rec AS") for kind, more in (
    ("endpoint", ", file_path"), ("entity", ", file_path"), ("external", "")))
_later = f"{BIG} + ord AS ord, {ANSWERED} + sub AS sub"
ALL_ENDPOINTS = (ROUTES, _nodes("endpoints", f"""(
    SELECT repo_id AS session_id, ord, CAST(rule_rank AS BIGINT) * {LIST} + match_pos AS sub, path AS file_path, value FROM routes
    UNION ALL SELECT session_id, {_later}, file_path, concat_ws(' ', {_s('method')}, {_s('path')}) FROM endpoint_rec)""",
    "api", 1, "'api'", "value", "file_path", "0.85", ", file_path"))
ALL_ENTITIES = (MODELS, _nodes("entities", f"""(
    SELECT repo_id AS session_id, ord, CAST(rule_rank AS BIGINT) * {LIST} + match_pos AS sub, path AS file_path, value FROM models
    UNION ALL SELECT session_id, {_later}, file_path, {_s('name')} FROM entity_rec WHERE {_s('name')} IS NOT NULL)""",
    "data", 2, "'database'", "value", "file_path", "0.9", ", file_path"))
ALL_EXTERNALS = (ENV, *SDK, _nodes("externals", f"""(
    SELECT repo_id AS session_id, CASE WHEN in_config THEN 0 ELSE {BIG} END + ord AS ord, CAST(rule_rank AS BIGINT) AS sub, name, category FROM sdks
    UNION ALL SELECT session_id, {_later}, name, category FROM (
      SELECT session_id, ord, sub, {_s('name')} AS name, {_s('category')} AS category FROM external_rec WHERE {_s('name')} IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY session_id, name ORDER BY ord, sub) = 1) e
    WHERE NOT EXISTS (SELECT 1 FROM sdks s WHERE s.repo_id = e.session_id AND s.name = e.name))""",
    "infra", 4, "CASE WHEN category IN ('queue', 'cloud') THEN 'infra' ELSE 'external' END", "name", "''", "0.85"))
ENTRIES = """entries AS (SELECT session_id, path AS entry FROM plans WHERE role = 'entry'
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord, pos) = 1)"""
REVIEWED = (*BASE, FRAMEWORK, PROFILE, *PLANS, ENTRIES, _main("entry"), *RECORDS, *ALL_ENDPOINTS, *ALL_ENTITIES, *SERVICES,
            *ALL_EXTERNALS, *FEATURES, *SYSTEM[-2:], SYSTEM_DEDUPED)
REVIEWED_VIEWS = (*ALL_VIEWS, "endpoint_responses", "entity_responses", "external_responses", "plan_responses")
_add("reviewed_nodes", REVIEWED_VIEWS, f"""
SELECT session_id, id, type, label, confidence, agent_source, CAST(rank * 320 AS DOUBLE) AS x,
  CAST((row_number() OVER (PARTITION BY session_id, rank ORDER BY source_rank, ord, sub) - 1) * 130 + 40 AS DOUBLE) AS y
FROM (SELECT *, {RANK} AS rank FROM survivors WHERE NOT starts_with(id, '0'))""", *REVIEWED)
_add("reviewed_edges", REVIEWED_VIEWS, """
SELECT session_id, source, target, type, label, rel AS relationship_type FROM (
  SELECT e.* REPLACE (coalesce(s.sid, e.source) AS source, coalesce(t.sid, e.target) AS target) FROM every_edge e
  LEFT JOIN sys_map s ON s.session_id = e.session_id AND s.id = e.source LEFT JOIN sys_map t ON t.session_id = e.session_id AND t.id = e.target)
WHERE source <> target AND NOT starts_with(source, '0') AND NOT starts_with(target, '0')
QUALIFY row_number() OVER (PARTITION BY session_id, source, target, rel ORDER BY source_rank, ord, sub) = 1""",
     *REVIEWED, LAST_NAMED, SERVICE_DEPS, _uses("earlier"), "every_edge AS (" + " UNION ALL ".join([
         _raw_star("endpoints", 1, "dependency", "HANDLES"), _raw_star("services", 3, "dependency", "DEPENDS_ON"),
         "SELECT session_id, 3, ord, sub, source, target, 'dependency', 'DEPENDS_ON', 'DEPENDS_ON' FROM service_deps",
         _raw_star("externals", 4, "dataFlow", "CONNECTS_TO"),
         "SELECT session_id, 5, ord, sub, source, target, 'dependency', 'USES', 'DEPENDS_ON' FROM uses"]) + ")",
     "sys_map AS (SELECT session_id, id, first_value(id) OVER (PARTITION BY session_id, type, k ORDER BY source_rank, ord, sub) AS sid FROM every_node)")
_add("reviewed_related", REVIEWED_VIEWS, """
SELECT session_id, source, first_place, last_place,
  (SELECT count(*) FROM surv b WHERE b.session_id = a.session_id AND b.source <> a.source AND b.last_place > a.first_place) AS n_targets FROM surv a""",
     *REVIEWED, "placed AS (SELECT session_id, lower(trim(label)) AS k, id, row_number() OVER (PARTITION BY session_id ORDER BY ord, sub) AS place FROM entities)",
     """surv AS (SELECT * FROM (SELECT session_id, k, arg_min(id, place) AS source, min(place) AS first_place, max(place) AS last_place
  FROM placed GROUP BY session_id, k) WHERE NOT starts_with(source, '0'))""")

# A trailing WITH list in the body (it starts with a comma) continues the head.
for _name, _text in list(ORACLES.items()):
    ORACLES[_name] = _text.replace("\n\n,", ",\n").replace("\n,", ",\n") if "\n," in _text else _text
