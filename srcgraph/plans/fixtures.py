"""The given tables seen as the records this library works on.

Portable SQL: the same text runs in Spark and in the engine used as oracle, so both
sides start from equal rows. Every view covers its whole table and whole texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "documents", "embeddings", "events", "benchmark", "conversations", "labels", "orders",
          "pages", "part")

VIEWS: dict[str, str] = {
    "source_files": """
  SELECT doc_id % 20 AS repo_id, doc_id AS ord,
    concat('/', CASE WHEN doc_id % 40 = 6 THEN concat('d', CAST(doc_id AS VARCHAR(20)), '/prisma/') WHEN doc_id % 8 = 0 THEN 'src/routes/' WHEN doc_id % 8 = 1 THEN 'src/models/' WHEN doc_id % 8 = 2 THEN 'src/pages/'
                     WHEN doc_id % 8 = 3 THEN 'node_modules/x/' WHEN doc_id % 8 = 4 THEN '.cache/' ELSE 'src/' END,
           CASE WHEN doc_id % 40 = 6 THEN 'schema.prisma' WHEN doc_id % 13 = 0 THEN 'package.json' WHEN doc_id % 8 = 1 THEN concat('user_model', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 3 = 0 THEN '.py' WHEN doc_id % 3 = 1 THEN '.prisma' ELSE '.ts' END)
                WHEN doc_id % 8 = 2 THEN concat('Home', CAST(doc_id AS VARCHAR(20)), 'Page.tsx')
                WHEN doc_id % 16 = 5 THEN concat('f', CAST(doc_id AS VARCHAR(20)), 'App.tsx')
                ELSE concat('f', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 5 = 0 THEN '.ts' WHEN doc_id % 5 = 1 THEN '.PY' WHEN doc_id % 5 = 2 THEN '.go' WHEN doc_id % 5 = 3 THEN '.mjs' ELSE '.md' END) END) AS path,
    concat(
      CASE WHEN doc_id % 20 = 13 THEN concat('process.env.FLAG_', CAST(doc_id % 9 AS VARCHAR(20)), chr(10), 'process.env.PLAIN_FLAG')
           WHEN doc_id % 7 = 0 THEN concat('const app = make()', chr(10), 'app.get(', chr(39), '/v', CAST(doc_id % 9 AS VARCHAR(20)), chr(39), ', h)', chr(10), 'router.post( "/p")', chr(10), 'export async function GET(){}')
           WHEN doc_id % 7 = 1 THEN concat('from flask import Flask', chr(10), '@app.get("/d', CAST(doc_id % 9 AS VARCHAR(20)), '")', chr(10), 'class User(Base):', chr(10), 'os.environ.get("REDIS_URL")', chr(10), 'os.environ["MISSED"]')
           WHEN doc_id % 7 = 2 THEN concat('http.HandleFunc("/h")', chr(10), 'r.GET("/g")', chr(10), 'os.Getenv("STRIPE_KEY")')
           WHEN doc_id % 7 = 3 THEN concat('model M', CAST(doc_id % 17 AS VARCHAR(20)), ' {', chr(10), 'class S extends Model', chr(10), '@Entity("t") export class T', CAST(doc_id % 5 AS VARCHAR(20)), ' {}', chr(10), 'new Schema({', chr(10), 'new Schema(')
           WHEN doc_id % 7 = 4 THEN concat('import stripe from ', chr(39), 'stripe', chr(39), chr(10), 'import { a } from "./local"', chr(10), 'const x = require("ioredis")', chr(10), 'process.env.STRIPE_KEY + process.env.STRIPE_KEY + process.env.AWS_REGION')
           WHEN doc_id % 7 = 5 THEN concat('<Route path="/r', CAST(doc_id % 9 AS VARCHAR(20)), '" />', chr(10), 'process.env.PLAIN_FLAG')
           ELSE '' END,
      chr(10), CASE (doc_id % 20) % 8 WHEN 0 THEN 'from fastapi import FastAPI' WHEN 1 THEN concat('import n from ', chr(39), 'next', chr(39)) WHEN 2 THEN 'const e = express()'
           WHEN 3 THEN 'g := gin.New()' WHEN 4 THEN 'NestFactory.create(A)' WHEN 5 THEN 'express() and gin.Default()' ELSE '' END,
      chr(10), text) AS content
  FROM documents""",
    "sse_events": """
  SELECT user_id AS session_id, event_id AS seq, ts,
    CASE WHEN event_type = 'error' AND event_id % 97 = 0 THEN 'error' WHEN event_type IN ('signup','error') THEN 'agent:update'
         WHEN event_type = 'click' THEN 'node:added' WHEN event_type = 'view' THEN 'edge:added'
         WHEN event_id % 101 = 0 THEN 'analysis:complete' ELSE 'node:updated' END AS event,
    CASE WHEN event_id % 9 = 0 THEN 'orchestrator' WHEN event_id % 9 = 1 THEN 'planner' WHEN event_id % 9 = 2 THEN 'api' WHEN event_id % 9 = 3 THEN 'data'
         WHEN event_id % 9 = 4 THEN 'service' WHEN event_id % 9 = 5 THEN 'infra' WHEN event_id % 9 = 6 THEN 'features' WHEN event_id % 9 = 7 THEN 'critic' ELSE 'diagram' END AS agent_name,
    CASE WHEN event_type = 'signup' THEN 'running' ELSE 'complete' END AS status,
    concat('e', CAST(event_id % 40 AS VARCHAR(20))) AS entity_id, value
  FROM events""",
    "event_log": """
  SELECT session_id, seq, ts, event,
    CASE WHEN seq % 211 = 7 THEN '{"id": bad'
         WHEN event = 'agent:update' THEN concat('{"agentName":"', agent_name, '","status":"', status, '","message":"step ', CAST(seq AS VARCHAR(20)), '"}')
         WHEN event = 'node:added' THEN concat('{"id":"', entity_id, '","type":"', CASE seq % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'service' ELSE 'database' END,
              '","data":{"label":"Node ', CAST(seq % 13 AS VARCHAR(20)), '","confidence":', CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR(20)), ',"agentSource":"', agent_name, '"}}')
         WHEN event = 'edge:added' THEN concat('{"id":"x', CAST(seq % 60 AS VARCHAR(20)), '","source":"', entity_id, '","target":"e', CAST(seq % 7 AS VARCHAR(20)),
              '","type":"dependency","animated":false,"data":{"relationshipType":"', CASE seq % 2 WHEN 0 THEN 'HANDLES' ELSE 'DEPENDS_ON' END, '","direction":"unidirectional"}}')
         WHEN event = 'node:updated' THEN concat('{"id":"', entity_id, '","data":{', CASE WHEN seq % 2 = 0 THEN concat('"label":"Patched ', CAST(seq AS VARCHAR(20)), '"') ELSE concat('"confidence":', CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR(20))) END, '}}')
         WHEN event = 'analysis:complete' THEN concat('{"nodes":[],"edges":[],"sessionId":"', CAST(session_id AS VARCHAR(20)), '"}')
         ELSE concat('{"message":"failed at ', CAST(seq AS VARCHAR(20)), '"}') END AS data
  FROM sse_events""",
    "nodes": """
  SELECT p_size % 10 AS session_id, p_partkey AS ord, concat('n', CAST(p_partkey AS VARCHAR(20))) AS id,
    CASE p_type WHEN 'ECONOMY' THEN 'service' WHEN 'LARGE' THEN 'api' WHEN 'MEDIUM' THEN 'database' WHEN 'PROMO' THEN 'infra' WHEN 'SMALL' THEN 'external' ELSE 'feature' END AS type,
    CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN concat('  ', p_name, ' ') ELSE p_name END AS label,
    CAST(50 + (p_partkey * 7) % 51 AS DOUBLE) / 100 AS confidence
  FROM part""",
    "typed_nodes": """
  SELECT n.session_id, n.ord, n.id, n.type, n.label, n.confidence,
    CASE n.type WHEN 'service' THEN 'service' WHEN 'api' THEN 'api' WHEN 'database' THEN 'data' WHEN 'feature' THEN 'features' ELSE 'infra' END AS agent_source,
    p.p_name AS name, p.p_brand AS brand, p.p_size AS size,
    CASE n.ord % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'typescript' ELSE 'python' END AS language,
    CASE n.ord % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'express' ELSE 'fastapi' END AS framework,
    concat('/src/a', CAST(n.ord % 5 AS VARCHAR(20)), '/b', CAST(n.ord % 7 AS VARCHAR(20)), '/c/f', CAST(n.ord AS VARCHAR(20)), '.ts') AS file_path,
    CASE n.ord % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' ELSE 'PATCH' END AS method,
    n.ord % 2 = 0 AS flag,
    CASE WHEN n.ord % 6 = 0 THEN CAST(NULL AS VARCHAR(20)) ELSE concat('/r', CAST(n.ord % 11 AS VARCHAR(20))) END AS route,
    CASE n.ord % 3 WHEN 0 THEN 'prisma' WHEN 1 THEN 'typeorm' ELSE 'raw' END AS orm,
    CASE n.ord % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mysql' ELSE 'unknown' END AS db_type,
    CASE n.type WHEN 'infra' THEN 'cloud' ELSE 'payment' END AS category,
    n.ord % 12 AS n_fields, n.ord % 3 AS n_keys
  FROM nodes n JOIN part p ON p.p_partkey = n.ord""",
    "edges": """
  SELECT n.session_id, o.o_orderkey AS ord, n.id AS source, m.id AS target,
    CASE o.o_orderstatus WHEN 'O' THEN 'HANDLES' WHEN 'F' THEN 'DEPENDS_ON' ELSE 'CONNECTS_TO' END AS relationship_type
  FROM orders o JOIN nodes n ON n.ord = o.o_custkey JOIN nodes m ON m.ord = o.o_orderkey * 7 % (SELECT count(*) FROM part)
  WHERE n.session_id = m.session_id""",
    "model_responses": """
  SELECT doc_id % 20 AS session_id, doc_id AS ord,
    CASE WHEN doc_id % 11 = 0 THEN 'no findings [oops' WHEN doc_id % 11 = 1 THEN '[]'
      ELSE concat(replace(replace(coalesce(text, ''), '[', '('), ']', ')'), chr(10), '[3,{"name":"S', CAST(doc_id % 37 AS VARCHAR(20)), '","filePath":"/s', CAST(doc_id AS VARCHAR(20)), '","dependsOn":["S', CAST((doc_id * 3) % 41 AS VARCHAR(20)), '","S', CAST(doc_id % 37 AS VARCHAR(20)), '"]},null,"plain",["list"]]', chr(10), 'done') END AS text
  FROM documents""",
    "endpoint_responses": """
  SELECT doc_id % 20 AS session_id, doc_id AS ord, concat('/api/f', CAST(doc_id AS VARCHAR(20)), '.ts') AS file_path,
    CASE WHEN doc_id % 10 = 0 THEN 'nothing here' WHEN doc_id % 10 = 1 THEN 'text [1] and [2] more'
      ELSE concat('[{"method":"GET","path":"/d', CAST(doc_id % 23 AS VARCHAR(20)), '","handlerName":"h', CAST(doc_id % 5 AS VARCHAR(20)), '","authRequired":', CASE doc_id % 2 WHEN 0 THEN 'true' ELSE 'false' END, ',"middlewares":["cors","m', CAST(doc_id % 3 AS VARCHAR(20)),
                  '"]},{"method":"POST","path":"/d', CAST(doc_id % 23 AS VARCHAR(20)), '","handlerName":"p"}]') END AS text
  FROM documents""",
    "entity_responses": """
  SELECT doc_id % 20 AS session_id, doc_id AS ord, concat('/db/f', CAST(doc_id AS VARCHAR(20)), '.ts') AS file_path,
    CASE WHEN doc_id % 9 = 0 THEN '[{"name":' WHEN doc_id % 9 = 1 THEN '[]'
      ELSE concat(replace(replace(coalesce(text, ''), '[', '('), ']', ')'), ' Found ', '[true,{"name":"T', CAST(doc_id % 29 AS VARCHAR(20)), '","dbType":"postgres","orm":"prisma","fields":[{"name":"id","type":"int","nullable":false},{"name":"c', CAST(doc_id % 4 AS VARCHAR(20)), '","type":"string","nullable":true}]}',
         CASE WHEN doc_id % 3 = 0 THEN concat(',{"name":"U', CAST(doc_id % 31 AS VARCHAR(20)), '","dbType":"mongodb","orm":"mongoose","fields":[]}') ELSE '' END, ']') END AS text
  FROM documents""",
    "external_responses": """
  SELECT doc_id % 20 AS session_id, doc_id AS ord,
    CASE WHEN doc_id % 8 = 0 THEN '[]'
      ELSE concat('[{"name":"Svc', CAST(doc_id % 6 AS VARCHAR(20)), '","category":"', CASE doc_id % 3 WHEN 0 THEN 'queue' WHEN 1 THEN 'cloud' ELSE 'auth' END, '","envKeys":["K', CAST(doc_id % 5 AS VARCHAR(20)), '"],"sdkPackage":"svc-', CAST(doc_id % 6 AS VARCHAR(20)), '"}]') END AS text
  FROM documents""",
    "feature_responses": """
  SELECT doc_id % 20 AS session_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS pass, doc_id AS ord, concat('/src/pages/P', CAST(doc_id AS VARCHAR(20)), '.tsx') AS file_path,
    CASE WHEN doc_id % 10 = 3 THEN 'no screen'
      ELSE concat('[{"name":"', CASE doc_id % 3 WHEN 0 THEN ' Login ' WHEN 1 THEN 'LOGIN ' ELSE 'Home ' END, CAST(doc_id % 14 AS VARCHAR(20)), '","route":', CASE WHEN doc_id % 4 = 0 THEN 'null' ELSE concat('"/l', CAST(doc_id % 14 AS VARCHAR(20)), '"') END,
         ',"usesServices":["s', CAST(doc_id % 37 AS VARCHAR(20)), ' ","Missing"]', CASE WHEN doc_id % 2 = 0 THEN ',"usesAuth":true,"confidence":0.65' ELSE '' END, '},{"name":""}]') END AS text
  FROM documents""",
    "verdict_responses": """
  SELECT n.session_id, l.doc_id AS ord,
    CASE WHEN l.doc_id % 13 = 0 THEN 'I cannot decide {'
      ELSE concat('Verdict: {"keep": ["n', CAST(l.doc_id + 1 AS VARCHAR(20)), '"], "remove": [', CASE WHEN l.toxic = 1 OR l.quality = 0 THEN concat('"n', CAST(l.doc_id AS VARCHAR(20)), '"') ELSE '' END, ']} ok') END AS text
  FROM labels l JOIN nodes n ON n.ord = l.doc_id""",
    "plan_responses": """
  SELECT doc_id % 20 AS session_id, doc_id AS ord,
    CASE WHEN doc_id % 6 = 0 THEN 'sorry' WHEN doc_id % 6 = 1 THEN '{"routeFiles": ["/a"]'
      ELSE concat('Here: {"entryPoints": ["/main', CAST(doc_id AS VARCHAR(20)), '.ts"], "routeFiles": ["/r', CAST(doc_id AS VARCHAR(20)), '.ts", "/q.ts"], "modelFiles": []}') END AS text
  FROM documents""",
    "planner_answers": """
  SELECT repo_id AS session_id, ord,
    CASE WHEN ord % 9 = 4 THEN 'no plan' ELSE concat('Plan: {"entryPoints": [], "routeFiles": ["', path, '", "/gone.ts"], "modelFiles": ["', CASE WHEN ord % 2 = 0 THEN path ELSE substring(path, 2, 200) END, '"]} done') END AS text
  FROM source_files WHERE ord % 3 = 1 AND repo_id % 4 <> 2""",
    "raw_frames": """
  SELECT conv_id AS stream_id, turn AS chunk,
    CASE WHEN turn % 7 = 4 THEN ' chunks and' ELSE concat(CASE WHEN turn % 7 = 2 THEN concat('lit"}', chr(10)) WHEN turn % 7 = 5 THEN concat(' ends"}', chr(10)) ELSE '' END,
      'event: message', chr(10), 'data: {"text":"', replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), '"', concat(chr(92), '"')), chr(10), concat(chr(92), 'n')), '"}', chr(10), chr(10),
      CASE WHEN turn % 4 = 1 THEN concat('data: {bad', chr(10), 'junk', chr(10), 'data: {"other":1}', chr(10)) ELSE '' END,
      CASE WHEN turn % 3 = 2 AND conv_id % 2 = 0 THEN concat('data: [DONE]', chr(10)) ELSE '' END,
      'data: {"text":"cut off"}', chr(10), CASE WHEN turn % 7 = 1 THEN 'data: {"text":"sp' WHEN turn % 7 = 3 THEN 'data: {"text":"three' WHEN turn % 5 = 4 THEN 'data: {"text":"un' ELSE '' END) END AS text
  FROM conversations""",
    "facts": """
  SELECT source AS group_id, concat('f', CAST(doc_id AS VARCHAR(20))) AS uuid, text AS fact FROM documents""",
    "questions": """
  SELECT concat('src', CAST(item_id % 20 AS VARCHAR(20))) AS group_id, item_id AS question_id, text AS question FROM benchmark""",
    "sessions": """
  SELECT DISTINCT user_id AS session_id FROM events""",
    "analyze_requests": """
  SELECT page_id AS request_id, CASE WHEN page_id % 9 = 0 THEN CAST(NULL AS BIGINT) ELSE page_id % 150 END AS session_id,
    CASE WHEN page_id % 10 = 0 THEN '' WHEN page_id % 10 = 1 THEN concat('git@github.com:a/b', CAST(page_id AS VARCHAR(20))) WHEN page_id % 10 = 2 THEN url
         WHEN page_id % 10 = 3 THEN concat('https://GitHub.com/a.b/c-', CAST(page_id AS VARCHAR(20)), '.git?x=1#y') WHEN page_id % 10 = 4 THEN concat('ssh://github.com/o/r', CAST(page_id AS VARCHAR(20)))
         WHEN page_id % 10 = 5 THEN concat('https://www.github.com/o/r', CAST(page_id AS VARCHAR(20))) WHEN page_id % 10 = 6 THEN concat('https://github.com/o/r', CAST(page_id AS VARCHAR(20)), '/')
         ELSE concat('https://github.com/o', CAST(page_id % 7 AS VARCHAR(20)), '/r', CAST(page_id AS VARCHAR(20))) END AS repo_url
  FROM pages""",
    "query_requests": """
  SELECT item_id AS request_id, CASE WHEN item_id % 7 = 0 THEN CAST(NULL AS BIGINT) ELSE item_id * 5 END AS session_id,
    CASE WHEN item_id % 5 = 0 THEN '' ELSE text END AS question
  FROM benchmark""",
}

# Views that a view reads.
NEEDS = {
    "event_log": ("sse_events",),
    "typed_nodes": ("nodes",),
    "edges": ("nodes",),
    "verdict_responses": ("nodes",),
    "planner_answers": ("source_files",),
}


def with_clause(*names: str) -> str:
    """`name AS (…)` list of the views and all they need, for a WITH clause."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    return ",\n".join(f"{name} AS ({VIEWS[name]})" for name in wanted)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table read in fewer pieces than there are cores, dealt out by `key`.

    For work that is heavy per row (regexes over texts). A table of many files is read
    in more pieces than that and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def view(spark: SparkSession, sf_dir: str, name: str, spread_by: dict[str, str] | None = None) -> DataFrame:
    """One of VIEWS over the parquet tables of `sf_dir`; `spread_by` names tables to spread and their keys."""
    views = with_clause(name)
    for given in TABLES:
        if re.search(rf"\b{given}\b", views):
            df = table(spark, sf_dir, given)
            if given in (spread_by or {}):
                df = spread(df, spread_by[given])
            df.createOrReplaceTempView(given)
    return spark.sql(f"WITH {views} SELECT * FROM {name}")
