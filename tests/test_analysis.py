"""The whole analysis on small repositories."""

from pyspark.sql import functions as F

from srcgraph.plans.analysis import analyze

SOURCE = "repo_id bigint, ord bigint, path string, content string"
ANSWER = "session_id bigint, ord bigint, text string"


def inputs(rows):
    source = rows([
        (1, 0, "/src/app.ts", "const app = express()\napp.get('/users', h)\nimport x from 'stripe'"),
        (1, 1, "/prisma.ts", "model User {\nmodel Team {\nmodel User {"),
        (1, 2, "/node_modules/q.ts", "app.get('/hidden')"),
        (1, 3, "/package.json", "redis process.env.REDIS_URL"),
        (2, 0, "/main.py", "from fastapi import FastAPI\n@app.post('/x')"),
    ], SOURCE)
    services = rows([(1, 0, '[{"name":"Billing","filePath":"/b.ts","dependsOn":["Mailer"]},{"name":"Mailer"},{"name":"EXPRESS"}]')], ANSWER)
    features = rows([(1, 0, 0, "/p.tsx", '[{"name":"Pay","usesServices":["billing","redis"],"confidence":0.6}]')],
                    "session_id bigint, pass int, ord bigint, file_path string, text string")
    return source, services, features


def labels(nodes, edges):
    names = {r["id"]: r["label"] for r in nodes.collect()}
    return {(names[e["source"]], e["label"], names[e["target"]]) for e in edges.collect()}


def test_graph_of_two_repositories(rows):
    source, services, features = inputs(rows)
    graph = analyze(source, services, features)
    one = graph.nodes.filter("session_id = 1")
    assert {(r["type"], r["label"]) for r in one.collect()} == {
        ("service", "express"), ("api", "GET /users"), ("database", "User"), ("database", "Team"), ("service", "Billing"),
        ("service", "Mailer"), ("infra", "Redis"), ("external", "Stripe"), ("feature", "Pay")}
    assert labels(one, graph.edges.filter("session_id = 1")) == {
        ("express", "HANDLES", "GET /users"), ("express", "DEPENDS_ON", "Billing"), ("express", "DEPENDS_ON", "Mailer"),
        ("Billing", "DEPENDS_ON", "Mailer"), ("express", "CONNECTS_TO", "Redis"), ("express", "CONNECTS_TO", "Stripe"),
        ("Pay", "USES", "Billing"), ("Pay", "USES", "Redis")}
    assert {(r["type"], r["label"]) for r in graph.nodes.filter("session_id = 2").collect()} == {("service", "fastapi"), ("api", "POST /x")}
    keys = one.filter("label = 'Redis'").first()["metadata"]["external"]["env_keys"]
    assert keys == ["REDIS_URL"]
    # User stands at places 1 and 3, Team at 2: both directions remain.
    assert sorted(r["n_targets"] for r in graph.related.collect()) == [1, 1]


def test_nodes_name_every_key_once(rows):
    files = [(1, i, f"/d{i}/package.json", f"stripe process.env.STRIPE_{i} process.env.STRIPE_ALL") for i in range(12)]
    node = analyze(rows(files, SOURCE)).nodes.filter("label = 'Stripe'").first()
    keys = node["metadata"]["external"]["env_keys"]
    assert keys == ["STRIPE_0", "STRIPE_ALL", *[f"STRIPE_{i}" for i in range(1, 12)]]


def test_review_removes_nodes_edges_and_relations(rows):
    source, services, features = inputs(rows)
    first = analyze(source, services, features).nodes
    gone = [r["id"] for r in first.filter("label in ('Billing', 'Team')").collect()]
    verdicts = rows([(1, 0, 'remove: {"remove": ["%s", "%s"]}' % tuple(gone))], ANSWER)
    graph = analyze(source, services, features, verdicts)
    left = {r["label"] for r in graph.nodes.collect()}
    assert not left & {"Billing", "Team"} and "Mailer" in left
    assert not {e["source"] for e in graph.edges.collect()} & set(gone)
    assert not {e["target"] for e in graph.edges.collect()} & set(gone)
    assert [r["n_targets"] for r in graph.related.collect()] == [0]


def test_recorded_answers_join_what_rules_found(rows):
    source, services, features = inputs(rows)
    per_file = "session_id bigint, ord bigint, file_path string, text string"
    graph = analyze(
        source, services, features,
        endpoint_answers=rows([(1, 0, "/x.ts", 'Found [{"method":"POST","path":"/pay","authRequired":true},7,{"method":"GET","path":"/users"}]')], per_file),
        entity_answers=rows([(1, 0, "/y.ts", '[{"name":"Invoice","dbType":"postgres","orm":"prisma","fields":[]},{"orm":"x"}]')], per_file),
        external_answers=rows([(1, 0, '[{"name":"Redis","category":"queue"},{"name":"Slack","category":"other","envKeys":["SLACK"]}]')], ANSWER),
        plan_answers=rows([(1, 0, '{"entryPoints": ["/src/app.ts", "/b.ts"]}')], ANSWER),
    )
    one = graph.nodes.filter("session_id = 1")
    found = {(r["type"], r["label"]) for r in one.collect()}
    assert {("api", "POST /pay"), ("api", "GET /users"), ("database", "Invoice"), ("external", "Slack"), ("infra", "Redis")} <= found
    assert one.filter("label = 'GET /users'").count() == 1
    main = one.filter("agent_source = 'planner'").first()
    assert main["metadata"]["service"]["file_path"] == "/src/app.ts"
    names = labels(one, graph.edges.filter("session_id = 1"))
    assert ("express", "HANDLES", "POST /pay") in names and ("express", "CONNECTS_TO", "Slack") in names
    # User (1, 3), Team (2) and Invoice (4): three survivors linked with each other
    assert graph.related.filter("session_id = 1").count() == 3


def test_contents_are_read_once(spark, rows, tmp_path, monkeypatch):
    from srcgraph.plans import analysis

    source, services, features = inputs(rows)
    source.write.parquet(str(tmp_path / "source"))
    plans = []
    saved = analysis.Workspace.saved

    def watched(self, name, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return saved(self, name, df)

    monkeypatch.setattr(analysis.Workspace, "saved", watched)
    graph = analyze(spark.read.parquet(str(tmp_path / "source")), services, features)
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (graph.nodes, graph.edges, graph.related)]
    assert sum(plan.count("content:string") for plan in plans) == 1


def test_repeated_runs_give_the_same_ids(rows):
    source, services, features = inputs(rows)
    ids = [sorted(r["id"] for r in analyze(source.repartition(n), services, features).nodes.select(F.col("id")).collect()) for n in (1, 5)]
    assert ids[0] == ids[1]
