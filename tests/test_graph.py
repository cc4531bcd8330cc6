"""Answers, builders, resolution, layout."""

import random

from pyspark.sql import functions as F

from srcgraph.operators import build, layout, report, resolve, responses
from srcgraph.functions.ranking import first_n, position, running_total

NODE = "session_id bigint, ord bigint, id string, type string, label string, confidence double"
EDGE = "session_id bigint, ord bigint, source string, target string, relationship_type string"
ORD = ("ord",)


def answers(rows, *texts):
    return rows([(1, i, f"/f{i}", t) for i, t in enumerate(texts)], "session_id bigint, ord bigint, file_path string, text string")


def test_array_span_is_first_to_last_bracket(rows):
    df = answers(rows, "a [1]\n b [2] c", "no findings [oops", "ok [{\"name\":\"X\",\"dependsOn\":null}] end", "none")
    got = responses.parse_responses(df, "service").collect()
    assert [(r["ord"], r["sub"], r["name"], r["dependsOn"]) for r in got] == [(2, 0, "X", None)]


def test_bad_confidence_keeps_its_record(rows):
    df = answers(rows, '[{"name":"A","confidence":"high"},{"name":"B","confidence":0.5}]').withColumn("pass", F.lit(0))
    nodes = build.feature_nodes(build.dedupe_features(responses.parse_responses(df, "features")))
    assert {r["label"]: r["confidence"] for r in nodes.collect()} == {"A": 0.8, "B": 0.5}


def test_features_once_per_label_first_pass_wins(rows):
    first = answers(rows, '[{"name":"Login"}]', '[{"name":" login "},{"name":""},{"name":"Home","route":null}]').withColumn("pass", F.lit(1))
    second = answers(rows, '[{"name":"HOME","route":"/h"}]').withColumn("pass", F.lit(0))
    got = build.dedupe_features(responses.parse_responses(first.unionByName(second), "features")).orderBy("pass", "ord", "sub").collect()
    assert [(r["name"], r["route"], r["pass"]) for r in got] == [("HOME", "/h", 0), ("Login", None, 1)]


def test_service_deps_last_name_wins(rows):
    df = answers(rows, '[{"name":"S"},{"name":"S"},{"name":"T","dependsOn":["S","s","T","Z"]}]')
    records = responses.parse_responses(df, "service")
    nodes = build.service_nodes(records)
    by_sub = {r["sub"]: r["id"] for r in nodes.collect()}
    got = build.service_deps(records, nodes).collect()
    assert [(e["source"], e["target"]) for e in got] == [(by_sub[2], by_sub[1])]


def test_feature_uses_last_node_with_the_label(rows):
    df = answers(rows, '[{"name":"F","usesServices":["auth ","Nope"]}]').withColumn("pass", F.lit(0))
    picked = build.dedupe_features(responses.parse_responses(df, "features"))
    existing = rows([(1, 1, 0, 0, "old", "Auth"), (1, 3, 0, 0, "new", " AUTH")],
                    "session_id bigint, source_rank int, ord bigint, sub bigint, id string, label string")
    got = build.feature_uses(picked, build.feature_nodes(picked), existing).collect()
    assert [(e["target"], e["label"], e["relationship_type"]) for e in got] == [("new", "USES", "DEPENDS_ON")]


def test_relates_to_counts(rows):
    """Three passing files with 2, 0 and 1 entities: 3 distinct pairs, 1 + 1 + 3 sent."""
    entities = rows([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 2, 0, "c")], "session_id bigint, ord bigint, sub bigint, id string")
    passed = rows([(1, 0), (1, 1), (1, 2)], "session_id bigint, ord bigint")
    got = build.relates_to_raw_count(passed, entities).first()
    assert (got["n_entities"], got["distinct_pairs"], got["raw_pairs"]) == (3, 3, 5)
    ranges = build.relates_to(entities).orderBy("source_place").collect()
    assert [(r["source"], r["first_target"], r["last_target"], r["n_targets"]) for r in ranges] == [("a", 2, 3, 2), ("b", 3, 3, 1), ("c", 4, 3, 0)]


def test_relates_to_resolved_equals_pairs_written_out(rows):
    rng = random.Random(7)
    data = [(s, i, 0, f"{s}-{i}", f"L{rng.randrange(6)}") for s in (1, 2) for i in range(25)]
    entities = rows(data, "session_id bigint, ord bigint, sub bigint, id string, label string")
    first, survivor = {}, {}
    for s, i, _, id_, label in data:
        survivor[id_] = first.setdefault((s, label), id_)
    id_map = rows([(s, id_, survivor[id_]) for s, _, _, id_, _ in data], "session_id bigint, id string, survivor_id string")
    gone = {survivor["1-0"]}
    pairs = set()
    for s, i, _, a, _ in data:
        for t, j, _, b, _ in data:
            if s == t and i < j and survivor[a] != survivor[b] and not {survivor[a], survivor[b]} & gone:
                pairs.add((survivor[a], survivor[b]))
    removed = rows([(1, g) for g in gone], "session_id bigint, id string")
    got = build.relates_to_resolved(entities, id_map, removed).collect()
    assert {r["source"]: r["n_targets"] for r in got} == {a: sum(1 for p in pairs if p[0] == a) for a in set(survivor.values()) - gone}
    by_session = {}
    for r in got:
        by_session.setdefault(r["session_id"], []).append(r)
    read_out = {(a["source"], b["source"]) for g in by_session.values() for a in g for b in g
                if a["source"] != b["source"] and a["first_place"] < b["last_place"]}
    assert read_out == pairs


def test_dedupe_golden(rows):
    df = rows([(1, 1, "1", "api", " X ", 0.8), (1, 2, "2", "api", "x", 0.9), (1, 3, "3", "api", "X", 0.9), (1, 4, "4", "service", "x", 1.0)], NODE)
    got = {r["type"]: r for r in resolve.dedupe_nodes(df, ORD).collect()}
    assert (got["api"]["id"], got["api"]["label"], got["api"]["confidence"], got["api"]["ord"]) == ("1", "x", 0.9, 1)
    assert {r["id"]: r["survivor_id"] for r in resolve.node_id_map(df, ORD).collect()} == {"1": "1", "2": "1", "3": "1", "4": "4"}


def test_dedupe_nan_first_is_never_replaced(rows):
    df = rows([(1, 1, "1", "api", "a", float("nan")), (1, 2, "2", "api", "A", 0.9),
               (1, 3, "3", "api", "b", 0.2), (1, 4, "4", "api", "B", float("nan")), (1, 5, "5", "api", "b ", 0.3),
               (1, 6, "6", "api", "c", None), (1, 7, "7", "api", "C", 0.4)], NODE)
    got = {r["id"]: r["label"] for r in resolve.dedupe_nodes(df, ORD).collect()}
    assert got == {"1": "a", "3": "b ", "6": "c"}


def fold(nodes):
    """Dedupe as one loop, to compare with."""
    seen, order = {}, {}
    for n in sorted(nodes, key=lambda n: n[1]):
        key = (n[0], n[3], n[4].strip().lower())
        if key not in seen:
            seen[key], order[key] = n, (n[2], n[1])
        else:
            old = seen[key][5]
            if n[5] is not None and old is not None and n[5] > old:
                seen[key] = n
    return {(k[0], order[k][0], order[k][1], v[4], repr(v[5])) for k, v in seen.items()}


def test_dedupe_equals_sequential_fold_and_is_idempotent(rows):
    rng = random.Random(3)
    data = [(rng.randrange(3), i, f"n{i}", rng.choice(["api", "service"]), rng.choice(["a", " A", "b", "B ", "c"]),
             rng.choice([0.1, 0.5, 0.5, 0.9, float("nan"), None])) for i in range(300)]
    df = rows(data, NODE)
    for frame in (df, df.repartition(13), df.orderBy(F.desc("ord"))):
        once = resolve.dedupe_nodes(frame, ORD)
        got = {(r["session_id"], r["id"], r["ord"], r["label"], repr(r["confidence"])) for r in once.collect()}
        assert got == fold(data)
    twice = resolve.dedupe_nodes(once, ORD)
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, once.collect()))
    survivors = {(r["session_id"], r["id"]) for r in once.collect()}
    assert {(r["session_id"], r["survivor_id"]) for r in resolve.node_id_map(df, ORD).collect()} == survivors


def test_remap_drops_self_loops_keeps_directions(rows):
    id_map = rows([(1, "A1", "A1"), (1, "A2", "A1"), (1, "B", "B")], "session_id bigint, id string, survivor_id string")
    edges = rows([(1, 0, "A1", "A2", "DEPENDS_ON"), (1, 1, "A1", "B", "RELATES_TO"), (1, 2, "B", "A2", "RELATES_TO"),
                  (1, 3, "A2", "B", "RELATES_TO"), (1, 4, "A1", "ghost", "HANDLES")], EDGE)
    got = {(r["ord"], r["source"], r["target"]) for r in resolve.remap_edges(edges, id_map, ORD).collect()}
    assert got == {(1, "A1", "B"), (2, "B", "A1"), (4, "A1", "ghost")}


def test_main_and_service_with_the_same_label_become_one(rows):
    profile = rows([(1, "express", "typescript", "/")], "session_id bigint, framework string, primary_language string, root string")
    main = build.main_nodes(profile)
    services = build.service_nodes(responses.parse_responses(answers(rows, '[{"name":"Express"}]'), "service"), profile)
    nodes = resolve.union_findings([main, None, services])
    assert resolve.dedupe_nodes(nodes).count() == 1
    edges = build.service_edges(services, main)
    assert edges.count() == 1
    assert resolve.remap_edges(edges, resolve.node_id_map(nodes)).count() == 0


def test_verdicts_remove_nodes_and_touching_edges(rows):
    nodes = rows([(1, i, f"n{i}", "api", f"l{i}", 0.5) for i in range(4)], NODE)
    edges = rows([(1, 0, "n0", "n1", "HANDLES"), (1, 1, "n1", "n2", "HANDLES"), (1, 2, "n3", "n2", "HANDLES")], EDGE)
    verdicts = responses.parse_verdicts(rows(
        [(1, 0, 'so {"keep":["n0"],"remove":["n1"]} ok'), (1, 1, "no idea {")], "session_id bigint, ord bigint, text string"))
    kept, left = resolve.apply_verdicts(nodes, edges, verdicts)
    assert sorted(r["id"] for r in kept.collect()) == ["n0", "n2", "n3"]
    assert [(r["source"], r["target"]) for r in left.collect()] == [("n3", "n2")]
    assert report.critic_summary(nodes, verdicts).first()["message"] == "Verified 3 nodes, removed 1 low-confidence findings"


def test_layout_columns_and_unknown_types(rows):
    nodes = rows([(1, 5, "a", "feature", "", 1.0), (1, 3, "b", "feature", "", 1.0), (1, 4, "c", "odd", "", 1.0), (1, 6, "d", "infra", "", 1.0)], NODE)
    got = {r["id"]: (r["x"], r["y"]) for r in layout.layout_columns(nodes).collect()}
    assert got == {"b": (0.0, 40.0), "a": (0.0, 170.0), "c": (320.0, 40.0), "d": (960.0, 40.0)}
    edges = rows([(1, 0, "a", "b", "X"), (1, 1, "a", "d", "X"), (1, 2, "c", "c", "X"), (1, 3, "a", "ghost", "X")], EDGE)
    assert [r["ord"] for r in layout.intra_column_edges(edges, nodes).collect()] == [0]


def test_running_total_over_sparse_and_shared_places(rows):
    rng = random.Random(11)
    data, seen = [], set()
    for _ in range(500):
        ord_ = rng.choice([rng.randrange(20), rng.randrange(10_000), rng.randrange(1 << 40), (1 << 61) + rng.randrange(50)])
        row = (rng.randrange(2), ord_, rng.randrange(3))
        if row not in seen:
            seen.add(row)
            data.append((*row, rng.randrange(5)))
    df = rows(data, "k bigint, ord bigint, sub bigint, v bigint")
    got = {(r["k"], r["ord"], r["sub"]): r["t"] for r in running_total(df, ["k"], "ord", F.col("v"), "t", ("sub",)).collect()}
    totals, expected = {}, {}
    for k, o, s, v in sorted(data):
        totals[k] = totals.get(k, 0) + v
        expected[(k, o, s)] = totals[k]
    assert got == expected
    assert position(df.drop("v"), ["k"], "ord", "p", ("sub",)).agg(F.max("p")).first()[0] == max(
        sum(1 for d in data if d[0] == k) for k in (0, 1))


def test_first_n_limits_before_the_shuffle(rows):
    df = rows([(i % 2, i) for i in range(50)], "k bigint, ord bigint")
    limited = first_n(df, ["k"], ["ord"], 3)
    assert sorted(map(tuple, limited.collect())) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)]
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
