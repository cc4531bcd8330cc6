"""Source trees and sinks."""

import os

import pytest
from pyspark.sql import functions as F

from srcgraph.operators import files as fl
from srcgraph.sources import repos, sinks


@pytest.fixture
def tree(tmp_path):
    for name, body in {
        "r1/a/__init__.py": b"x = 1", "r1/a/_p.py": b"", "r1/a/.env.example": b"no", "r1/.git/x.ts": b"no",
        "r1/node_modules/z/i.js": b"no", "r1/z.ts": b"bad \xff", "r1/b/__pycache__/q.pyc": b"no", "r2/m.go": b"package m",
    }.items():
        path = tmp_path / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(body)
    return str(tmp_path)


def test_trees_keep_underscore_names_and_order(spark, tree):
    df = repos.read_repos(spark, tree)
    assert df.rdd.getNumPartitions() == 2
    got = [(r["repo_id"], r["ord"], r["path"]) for r in df.orderBy("repo_id", "ord").collect()]
    assert got == [("r1", 0, "/a/__init__.py"), ("r1", 1, "/a/_p.py"), ("r1", 2, "/z.ts"), ("r2", 0, "/m.go")]
    assert {r["path"]: r["content"] for r in fl.read_text(df).collect()} == {
        "/a/__init__.py": "x = 1", "/z.ts": "bad �", "/m.go": "package m"}


def test_shares_of_a_repository_add_up(spark, tree):
    one = {tuple(r) for r in repos.read_repos(spark, tree).drop("content").collect()}
    split = repos.read_repos(spark, tree, splits=3)
    assert split.rdd.getNumPartitions() == 6
    assert {tuple(r) for r in split.drop("content").collect()} == one


def test_small_repositories_share_a_task(spark, tree, monkeypatch):
    one = {tuple(r) for r in repos.read_repos(spark, tree).collect()}
    both = repos.read_repos(spark, tree, per_task=5)
    assert both.rdd.getNumPartitions() == 1
    assert {tuple(r) for r in both.collect()} == one


def test_snapshot_replaces_whole_sessions(spark, rows, tmp_path):
    path = str(tmp_path / "snap")
    nodes = rows([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "session_id bigint, id string")
    edges = rows([(1, "a", "b"), (2, "c", "c"), (3, "d", "d")], "session_id bigint, source string, target string")
    sinks.write_snapshot(nodes, edges, path)
    sinks.write_snapshot(rows([(1, "z")], "session_id bigint, id string"), edges.filter("false"), path)
    sinks.write_snapshot(nodes.filter("false"), edges.filter("false"), path, rows([(3,)], "session_id bigint"))
    left, links = sinks.read_snapshot(spark, path)
    assert {(r["session_id"], r["id"]) for r in left.collect()} == {(1, "z"), (2, "c")}
    assert [(r["session_id"], r["source"]) for r in links.collect()] == [(2, "c")]


def test_a_write_that_breaks_off_changes_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "snap")
    nodes, edges = rows([(1, "a")], "session_id bigint, id string"), rows([(1, "a")], "session_id bigint, source string")
    sinks.write_snapshot(nodes, edges, path)
    nodes.withColumn("id", F.lit("half")).write.parquet(f"{path}/nodes/batch=9999999999999999999"[:-1])
    assert [r["id"] for r in sinks.read_snapshot(spark, path)[0].collect()] == ["a"]


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from srcgraph import session

    def fake(master, named=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError):
        session.shared_dir(fake("spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_dir(fake("local-cluster[2,1,1024]"))
    assert session.shared_dir(fake("yarn", "hdfs://x")) == "hdfs://x"
