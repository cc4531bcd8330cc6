"""Keyed streaming state against the batch rules."""

import json
import os
import random
import re
import subprocess
import sys
from datetime import datetime, timezone
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from srcgraph.schemas import EVENT_LOG
from srcgraph.streaming import events as ev
from srcgraph.streaming import live, stateful

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
COLS = "session_id bigint, seq bigint, at bigint, event string, data string"


def write(spark, folder, rows):
    """One file of log rows; `at` is in seconds."""
    df = spark.createDataFrame(rows, COLS).select(
        "session_id", "seq", F.timestamp_seconds("at").alias("ts"), "event", "data")
    df.coalesce(1).write.mode("append").parquet(folder)


def run(spark, frame, tmp, name, mode="append"):
    out = f"{tmp}/{name}"
    query = (
        frame.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{tmp}/{name}-state")
        .trigger(availableNow=True).start(out)
        if mode == "append" else
        frame.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"))
        .option("checkpointLocation", f"{tmp}/{name}-state").trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return out, query


def log_rows(seed):
    rng = random.Random(seed)
    rows = []
    for session in range(4):
        for seq in range(60):
            kind = "node:added"
            data = json.dumps({"id": f"n{rng.randrange(6)}", "type": "api", "data": {"label": str(seq), "confidence": 0.5}})
            if session < 3 and seq in (20 + session * 7, 45):
                kind, data = ("error", '{"message":"x"}') if session == 1 else ("analysis:complete", json.dumps({"sessionId": "s"}))
            elif rng.random() < 0.1:
                kind, data = "error", "{broken"
            rows.append((session, seq, 1000 + seq, kind, data))
    return rows


def test_closings_in_any_order_equal_the_batch_rule(spark, tmp_path):
    rows = log_rows(3)
    late = sorted(rows, key=lambda r: (r[2] + random.Random(r[1] * 7 + r[0]).randrange(9), r[0]))  # out of order by up to 8 seconds
    folder = f"{tmp_path}/log"
    for start in range(0, len(late), 60):
        write(spark, folder, late[start:start + 60])
    write(spark, folder, [(99, 0, 5000, "agent:update", "{}")])  # time goes on
    stream = spark.readStream.schema(EVENT_LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    out, query = run(spark, stateful.gated(stream, "20 seconds"), str(tmp_path), "gated")
    got = {(r["session_id"], r["seq"], r["event"], r["data"], r["ts"]) for r in spark.read.parquet(out).collect()}
    batch = ev.accepted_events(ev.parse_events(spark.read.schema(EVENT_LOG).parquet(folder))).filter("session_id != 99")
    want = {(r["session_id"], r["seq"], r["event"], r["data"], r["ts"]) for r in batch.select("session_id", "seq", "event", "data", "ts").collect()}
    assert got == want and 0 < len(want) < len(rows)
    assert spark.read.parquet(out).count() == len(want)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) > 3
    # Open and decided: nothing of the first sessions is held any more but the closing numbers.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 4 * stateful.SALTS * 4


def test_state_of_folds_falls_when_sessions_end(spark, tmp_path):
    folder = f"{tmp_path}/accepted"
    node = lambda i, label: json.dumps({"id": f"n{i}", "type": "api", "data": {"label": label, "confidence": 0.5}})
    first = [(1, i, 1000 + i, "node:added", node(i % 50, f"a{i}")) for i in range(100)]
    write(spark, folder, first)
    frame = lambda: stateful.folded(
        spark.readStream.schema(EVENT_LOG).parquet(folder), "node:added", F.col("node_added.id"), "5 seconds")
    out, query = run(spark, frame(), str(tmp_path), "fold", "update")
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held >= 50
    write(spark, folder, [(1, 100, 1200, "analysis:complete", '{"sessionId":"s"}'), (2, 0, 1201, "node:added", node(1, "b"))])
    write(spark, folder, [(3, 0, 4000, "node:added", node(1, "c"))])
    out, query = run(spark, frame(), str(tmp_path), "fold", "update")
    write(spark, folder, [(3, 1, 4100, "node:added", node(2, "c"))])
    out, query = run(spark, frame(), str(tmp_path), "fold", "update")
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 20
    last = spark.read.parquet(out).groupBy("session_id", "id").agg(F.max_by("data", "ord").alias("data"), F.max("ord").alias("ord"))
    got = {(r["session_id"], r["id"]): (r["ord"], json.loads(r["data"])["data"]["label"]) for r in last.collect()}
    batch = ev.fold_nodes(ev.parse_events(spark.read.schema(EVENT_LOG).parquet(folder))).collect()
    assert got == {(r["session_id"], r["id"]): (r["ord"], r["label"]) for r in batch}


def test_late_rows_are_set_aside_and_bursts_equal_the_batch(spark, tmp_path):
    rng = random.Random(6)
    folder, out = f"{tmp_path}/log", f"{tmp_path}/split"
    times = sorted(rng.sample(range(1000, 9000, 4), 300))
    rows = [(rng.randrange(3), i, at, "agent:update", "{}") for i, at in enumerate(times)]
    late = [(0, 1000, 1001, "agent:update", "{}"), (1, 1001, 1501, "agent:update", "{}")]
    for n, part in enumerate([rows[:100], rows[100:200], rows[200:250] + late, rows[250:], [(9, 0, 99_999, "agent:update", "{}")]]):
        write(spark, folder, part)
        stream = spark.readStream.schema(EVENT_LOG).parquet(folder)
        query = live.split_late(stream, out, f"{tmp_path}/split-state", "60 seconds", available_now=True)
        query.awaitTermination(120)
    read = spark.read.option("basePath", f"{out}/late").parquet(f"{out}/late")
    assert sorted(r["seq"] for r in read.collect()) == [1000, 1001]
    kept = spark.read.schema(EVENT_LOG).parquet(f"{out}/in_time")
    assert kept.count() == 301
    got, _ = run(spark, live.burst_stream(live.in_time(spark, out), "90 seconds", "60 seconds"), str(tmp_path), "bursts")
    plain = lambda df: sorted(tuple(r) for r in df.filter("session_id < 9").select("session_id", "burst_start", "burst_end", "n").collect())
    assert plain(spark.read.parquet(got)) == plain(ev.session_windows(kept, 90))


def test_queries_need_neither_the_path_nor_the_state_store_of_the_session(tmp_path):
    """A session as Spark gives it, started elsewhere: the streaming runner cannot import this package."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate())
queries, keys = entry.queries(), ("session_id", "id", "ord")
before = spark.conf.get({stateful._PROVIDER!r}, None)
got = sorted(tuple(r[k] for k in keys) for r in queries["streamed_nodes"](spark, {SF!r}).collect())
accepted = queries["gated_events"](spark, {SF!r}).count()
assert spark.conf.get({stateful._PROVIDER!r}, None) == before
print("FOUND", len(got), accepted)
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    nodes, accepted = map(int, re.search(r"FOUND (\d+) (\d+)", done.stdout).groups())
    assert 0 < nodes < accepted


class _Handle:
    """State of one key in memory, and the timers set."""

    def __init__(self):
        self.states, self.timers, self.reads = {}, [], 0

    def getListState(self, name, schema):
        return _State(self)

    def registerTimer(self, at):
        self.timers.append(at)


class _State:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def exists(self):
        return self.value is not None

    def get(self):
        self.handle.reads += len(self.value)
        return self.value

    def put(self, rows):
        self.value = rows

    def appendList(self, rows):
        self.value = [*(self.value or []), *rows]

    def clear(self):
        self.value = None


def test_a_batch_reads_what_it_holds_once(tmp_path):
    """Of 3,000 events at as many times, held rows are read in blocks, once a batch, and one timer is set."""
    handle, gate = _Handle(), stateful._Gate(1000)
    gate.init(handle)
    rows = [(i % 100, i, "node:added", None, i * 10**6, i * 1000, i == 150, True, 1, 0) for i in range(3000)]
    list(gate.handleInputRows((1, 0), iter(rows), None))
    assert handle.timers == [0, 151_000]
    handle.reads = 0
    fire = lambda now: list(gate.handleExpiredTimer((1, 0), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None))
    assert [r["seq"] for r in fire(299_000)] == [i for i in range(300) if i != 250]
    assert handle.timers == [0, 151_000, 300_000] and handle.reads < 10
    assert [r["seq"] for r in fire(10**9)] == [i for i in range(300, 3000) if i % 100 != 50]
    assert handle.reads < 20 and not gate.held.rows() and not gate.closed.rows()


def test_state_is_keyed_by_groups_of_sessions(spark):
    """A key costs exchanges with the state store, so there are not more keys the more sessions there are."""
    log = spark.range(20_000).select(
        F.col("id").alias("session_id"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"),
        F.lit("node:added").alias("event"), F.lit("{}").alias("data"))
    keys = stateful._salted(log, F.col("seq")).groupBy("grp", "salt").count().agg(F.count("*"), F.max("count")).first()
    assert keys[0] == stateful.GROUPS * stateful.SALTS and keys[1] < 100
