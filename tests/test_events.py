"""Event folds in batch and as streams, answer frames."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from srcgraph.schemas import EVENT_LOG
from srcgraph.streaming import events as ev
from srcgraph.streaming import frames as fr
from srcgraph.streaming import live

T0 = dt.datetime(2024, 1, 1)


def event(session, seq, kind, data):
    return (session, seq, T0 + dt.timedelta(seconds=seq), kind, data if isinstance(data, str) else json.dumps(data))


def node(id_, label, confidence=0.5, kind="api"):
    return {"id": id_, "type": kind, "data": {"label": label, "confidence": confidence}}


LOG = [
    event(1, 1, "agent:update", {"agentName": "api", "status": "running", "message": "go"}),
    event(1, 2, "node:added", node("a", "first")),
    event(1, 3, "node:added", node("b", "other")),
    event(1, 4, "node:added", node("a", "second", 0.9)),
    event(1, 5, "node:updated", {"id": "a", "data": {"confidence": 0.1}}),
    event(1, 6, "node:updated", {"id": "zzz", "data": {"label": "never added"}}),
    event(1, 7, "error", "{bad json"),
    event(1, 8, "agent:update", {"agentName": "api", "status": "complete", "message": "done"}),
    event(1, 9, "analysis:complete", {"nodes": [], "edges": [], "sessionId": "1"}),
    event(1, 10, "node:added", node("c", "too late")),
    event(1, 11, "error", {"message": "late"}),
    event(2, 12, "edge:added", {"id": "e", "source": "a", "target": "b", "data": {"relationshipType": "HANDLES"}}),
    event(2, 13, "error", {"message": "boom"}),
    event(3, 14, "mystery", {"id": "x"}),
]


@pytest.fixture
def log(rows):
    return rows(LOG, EVENT_LOG)


@pytest.fixture
def events(log):
    return ev.parse_events(log)


def test_parse_marks_unknown_and_malformed(events):
    got = {r["seq"]: (r["valid"], r["subject"]) for r in ev.events_by_kind(events).collect()}
    assert got[2] == (True, "a") and got[7] == (False, None) and got[14] == (False, None) and got[13] == (True, "boom")


def test_last_node_wins_and_moves_to_the_end(events):
    got = {r["id"]: (r["label"], r["ord"]) for r in ev.fold_nodes(events).collect()}
    assert got == {"a": ("second", 4), "b": ("other", 3), "c": ("too late", 10)}


def test_outcome_is_the_first_valid_terminal_event(events):
    got = {r["session_id"]: (r["outcome"], r["close_seq"], r["message"]) for r in ev.session_outcome(events).collect()}
    assert got == {1: ("analysis:complete", 9, None), 2: ("error", 13, "boom"), 3: ("open", None, None)}
    assert sorted(r["seq"] for r in ev.ignored_events(events).collect()) == [10, 11]
    assert {r["id"] for r in ev.session_snapshot(events).collect()} == {"a", "b"}


def test_status_lifecycle(events):
    got = {r["session_id"]: r["status"] for r in ev.session_status(events).collect()}
    assert got == {1: "complete", 2: "error", 3: "pending"}


def test_patches_touch_single_fields_of_added_nodes(events):
    got = {r["id"]: (r["label"], r["confidence"]) for r in ev.patch_nodes(events).collect()}
    assert got == {"a": ("second", 0.1), "b": ("other", 0.5), "c": ("too late", 0.5)}


def test_board_lists_every_agent(events, rows):
    sessions = rows([(1,), (9,)], "session_id bigint")
    board = ev.status_board(ev.agent_status(events), sessions).collect()
    assert len(board) == 18
    assert {(r["session_id"], r["agent"], r["status"]) for r in board if r["status"]} == {(1, "api", "complete")}
    assert ev.status_board(ev.agent_status(events), sessions, with_features=False).count() == 16


def test_frames_stop_at_done(rows):
    text = 'data: {"text":"a"}\njunk\ndata: {bad\ndata: {"text":"b"}\ndata: [DONE]\ndata: {"text":"c"}\n'
    raw = rows([(1, 0, text), (2, 0, 'data: {"text":"x"}\ndata: {"text":"glued"}'), (2, 1, 'data: {"text":"y"}\n'),
                (2, 2, 'data: {"text":"unfinished"}')],
               "stream_id bigint, chunk bigint, text string")
    frames = fr.decode_frames(fr.frame_lines(raw))
    chunks = frames.select("stream_id", F.col("chunk").alias("ord"), F.col("pos").alias("sub"), "text")
    assert {r["stream_id"]: r["text"] for r in fr.reassemble_stream(chunks).collect()} == {1: "ab", 2: "x"}


def test_frames_are_joined_over_chunks(rows):
    whole = "".join(f'data: {{"text":"t{i}"}}\n\n' for i in range(30)) + 'data: {"text":"open'
    rng = random.Random(4)
    for cuts in ([], sorted(rng.sample(range(len(whole)), 12)), list(range(1, len(whole)))):
        edges = [0, *cuts, len(whole)]
        raw = rows([(7, n, whole[a:b]) for n, (a, b) in enumerate(zip(edges, edges[1:]))] + [(8, 0, ""), (8, 1, "\n")],
                   "stream_id bigint, chunk bigint, text string")
        got = fr.decode_frames(fr.frame_lines(raw)).orderBy("chunk", "pos").collect()
        assert [r["text"] for r in got] == [f"t{i}" for i in range(30)]
        starts = [whole.index(f'data: {{"text":"t{i}"') for i in range(30)]
        assert [r["chunk"] for r in got] == [sum(e <= s for e in cuts) for s in starts]


def test_long_streams_come_in_whole_parts(rows):
    chunks = rows([(1, i, 0, f"{i},") for i in range(3000)], "stream_id bigint, ord bigint, sub bigint, text string").repartition(7)
    parts = fr.reassemble_stream(chunks).orderBy("part").collect()
    assert len(parts) == 3
    assert "".join(p["text"] for p in parts) == "".join(f"{i}," for i in range(3000))
    one = rows([(1, 5, i, "word " * 300) for i in range(2000)], "stream_id bigint, ord bigint, sub bigint, text string")
    parts = fr.reassemble_stream(one).orderBy("part").collect()
    assert len(parts) == 5 and max(len(p["text"]) for p in parts) <= fr.CHARS_PER_PART + 1500
    assert "".join(p["text"] for p in parts) == "word " * 600_000


def random_log(n=400):
    rng = random.Random(2)
    out = []
    for seq in range(n):
        s, kind = rng.randrange(4), rng.choice(["node:added"] * 5 + ["agent:update", "node:updated"])
        if rng.random() < 0.01:
            kind = "analysis:complete"
        data = {"node:added": node(f"n{rng.randrange(8)}", f"l{seq}"), "agent:update": {"agentName": "api", "status": "running", "message": str(seq)},
                "node:updated": {"id": "n1", "data": {"label": "p"}}, "analysis:complete": {"sessionId": str(s)}}[kind]
        out.append(event(s, seq, kind, data))
    return out


def as_set(df):
    return {tuple(r[c] for c in sorted(df.columns)) for r in df.collect()}


def test_gated_stream_fold_equals_batch(spark, rows, tmp_path):
    """Three deliveries, then the same folds: the stream ends where the batch does."""
    data = random_log()
    src, out = str(tmp_path / "log"), str(tmp_path / "out")
    stream = lambda: ev.read_log(spark, src, streaming=True)
    for part, merge_every in ((data[:150], 100), (data[150:290], 1), (data[290:], 2)):  # may change between runs
        rows(part, EVENT_LOG).write.mode("append").parquet(src)
        live.gate_sessions(stream(), out, str(tmp_path / "cp1"), available_now=True, merge_every=merge_every).awaitTermination()
        live.run_fold(live.accepted_stream(spark, out), ev.fold_nodes, f"{out}/nodes", str(tmp_path / "cp2"), available_now=True,
                      keys=["session_id", "id"], merge_every=merge_every).awaitTermination()
    batch = ev.parse_events(rows(data, EVENT_LOG))
    expected = ev.fold_nodes(ev.accepted_events(batch))
    got = live.latest_fold(spark, f"{out}/nodes", ["session_id", "id"]).select(*expected.columns)
    assert as_set(got) == as_set(expected)
    accepted = spark.read.schema(EVENT_LOG).parquet(f"{out}/accepted/*")
    assert {r["seq"] for r in accepted.collect()} == {r["seq"] for r in ev.accepted_events(batch).collect()}


def test_bursts_equal_a_plain_scan(rows):
    rng = random.Random(9)
    data = [(s, i, T0 + dt.timedelta(seconds=rng.choice([0, 59, 60, 61]) + 97 * rng.randrange(60)), "x", "{}") for s in range(3) for i in range(40)]
    expected = set()
    for s in range(3):
        times = sorted(t for x, _, t, *_ in data if x == s)
        start, last, n = times[0], times[0], 1
        for t in times[1:]:
            if (t - last).total_seconds() >= 60:
                expected.add((last + dt.timedelta(seconds=60), start, n, s))
                start, n = t, 0
            last, n = t, n + 1
        expected.add((last + dt.timedelta(seconds=60), start, n, s))
    assert as_set(ev.session_windows(rows(data, EVENT_LOG), 60)) == expected


def test_repeats_are_dropped_on_a_stream(spark, rows, tmp_path):
    data = random_log(60)
    rows(data + data[10:30], EVENT_LOG).write.parquet(str(tmp_path / "log"))
    stream = live.without_repeats(ev.read_log(spark, str(tmp_path / "log"), streaming=True), ["session_id", "seq"], "1 hour")
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_closed_windows_on_a_stream_equal_batch(spark, rows, tmp_path):
    data = random_log(300)
    rows(data, EVENT_LOG).write.parquet(str(tmp_path / "log"))
    stream = live.rate_stream(ev.read_log(spark, str(tmp_path / "log"), streaming=True), "1 minute", "10 seconds")
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    got = as_set(spark.read.parquet(str(tmp_path / "out")))
    batch = ev.event_windows(rows(data, EVENT_LOG), "1 minute")
    last = T0 + dt.timedelta(seconds=299 - 10)
    assert got == as_set(batch.filter(F.col("window_end") <= F.lit(last)))


def frames_of(rows, raw, line_chars):
    lines = fr.frame_lines(rows(raw, "stream_id bigint, chunk bigint, text string").repartition(3), line_chars)
    got = fr.decode_frames(lines).orderBy("stream_id", "chunk", "pos", "sub").collect()
    texts = {}
    for r in got:
        key = (r["stream_id"], r["chunk"], r["pos"])
        texts[key] = texts.get(key, "") + r["text"]
    return texts


PAYLOADS = [
    '{"text":"plain words of some length"}', '{"a":[1,{"text":"inner"}],"text":"outer \\u00e9\\n\\"q\\" end"}', '{"text":"first","text":"second"}',
    '{"text":"smile \\ud83d\\ude00 \\ud83d x"}', '{"text":12345678901234}', '{"text":{"deep":[1,2,"x y"]},"b":true}', '{"text":null,"c":"long enough"}',
    "{'text':'single quotes'}", '{"text":"broken', '{"text":"a"} {"text":"b"}', '[1,2,{"text":"list"}]', '"just a string of text"', '{"text":"tail",}',
    '{"text":"bad \\x escape"}', '{"text" : "spaces"  , "n": -1.5e3}', '{"te\\u0078t":"escaped name"}', '{"t":"no text here at all"}', '{"text":"tab\tinside"}',
    '{"text":""}', '{}', '{"text":01,"x":"leading zero"}', '{"other":{"text":"x"},"z":[[],{}]}',
]


def test_long_lines_are_decoded_in_parts_as_short_ones_are(rows):
    log = "".join(f"data: {p}\n" for p in PAYLOADS) + "dato: {\"text\":\"no frame but long\"}\ndata: [DONE]\ndata: {\"text\":\"late late late\"}\nopen" * 2
    rng = random.Random(8)
    edges = [0, *sorted(rng.sample(range(1, len(log)), 150)), len(log)]
    raw = [(s, n, log[a:b]) for s in (1, 2) for n, (a, b) in enumerate(zip(edges, edges[1:]))] + [(3, 0, None), (3, 1, "x")]
    want = frames_of(rows, raw, 1 << 20)
    assert len(want) > 16
    assert frames_of(rows, raw, 12) == want


def test_a_line_over_many_chunks_is_in_no_row(rows, spark):
    n = 20_000
    raw = spark.range(n + 2).select(
        F.lit(1).cast("bigint").alias("stream_id"), F.col("id").alias("chunk"),
        F.when(F.col("id") == 0, 'data: {"text":"').when(F.col("id") <= n, F.concat(F.col("id").cast("string"), F.lit(","))).otherwise('"}\n').alias("text"),
    )
    endless = spark.range(n).select(F.lit(2).cast("bigint").alias("stream_id"), F.col("id").alias("chunk"), F.lit("no end ").alias("text"))
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    whole = raw.unionByName(endless)
    lines = fr.frame_lines(whole.withColumn("text", counted.asNondeterministic()("text")), line_chars=10_000)
    texts = fr.decode_frames(lines)
    assert lines.agg(F.max(F.length("line"))).first()[0] < 10_100
    got = texts.withColumnsRenamed({"chunk": "ord", "sub": "piece", "pos": "sub"})
    parts = fr.reassemble_stream(got, per_part=64, part_chars=20_000, then=("piece",)).orderBy("part").collect()
    assert "".join(p["text"] for p in parts) == "".join(f"{i}," for i in range(1, n + 1))
    assert {p["stream_id"] for p in parts} == {1} and max(len(p["text"]) for p in parts) < 31_000
    assert read.value <= 2 * (2 * n + 2), "chunks are read to be sampled and to be summed up, no more"
