"""The event log: parsing, and folds that hold in batch and on a stream alike.

Log rows: `(session_id, seq, ts, event, data)`. `seq` is the order of arrival and unique
per session. Folds are plain keyed aggregates, so a session with a third of all
events is pre-aggregated in every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcgraph.functions.joins import keyed_join
from srcgraph.schemas import EVENT_LOG, EVENT_PAYLOADS, TERMINAL_KINDS

# The agents of the status board in display order, with their titles.
STATUS_BOARD = (
    ("orchestrator", "Orchestrator"),
    ("planner", "Planner"),
    ("api", "API Agent"),
    ("data", "Data Agent"),
    ("service", "Service Agent"),
    ("infra", "Infra Agent"),
    ("features", "Features Agent"),
    ("critic", "Critic"),
    ("diagram", "Layout"),
)
NOT_ON_REFERENCE_BOARD = ("features",)

# The payload field without which an event of that kind has no effect.
_NEEDED = {
    "agent:update": "agentName",
    "node:added": "id",
    "edge:added": "id",
    "node:updated": "id",
    "analysis:complete": "sessionId",
    "error": "message",
}


def _column(kind: str) -> str:
    return kind.replace(":", "_")


def parse_events(log: DataFrame) -> DataFrame:
    """Add one parsed struct per event kind, and `valid`.

    Each payload is parsed by its own kind's schema. Unknown kinds keep their raw data
    and are not valid; a payload that is no JSON has no effect, so it is not valid either.
    """
    df = log
    valid = F.lit(False)
    for kind, ddl in EVENT_PAYLOADS.items():
        name = _column(kind)
        df = df.withColumn(name, F.when(F.col("event") == kind, F.from_json("data", ddl)))
        valid = valid | ((F.col("event") == kind) & F.col(f"{name}.{_NEEDED[kind]}").isNotNull())
    return df.withColumn("valid", valid)


def events_by_kind(events: DataFrame) -> DataFrame:
    """`(session_id, seq, event, valid, subject, detail)`: what each event is about, flat."""
    subject = F.coalesce(
        "agent_update.agentName", "node_added.id", "edge_added.id", "node_updated.id",
        "analysis_complete.sessionId", "error.message",
    )
    detail = F.coalesce(
        "agent_update.status", "node_added.type", "edge_added.data.relationshipType",
        F.col("node_updated.data.confidence").cast("decimal(12,2)").cast("string"),
    )
    return events.select(
        "session_id", "seq", "event", "valid",
        F.when(F.col("valid"), subject).alias("subject"), F.when(F.col("valid"), detail).alias("detail"),
    )


def fold_nodes(events: DataFrame) -> DataFrame:
    """Latest form of every node: a repeated id replaces the node and moves it to the end."""
    n = "node_added."
    return (
        events.filter((F.col("event") == "node:added") & F.col(n + "id").isNotNull())
        .groupBy("session_id", F.col(n + "id").alias("id"))
        .agg(
            F.max_by(F.struct(
                F.col(n + "type").alias("type"), F.col(n + "data.label").alias("label"),
                F.col(n + "data.confidence").alias("confidence"),
            ), "seq").alias("p"),
            F.max("seq").alias("ord"),
        )
        .select("session_id", "id", "ord", "p.*")
    )


def fold_edges(events: DataFrame) -> DataFrame:
    e = "edge_added."
    return (
        events.filter((F.col("event") == "edge:added") & F.col(e + "id").isNotNull())
        .groupBy("session_id", F.col(e + "id").alias("id"))
        .agg(
            F.max_by(F.struct(
                F.col(e + "source").alias("source"), F.col(e + "target").alias("target"),
                F.col(e + "data.relationshipType").alias("relationship_type"),
            ), "seq").alias("p"),
            F.max("seq").alias("ord"),
        )
        .select("session_id", "id", "ord", "p.*")
    )


def agent_status(events: DataFrame) -> DataFrame:
    """Latest status and message of each agent of a session."""
    a = "agent_update."
    return (
        events.filter((F.col("event") == "agent:update") & F.col(a + "agentName").isNotNull())
        .groupBy("session_id", F.col(a + "agentName").alias("agent"))
        .agg(
            F.max_by(F.struct(F.col(a + "status").alias("status"), F.col(a + "message").alias("message")), "seq")
            .alias("p"),
            F.max("seq").alias("seq"),
        )
        .select("session_id", "agent", "seq", "p.*")
    )


def status_board(status: DataFrame, sessions: DataFrame, with_features: bool = True) -> DataFrame:
    """Every agent of the board for every session, in order, unseen ones with null status."""
    agents = [a for a in STATUS_BOARD if with_features or a[0] not in NOT_ON_REFERENCE_BOARD]
    board = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(name).alias("agent"), F.lit(title).alias("title"))
        for i, (name, title) in enumerate(agents)
    ])
    rows = sessions.select("session_id").distinct().select("session_id", F.explode(board).alias("b")).select(
        "session_id", "b.*"
    )
    return rows.join(status.select("session_id", "agent", "status", "message"), ["session_id", "agent"], "left")


def patch_nodes(events: DataFrame) -> DataFrame:
    """Node fields after partial updates: per field the last value given; ids never added are left out."""
    added, patched = F.col("node_added"), F.col("node_updated")
    rows = events.filter(F.col("valid") & F.col("event").isin("node:added", "node:updated")).select(
        "session_id", "seq", (F.col("event") == "node:added").alias("is_add"),
        F.coalesce(added["id"], patched["id"]).alias("id"),
        added["type"].alias("type"),
        F.coalesce(added["data"]["label"], patched["data"]["label"]).alias("label"),
        F.coalesce(added["data"]["confidence"], patched["data"]["confidence"]).alias("confidence"),
    )

    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)

    return (
        rows.groupBy("session_id", "id")
        .agg(F.bool_or("is_add").alias("added"), last("type"), last("label"), last("confidence"),
             F.count_if(~F.col("is_add")).alias("n_patches"))
        .filter("added").drop("added")
    )


def session_outcome(events: DataFrame) -> DataFrame:
    """`(session_id, outcome, close_seq, closed_at, message)`: the first valid terminal event, or `open`."""
    terminal = F.col("valid") & F.col("event").isin(*TERMINAL_KINDS)
    seq = F.when(terminal, F.col("seq"))
    return events.groupBy("session_id").agg(
        F.coalesce(F.min_by("event", seq), F.lit("open")).alias("outcome"),
        F.min(seq).alias("close_seq"),
        F.min_by("ts", seq).alias("closed_at"),
        F.min_by(F.col("error.message"), seq).alias("message"),
    )


def closings(events: DataFrame) -> DataFrame:
    """`(session_id, close_seq)` of closed sessions only."""
    return (
        events.filter(F.col("valid") & F.col("event").isin(*TERMINAL_KINDS))
        .groupBy("session_id").agg(F.min("seq").alias("close_seq"))
    )


def accepted_events(events: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """Events up to and including each session's first terminal one."""
    closed = closings(events) if closed is None else closed
    return keyed_join(events, closed, ["session_id"], "left").filter(
        F.col("close_seq").isNull() | (F.col("seq") <= F.col("close_seq"))
    ).drop("close_seq")


def ignored_events(events: DataFrame) -> DataFrame:
    """Events behind a session's first terminal one."""
    return keyed_join(events, closings(events), ["session_id"]).filter(F.col("seq") > F.col("close_seq"))


def session_snapshot(events: DataFrame) -> DataFrame:
    """Nodes of every session as they stood when it closed (or stand now), with its outcome."""
    outcome = session_outcome(events).select("session_id", "outcome")
    return keyed_join(fold_nodes(accepted_events(events)), outcome, ["session_id"])


def session_status(events: DataFrame) -> DataFrame:
    """Lifecycle per session: pending, running, complete or error, with its times.

    Unlike the reference, a session does become complete: its log says so.
    """
    first_run = F.min(F.when(F.col("event") == "agent:update", F.col("ts")))
    base = events.groupBy("session_id").agg(F.min("ts").alias("created_at"), first_run.alias("running_at"))
    status = (
        F.when(F.col("outcome") == "analysis:complete", "complete")
        .when(F.col("outcome") == "error", "error")
        .when(F.col("running_at").isNotNull(), "running")
        .otherwise("pending")
    )
    return base.join(session_outcome(events), "session_id").select(
        "session_id", status.alias("status"), "created_at", F.col("closed_at").alias("completed_at"),
        F.col("message").alias("error_message"),
    )


def event_windows(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events per kind in tumbling or sliding windows of event time."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(window.alias("w"), "event").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event", "n"
    )


def session_windows(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Bursts of activity per session, cut where nothing happens for `gap_seconds` or longer.

    Two events in one bin of that width always belong to the same burst, so events are
    first summed per bin; what is then put in order per session are bins, as many as
    the time span has, not events. On a stream, use the built-in session_window.
    """
    gap = gap_seconds * 1_000_000
    at = F.unix_micros("ts")
    bins = events.groupBy("session_id", F.floor(at / F.lit(gap)).alias("bin")).agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n")
    )
    in_order = Window.partitionBy("session_id").orderBy("bin")
    is_new = F.coalesce(F.col("first_at") - F.lag("last_at").over(in_order) >= gap, F.lit(True))
    numbered = bins.withColumn("new", is_new.cast("int")).withColumn("burst", F.sum("new").over(in_order))
    return numbered.groupBy("session_id", "burst").agg(
        F.min("first_at").alias("a"), F.max("last_at").alias("b"), F.sum("n").alias("n")
    ).select(
        "session_id", F.timestamp_micros("a").alias("burst_start"),
        F.timestamp_micros(F.col("b") + gap).alias("burst_end"), "n",
    )


def dedupe_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """First of each set of equal events."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("e")).select(*keys, "e.*")


def read_log(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "parquet") -> DataFrame:
    """The event log as a table or, with `streaming`, as a stream of new files."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENT_LOG).format(fmt).load(path)
