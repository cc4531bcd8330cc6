"""Keyed state for what native streaming aggregates cannot hold: closings in any order of arrival, folds that end.

State is keyed by a group of sessions and a salt. Sessions are dealt over `GROUPS` groups, for each key that a batch touches
costs a few exchanges with the state store, whatever it holds: keys by session would pay them for every few rows. A
session's rows are dealt over `SALTS` salts of its group, so that a session with a third of all events is spread out;
terminal events, of which a session has few, go to all salts of their group. Time is event time: a row is decided
once the watermark has passed it, and until then it is held in state. Per key that is what arrives within the watermark's delay.

Neither job asks anything of the session or of the Python path: the processors are sent with their code, as the
streaming runner beside the driver does not get added files, and `start` gives the query the state store it needs.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from srcgraph.schemas import TERMINAL_KINDS
from srcgraph.streaming.events import parse_events

GROUPS = 64
SALTS = 16
BLOCK_ROWS = 1024
KEEP = "1 day"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def start(writer: DataStreamWriter, spark, path: str | None = None) -> StreamingQuery:
    """Start a query over `gated` or `folded`; its state is kept in RocksDB, whatever the session names.

    A query takes its settings when it starts, so the session has its own back at once.
    """
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return writer.start(path)
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _salted(log: DataFrame, spread: Column) -> DataFrame:
    """Rows with `grp`, `salt`, `at` (milliseconds, rounded up), `us` (microseconds) and `terminal`.

    A terminal event has one row per salt, of which `own` is true for its own.
    """
    parsed = parse_events(log)
    terminal = parsed["valid"] & F.col("event").isin(*TERMINAL_KINDS)
    rows = parsed.select(*log.columns, F.coalesce(terminal, F.lit(False)).alias("terminal"))
    own = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    salts = F.when(F.col("terminal"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array("__own"))
    us = F.unix_micros("ts")
    return rows.withColumn("__own", own).select(
        *rows.columns, us.alias("us"), F.expr("(unix_micros(ts) + pmod(-unix_micros(ts), 1000)) div 1000").alias("at"),
        F.pmod(F.xxhash64(F.lit("group"), "session_id"), F.lit(GROUPS)).cast("int").alias("grp"), "__own", F.explode(salts).alias("salt"),
    ).withColumn("own", F.col("salt") == F.col("__own")).drop("__own")


class _Blocks:
    """Rows in a list state, as JSON texts of up to `BLOCK_ROWS` rows: one exchange of values for each text, not each row."""

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.state = handle.getListState(name, "rows string")

    def rows(self) -> list[list]:
        return [row for (text,) in self.state.get() for row in json.loads(text)] if self.state.exists() else []

    def append(self, rows: list) -> None:
        self.state.appendList(_packed(rows))

    def put(self, rows: list) -> None:
        if rows:
            self.state.put(_packed(rows))
        else:
            self.state.clear()


def _packed(rows: list) -> list[tuple[str]]:
    return [(json.dumps(rows[i:i + BLOCK_ROWS]),) for i in range(0, len(rows), BLOCK_ROWS)]


class _Gate(StatefulProcessor):
    """Per key: events not yet decided, and the sequence number that closes each closed session."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = _Blocks(handle, "held")  # session_id, seq, at, us, event, data
        self.closed = _Blocks(handle, "closed")  # session_id, seq, until

    def _closings(self) -> dict:
        """First closing of each session: its sequence number, and how long it is remembered."""
        first: dict = {}
        for session, seq, until in self.closed.rows():
            if session not in first or seq < first[session][0]:
                first[session] = (seq, until)
        return first

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = self._closings()
        new, fresh = [], {}
        for session, seq, event, data, us, at, terminal, own, *_ in rows:
            if session in first and seq > first[session][0]:
                continue
            if terminal and (session not in first or seq < first[session][0]):
                first[session] = fresh[session] = (seq, at + self.keep_ms)
            if own:
                new.append((session, seq, at, us, event, data))
        kept = [r for r in new if r[0] not in first or r[1] <= first[r[0]][0]]
        if kept:
            self.held.append(kept)
            self.handle.registerTimer(min(r[2] for r in kept))
        if fresh:
            self.closed.put([(session, *closing) for session, closing in first.items()])
            self.handle.registerTimer(min(until for _, until in fresh.values()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # The first timer of a batch does all that the watermark has passed, and leaves one for the rest.
        now = timerValues.getCurrentWatermarkInMs()
        first, held = self._closings(), self.held.rows()
        due = sorted((r for r in held if r[2] <= now), key=lambda r: r[1])
        if due:
            wait = [r for r in held if r[2] > now]
            self.held.put(wait)
            if wait:
                self.handle.registerTimer(min(r[2] for r in wait))
        for session, seq, _, us, event, data in due:
            if session not in first or seq <= first[session][0]:
                yield Row(session_id=session, seq=seq, us=us, event=event, data=data)
        left = [(session, *closing) for session, closing in first.items() if closing[1] > now]
        if len(left) < len(first):
            self.closed.put(left)
            if left:
                self.handle.registerTimer(min(r[2] for r in left))

    def close(self) -> None:
        pass


def gated(log: DataFrame, delay: str, keep: str = KEEP) -> DataFrame:
    """Events up to and including each session's first terminal one, as a stream: `accepted_events` of the whole log.

    log    a stream of (session_id, seq, ts, event, data), times not falling as seq grows
    delay  how late a row may come; an event is given out once the watermark has passed it
    keep   how long after its end a session is remembered, so that what still comes is left out

    The order of arrival within `delay` does not matter: a terminal event that comes after events
    behind it still cuts them off. A batch reads the state of the keys it has rows or due
    timers of, never earlier output.
    """
    salted = _salted(log.withWatermark("ts", delay), F.col("seq")).select(
        "session_id", "seq", "event", "data", "us", "at", "terminal", "own", "grp", "salt", "ts")
    session = log.schema["session_id"].dataType.simpleString()
    out = salted.groupBy("grp", "salt").transformWithState(
        _Gate(_interval_ms(log, keep)),
        f"session_id {session}, seq bigint, us bigint, event string, data string", "append", "eventTime",
    )
    return out.select("session_id", "seq", F.timestamp_micros("us").alias("ts"), "event", "data")


class _Fold(StatefulProcessor):
    """Per key: the last row of each id, given out as it changes, dropped when its session has ended."""

    def __init__(self, keep_ms: int, session: str = "bigint") -> None:
        self.keep_ms, self.session = keep_ms, session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", f"session_id {self.session}, id string", "seq bigint")
        self.ended = _Blocks(handle, "ended")  # session_id, until

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest: dict[tuple, Row] = {}
        ended: dict = {}
        for r in rows:
            subject = (r["session_id"], r["id"])
            if r["terminal"]:
                ended[r["session_id"]] = max(r["at"] + self.keep_ms, ended.get(r["session_id"], 0))
            elif r["id"] is not None and (subject not in newest or r["seq"] > newest[subject]["seq"]):
                newest[subject] = r
        if ended:
            self.ended.append(list(ended.items()))
            for until in set(ended.values()):
                self.handle.registerTimer(until)
        for subject, r in newest.items():
            before = self.last.getValue(subject)
            if before is None or before[0] < r["seq"]:
                self.last.updateValue(subject, (r["seq"],))
                yield Row(session_id=r["session_id"], id=r["id"], ord=r["seq"], data=r["data"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # The first timer of a batch does all that the watermark has passed.
        now = timerValues.getCurrentWatermarkInMs()
        ended = self.ended.rows()
        over = {session for session, until in ended if until <= now}
        if over:
            for subject in [tuple(k) for k in self.last.keys() if k[0] in over]:
                self.last.removeKey(subject)
            self.ended.put([r for r in ended if r[1] > now])
        return iter(())

    def close(self) -> None:
        pass


def folded(accepted: DataFrame, kind: str, subject: Column, delay: str, keep: str = "0 seconds") -> DataFrame:
    """`(session_id, id, ord, data)`: the newest event of `kind` per id, each time it changes; of an ended session no state stays.

    accepted  a stream of accepted events (session_id, seq, ts, event, data)
    subject   the id that an event is about, of a parsed event (e.g. `node_added.id`)
    keep      how long after a session's end its state stays

    The last row of an id (by `ord`) is its current form. State holds ids and sequence numbers, not payloads.
    """
    log = accepted.withWatermark("ts", delay)
    ids = parse_events(log).select(*log.columns, F.when(F.col("event") == kind, subject).alias("id"))
    wanted = ids.filter(F.col("id").isNotNull() | F.col("event").isin(*TERMINAL_KINDS))
    salted = _salted(wanted, F.coalesce("id", F.lit("")))
    session = accepted.schema["session_id"].dataType.simpleString()
    return salted.groupBy("grp", "salt").transformWithState(
        _Fold(_interval_ms(accepted, keep), session),
        f"session_id {session}, id string, ord bigint, data string", "update", "eventTime",
    )


def _interval_ms(df: DataFrame, text: str) -> int:
    """Milliseconds of an interval such as `10 minutes`."""
    row = df.sparkSession.range(1).select(
        (F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {text}")) / 1000).cast("bigint").alias("ms")).first()
    return row["ms"]
