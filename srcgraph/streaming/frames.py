"""Answer frames out of raw log text: a scan over chunks in pieces that combine, and the text put together again.

A chunk is summed up once: its line feeds, the piece before its first line feed, the piece behind its
last one, and the lines that lie whole inside it. Prefix sums of the line feeds number the pieces, so
that pieces of one number make one line, however the chunks were cut. Nothing is
put together that is not needed: the last line of a stream, which no line feed ends, is
dropped by its number, and a line over `LINE_CHARS` stays in parts. Its text is decoded part
by part by a scanner that keeps a few characters of state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.joins import keyed_join
from srcgraph.functions.ranking import running_total
from srcgraph.session import cut, send_package

DONE = "[DONE]"
PREFIX = "data: "
#: A line of more characters is not put together in one row.
LINE_CHARS = 1 << 20
TURNS_PER_PART = 1024
CHARS_PER_PART = 1 << 20


def frame_lines(raw: DataFrame, line_chars: int = LINE_CHARS) -> DataFrame:
    """`(stream_id, chunk, pos, part, last, line)`: lines of raw log text, wherever its chunks were cut.

    raw  (stream_id, chunk, text), chunks in order; a null text is an empty one

    A line stands where its first character does: in that chunk, after `pos` line feeds. It is
    one row (part 0, `last`) up to `line_chars` characters; a longer one comes in parts from 0,
    each of about that size or one piece of a chunk. `raw` is read once to be sampled and once to be
    summed up; the rest runs on the sums, which are written.
    """
    line_chars = max(line_chars, len(PREFIX + DONE))  # the line that ends a stream is always one row
    split = raw.select("stream_id", "chunk", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    n = F.size("lines") - 1
    sums = split.select(
        "stream_id", "chunk", n.alias("n"), F.element_at("lines", 1).alias("head"),
        F.when(n > 0, F.element_at("lines", -1)).alias("tail"),
        F.when(n > 1, F.slice("lines", 2, F.greatest(n - 1, F.lit(0)))).alias("inside"),
    )
    # The number of line feeds up to and with a chunk numbers its last piece; its first piece has those before.
    placed = cut(running_total(sums, ["stream_id"], "chunk", F.col("n"), "feeds"))
    whole = placed.select("stream_id", "chunk", F.posexplode("inside").alias("at", "line")).select(
        "stream_id", "chunk", (F.col("at") + 1).alias("pos"), F.lit(0).cast("bigint").alias("part"),
        F.lit(True).alias("last"), "line",
    )
    # Piece numbers within a stream: where a piece stands among all of its line.
    pieces = placed.select(
        "stream_id", "chunk",
        F.explode(F.array(
            F.struct(F.lit(0).alias("pos"), (F.col("feeds") - F.col("n")).alias("number"), F.col("head").alias("piece")),
            F.struct(F.col("n").alias("pos"), F.col("feeds").alias("number"), F.col("tail").alias("piece")),
        )).alias("p"),
    ).select("stream_id", "chunk", "p.*").filter(F.col("piece") != "")
    total = placed.groupBy("stream_id").agg(F.max("feeds").alias("total"))
    ended = keyed_join(pieces, total, ["stream_id"]).filter(F.col("number") < F.col("total")).drop("total")
    sizes = ended.groupBy("stream_id", "number").agg(F.sum(F.length("piece")).alias("chars"))
    key = ["stream_id", "number"]
    too_long = F.col("chars") > line_chars

    def as_lines(pieces: DataFrame) -> DataFrame:
        return _joined(pieces, key).select(
            "stream_id", "chunk", "pos", F.lit(0).cast("bigint").alias("part"), F.lit(True).alias("last"), "line",
        )

    whole = whole.filter(F.col("line") != "")
    if sizes.filter(too_long).isEmpty():
        return whole.unionByName(as_lines(ended))
    sized = keyed_join(ended, sizes, key)
    return whole.unionByName(as_lines(sized.filter(~too_long))).unionByName(
        _in_parts(sized.filter(too_long), key, line_chars))


def _joined(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of a key in order as one `line`, at the place of the first."""
    in_order = F.array_sort(F.collect_list(F.struct("chunk", "pos", "piece")))
    return pieces.groupBy(*keys).agg(in_order.alias("p")).select(
        *keys, F.col("p")[0]["chunk"].alias("chunk"), F.col("p")[0]["pos"].alias("pos"),
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("line"),
    )


def _in_parts(long: DataFrame, key: list[str], line_chars: int) -> DataFrame:
    """Long lines as parts: pieces that start within `line_chars` characters of each other are joined."""
    upto = running_total(long, key, "chunk", F.length("piece"), "upto", then=("pos",))
    part = F.call_function("div", F.col("upto") - F.length("piece"), F.lit(line_chars).cast("bigint"))
    parts = _joined(upto.withColumn("place", part), [*key, "place"])
    ends = long.groupBy(*key).agg(
        F.min(F.struct("chunk", "pos")).alias("start"), F.max("chars").alias("chars"),
        F.max_by(F.length("piece"), F.struct("chunk", "pos")).alias("tail"),
    )
    final = F.call_function("div", F.col("chars") - F.col("tail"), F.lit(line_chars).cast("bigint"))
    # Numbers of parts may leave gaps where a piece is longer than a part; their order is what counts.
    return keyed_join(parts.drop("chunk", "pos"), ends, key).select(
        "stream_id", F.col("start.chunk").alias("chunk"), F.col("start.pos").alias("pos"), F.col("place").alias("part"),
        (F.col("place") == final).alias("last"), "line",
    )


def _delta(payload: Column) -> Column:
    """The text of one frame; null if the payload is not exactly one JSON value. Inside a list, what follows it counts."""
    only = F.from_json(F.concat(F.lit("["), payload, F.lit("]")), "array<string>")
    return F.when(F.size(only) == 1, F.from_json(only[0], "text string")["text"])


def decode_frames(lines: DataFrame) -> DataFrame:
    """`(stream_id, chunk, pos, sub, text)`: text deltas of `data: ` lines before the first `[DONE]`.

    Malformed frames, and frames without text, are skipped. A frame is one row (sub 0), but for
    one in parts, whose text comes in pieces by ascending `sub`.
    """
    plain = lines.filter((F.col("part") == 0) & F.col("last"))
    frames = plain.filter(F.startswith("line", F.lit(PREFIX))).select(
        "stream_id", "chunk", "pos", F.substring("line", len(PREFIX) + 1, 2147483647).alias("payload")
    )
    place = F.struct("chunk", "pos")
    ends = frames.filter(F.col("payload") == DONE).groupBy("stream_id").agg(F.min(place).alias("end"))
    texts = (
        frames.filter(F.col("payload") != DONE)
        .select("stream_id", "chunk", "pos", F.lit(0).cast("bigint").alias("sub"), _delta(F.col("payload")).alias("text"))
        .filter(F.col("text").isNotNull())
    )
    in_parts = lines.filter((F.col("part") > 0) | ~F.col("last"))
    if not in_parts.isEmpty():  # known from the plan where no line is long
        texts = texts.unionByName(_long_texts(in_parts))
    return (
        keyed_join(texts, ends, ["stream_id"], "left")
        .filter(F.col("end").isNull() | (place < F.col("end")))
        .drop("end")
    )


class TextScan:
    """Reads one JSON value piece by piece and gives the pieces of its member `text`.

    Pieces are `(member, text)`: a name may come several times, and the last one holds. What is kept is the
    open brackets, at most 1,000 as the JSON reader of Spark allows, and an unfinished escape or number.
    Like that reader it takes strings in single quotes too.
    """

    DEPTH, NUMBER = 1000, 1000
    _PLAIN = {q: re.compile(f"[^{q}\\\\\x00-\x1f]+") for q in "\"'"}
    _SCALAR = re.compile(
        r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null|NaN|[+-]?INF|[+-]?Infinity")
    _ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}

    def __init__(self) -> None:
        self.valid, self.found, self.member = True, None, 0
        self.open: list[str] = []
        self.expect = "value"  # value, key, colon, next (comma or end); "first" allows an end as well
        self.first = False
        self.quote, self.pending, self.high = "", "", 0
        self.scalar = ""
        self.key: list[str] | None = None  # a name of the outermost object while it is read
        self.name = ""
        self.wanted = 0  # depth + 1 of the value that is given out, 0 outside of it
        self.raw = False  # given out as it is written (numbers, lists, objects)

    def _fail(self) -> None:
        self.valid = False

    def _begin(self, string: bool) -> None:
        if self.expect == "value" and len(self.open) == 1 and self.open[0] == "{" and self.name == "text":
            self.member += 1
            self.found, self.wanted, self.raw = self.member, 2, not string

    def _ended(self) -> None:
        """A value is complete."""
        self.expect, self.first = "next", False
        if self.wanted and len(self.open) + 1 == self.wanted:
            self.wanted = 0

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        at, out = 0, []
        while at < len(piece) and self.valid:
            if self.quote:
                at = self._string(piece, at, out)
            elif self.scalar:
                at = self._number(piece, at, out)
            else:
                at = self._structure(piece, at, out)
        if out:
            yield self.member, "".join(out)

    def _string(self, piece: str, at: int, out: list[str]) -> int:
        raw = self.wanted and self.raw
        give = self.wanted and not self.raw
        if self.pending:
            self.pending += piece[at]
            if raw:
                out.append(piece[at])
            if len(self.pending) == 2 and self.pending[1] != "u":
                plain = self._ESCAPES.get(self.pending[1]) or ("'" if self.pending[1] == "'" else None)
                if plain is None:
                    self._fail()
                else:
                    self._put(plain, give, out)
                self.pending = ""
            elif len(self.pending) == 6:
                try:
                    code = int(self.pending[2:], 16) if re.fullmatch("[0-9a-fA-F]{4}", self.pending[2:]) else -1
                except ValueError:
                    code = -1
                self.pending = ""
                if code < 0:
                    self._fail()
                elif self.high and 0xDC00 <= code < 0xE000:
                    joined = chr(0x10000 + ((self.high - 0xD800) << 10) + (code - 0xDC00))
                    self.high = 0
                    self._put(joined, give, out)
                elif 0xD800 <= code < 0xDC00:
                    self._put("", give, out)
                    self.high = code
                else:
                    self._put("?" if 0xDC00 <= code < 0xE000 else chr(code), give, out)
            return at + 1
        plain = self._PLAIN[self.quote].match(piece, at)
        if plain:
            self._put(plain[0], give, out)
            if raw:
                out.append(plain[0])
            return plain.end()
        c = piece[at]
        if raw:
            out.append(c)
        if c == "\\":
            self.pending = "\\"
        elif c == self.quote:
            self._put("", give, out)
            self.quote = ""
            if self.expect == "key":
                self.expect = "colon"
                if self.key is not None:
                    self.name, self.key = "".join(self.key), None
            else:
                self._ended()
        else:
            self._fail()  # a control character
        return at + 1

    def _put(self, text: str, give: int, out: list[str]) -> None:
        """Characters of a string; half a surrogate pair before them stands alone."""
        if self.high:
            text, self.high = "?" + text, 0
        if give:
            out.append(text)
        elif self.key is not None and sum(map(len, self.key)) <= 8:
            self.key.append(text)

    def _number(self, piece: str, at: int, out: list[str]) -> int:
        c = piece[at]
        if c.isalnum() or c in "+-.":
            self.scalar += c
            if len(self.scalar) > self.NUMBER + 20:
                self._fail()
            return at + 1
        self._close_scalar(out)
        return at

    def _close_scalar(self, out: list[str]) -> None:
        if not self._SCALAR.fullmatch(self.scalar):
            self._fail()
        if self.wanted:
            if self.scalar == "null" and self.wanted == len(self.open) + 1:
                self.found = None
            else:
                out.append(self.scalar)
        self.scalar = ""
        self._ended()

    def _structure(self, piece: str, at: int, out: list[str]) -> int:
        c = piece[at]
        if c in " \t\r\n":
            if self.wanted and self.raw:
                out.append(c)
            return at + 1
        if self.expect == "value" and c not in "]},:":
            self._begin(c in "\"'")
            if c in "{[":
                self.open.append(c)
                self.expect, self.first = ("key" if c == "{" else "value"), True
                if len(self.open) > self.DEPTH:
                    self._fail()
            elif c in "\"'":
                self.quote = c
            else:
                self.scalar = c
                return at + 1
        elif self.expect == "key" and c in "\"'":
            self.quote, self.first = c, False
            self.key = [] if len(self.open) == 1 else None
        elif self.expect == "colon" and c == ":":
            self.expect = "value"
        elif self.expect == "next" and c == "," and self.open:
            self.expect = "key" if self.open[-1] == "{" else "value"
        elif self.open and c == {"{": "}", "[": "]"}[self.open[-1]] and (self.expect == "next" or self.first):
            self.open.pop()
            if self.wanted and self.raw:
                out.append(c)
            self._ended()
            return at + 1
        else:
            self._fail()
            return at + 1
        if self.wanted and self.raw:
            out.append(c)
        return at + 1

    def end(self) -> tuple[int | None, str]:
        """Which member holds (none if the value is malformed or has no text), and what was left of it."""
        out: list[str] = []
        if self.scalar and self.valid:
            self._close_scalar(out)
        done = self.valid and not self.open and not self.quote and self.expect == "next"
        return (self.found if done else None), "".join(out)


def _long_texts(parts: DataFrame) -> DataFrame:
    """`(stream_id, chunk, pos, sub, text)` of the frames whose lines come in parts.

    Parts of a line are dealt to one task and sorted there; the task reads them one after the other.
    """
    ids = parts.schema["stream_id"].dataType.simpleString()
    chunk_type = parts.schema["chunk"].dataType.simpleString()
    ddl = f"stream_id {ids}, chunk {chunk_type}, pos int, member int, sub bigint, text string, holds boolean"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, line, sub = None, None, 0

        def row(schema, member, text, holds=False):
            return pa.RecordBatch.from_pylist([{
                "stream_id": line[0], "chunk": line[1], "pos": line[2], "member": member, "sub": sub, "text": text, "holds": holds,
            }], schema=schema)

        for batch in batches:
            schema = pa.schema([
                *[batch.schema.field(c) for c in ("stream_id", "chunk", "pos")], ("member", pa.int32()),
                ("sub", pa.int64()), ("text", pa.string()), ("holds", pa.bool_()),
            ])
            for r in batch.to_pylist():
                if line != (r["stream_id"], r["chunk"], r["pos"]):
                    line, sub, scan, start = (r["stream_id"], r["chunk"], r["pos"]), 0, TextScan(), ""
                piece = r["line"]
                if len(start) < len(PREFIX):
                    take = len(PREFIX) - len(start)
                    start, piece = start + piece[:take], piece[take:]
                    scan.valid = scan.valid and PREFIX.startswith(start)
                for member, text in scan.feed(piece):
                    yield row(schema, member, text)
                    sub += 1
                if r["last"]:
                    holds, rest = scan.end()
                    if rest:
                        yield row(schema, scan.member, rest)
                        sub += 1
                    if holds is not None and len(start) == len(PREFIX):
                        yield row(schema, holds, None, True)

    send_package(parts.sparkSession)
    key = ["stream_id", "chunk", "pos"]
    dealt = parts.repartition(*key).sortWithinPartitions(*key, "part")
    read_out = cut(dealt.mapInArrow(read, ddl))
    holding = read_out.filter("holds").select(*key, "member")
    return read_out.filter(~F.col("holds")).join(holding, [*key, "member"], "left_semi").select(*key, "sub", "text")


def reassemble_stream(chunks: DataFrame, per_part: int = TURNS_PER_PART, part_chars: int = CHARS_PER_PART,
                      then: tuple[str, ...] = ()) -> DataFrame:
    """`(stream_id, part, text)`: texts joined in order, parts from 0; the parts in order are the whole text.

    chunks  (stream_id, ord, sub, text), ordered by `ord`, `sub` and the columns in `then`, each place once per stream

    A frame weighs its characters and part_chars / per_part more; a part holds the frames
    that start within `part_chars` of that weight. So no part has more than `per_part`
    frames or, but for its last frame, `part_chars` characters, and neither a stream nor
    one `ord` with many frames has to fit one task. Numbers of empty parts are left out.
    """
    weight = F.length("text") + part_chars // per_part
    placed = running_total(chunks, ["stream_id"], "ord", weight, "upto", then=("sub", *then))
    part = F.call_function("div", F.col("upto") - weight, F.lit(part_chars).cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "sub", *then, "text")))
    return placed.withColumn("part", part).groupBy("stream_id", "part").agg(
        F.array_join(F.transform(ordered, lambda c: c["text"]), "").alias("text")
    )
