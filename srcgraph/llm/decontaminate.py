"""Benchmark decontamination by FM-indexes over the training documents.

Each scan task indexes its documents in shards of bounded size and searches all phrases
of a block of the benchmark at once, backwards, through ranks of a wavelet matrix;
occurrences are located from sampled suffix positions and merged into word spans. Only
stretches of benchmark words as long as the shortest phrase can hold an occurrence, so
only those are indexed. Documents are not shuffled; what is sent to the tasks is one
block of the benchmark, whose bytes are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from srcgraph.llm.common import Batches, cut, map_batches, release

WINDOW = 10
BLOCK_BYTES = 16 * 1024 * 1024
SHARD_WORDS = 1 << 19
PIECE_WORDS = 256
SAMPLE = 16

#: Word bytes are 0-9, a-z after lower-casing A-Z, and all bytes of other characters.
FOLD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


class WaveletMatrix:
    """Ranks in a sequence of small numbers, by counts of zero bits on each of its levels."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.zeros: list[np.ndarray] = []
        for level in reversed(range(self.bits)):
            bit = (symbols >> level) & 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(1 - bit, out=before[1:], dtype=np.int32)
            self.zeros.append(before)
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.first = self._walk(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, before in zip(reversed(range(self.bits)), self.zeros):
            zero = before[at]
            at = np.where((symbol >> level) & 1, before[-1] + at - zero, zero)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._walk(symbol, at) - self.first[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by prefix doubling. Zeros are separators, each smaller than the next."""
    n = len(symbols)
    marks = symbols == 0
    rank = symbols + int(marks.sum())
    rank[marks] = np.arange(int(marks.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = new
        step *= 2
        if step >= n or int(rank.max()) == n - 1:
            return order


class FmIndex:
    """FM-index of pieces of numbered words (1 to `top`), each piece at most a few hundred words.

    Pieces end in a separator, so suffixes differ within a piece's length. The first word
    of a piece is always sampled, so locating never leaves the piece.
    """

    def __init__(self, pieces: list[np.ndarray], top: int):
        zero = np.zeros(1, np.int64)
        symbols = np.concatenate([part for p in pieces for part in (p, zero)]).astype(np.int64)
        lengths = np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        inside = np.arange(len(symbols)) - np.repeat(starts, lengths)
        order = suffix_array(symbols)
        self.size = len(symbols)
        self.bwt = symbols[order - 1]
        self.wavelet = WaveletMatrix(self.bwt, top)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))[:-1]])
        sampled = (inside[order] % SAMPLE) == 0
        self.samples = order[sampled]
        self.sampled = sampled
        self.nth_sample = np.cumsum(sampled) - 1
        self.piece_of = np.repeat(np.arange(len(pieces)), lengths)
        self.inside = inside

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.smaller[symbol] + self.wavelet.rank(symbol, at)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases (one a row): rows that occur, first and end of their suffix ranges."""
        row = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[row, column]
            low, high = self._step(symbol, low), self._step(symbol, high)
            found = low < high
            row, low, high = row[found], low[found], high[found]
        return row, low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix range in turn, the pieces and places in them at which its suffixes start."""
        count = high - low
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        place = np.full(len(at), -1, np.int64)
        open_ = np.arange(len(at))
        for walked in range(SAMPLE):
            known = self.sampled[at]
            place[open_[known]] = self.samples[self.nth_sample[at[known]]] + walked
            open_, at = open_[~known], at[~known]
            if not len(at):
                break
            at = self._step(self.bwt[at], at)
        return self.piece_of[place], self.inside[place]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Phrases:
    """A block of benchmark phrases: word numbers, phrases by length, and the items that have each phrase."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            numbers = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            for start in range(max(1, len(numbers) - window + 1)):
                phrase = tuple(numbers[start:start + window])
                if phrase:
                    owners.setdefault(phrase, set()).add(item)
        self.by_length: list[tuple[np.ndarray, list[list[str]]]] = []
        for length in sorted({len(p) for p in owners}):
            own = [p for p in owners if len(p) == length]
            self.by_length.append((np.array(own, np.int64), [sorted(owners[p]) for p in own]))
        self.shortest = min((len(p) for p in owners), default=0)
        self.longest = max((len(p) for p in owners), default=0)

    def candidates(self, words: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """Pieces (first word, word numbers) of the stretches that may hold a phrase.

        Neighbouring pieces of a long stretch share all but one word of the longest phrase.
        """
        numbers = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], numbers > 0, [0]])))
        out = []
        for first, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - first < self.shortest:
                continue
            size = max(PIECE_WORDS, 2 * self.longest)
            step = size - self.longest + 1
            for at in range(first, max(first + 1, end - self.longest + 1), step):
                out.append((at, numbers[at:min(end, at + size)]))
        return out

    def find(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Per text its words, the merged spans of words inside an occurrence, and the items found.

        Of a text's words only the pieces to index are kept while the others are read.
        """
        sizes: list[int] = []
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        shard, size = [], 0
        for number, text in enumerate(texts):
            words = words_of(text)
            sizes.append(len(words))
            for at, piece in self.candidates(words) if self.shortest else ():
                shard.append((number, at, piece))
                size += len(piece) + 1
                if size >= SHARD_WORDS:
                    self._search(shard, spans, items)
                    shard, size = [], 0
        if shard:
            self._search(shard, spans, items)
        return [(n, merged(s), i) for n, s, i in zip(sizes, spans, items)]

    def _search(self, shard: list, spans: list, items: list) -> None:
        index = FmIndex([piece for _, _, piece in shard], len(self.number))
        for phrases, owners in self.by_length:
            row, low, high = index.search(phrases)
            if not len(row):
                continue
            piece, inside = index.locate(low, high)
            length = phrases.shape[1]
            for phrase, p, at in zip(np.repeat(row, high - low).tolist(), piece.tolist(), inside.tolist()):
                number, first, _ = shard[p]
                spans[number].append((first + at, first + at + length))
                items[number].update(owners[phrase])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    inside = np.frombuffer(text.translate(FOLD), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    out, done = [], 0
    for first, end in spans:
        out.append(text[done:edge[2 * first]])
        done = edge[2 * end - 1]
    return b"".join([*out, text[done:]])


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of bounded bytes; one block at a time is on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        words = words_of((row[1] or "").encode())
        if words:
            block.append((row[0] or "", words))
            size += sum(map(len, words))
        if size >= BLOCK_BYTES:
            yield Phrases(block, window)
            block, size = [], 0
    if block:
        yield Phrases(block, window)


def _bodies(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


FOUND = "n_words bigint, spans array<struct<first:bigint,end:bigint>>, items array<string>"


def find_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """(id, n_words, spans, items): merged word spans of benchmark phrases, and the items they belong to, sorted.

    A phrase is `window` consecutive words of an item, or a shorter item whole. Null and
    empty texts have no words; items without words have no phrases; repeated items count
    once by their id as text, a null id as empty text. One row per row of `docs`.
    """
    context = docs.sparkSession.sparkContext
    struct = StructType.fromDDL(FOUND)
    shape = StructType([
        StructField("id", docs.schema[id_col].dataType), StructField("body", docs.schema[text_col].dataType), *struct.fields,
    ])
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in struct.fields]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"), *empty)

    def search(rows: DataFrame, phrases: Phrases) -> DataFrame:
        sent = context.broadcast(phrases)

        def run(batches: Batches) -> Batches:
            for batch in batches:
                found_ = sent.value.find(_bodies(batch, "body"))
                before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
                spans, items = [], []
                for (_, new, found), (old, old_items) in zip(found_, before):
                    spans.append([
                        {"first": a, "end": b} for a, b in merged([*new, *((s["first"], s["end"]) for s in old or ())])
                    ])
                    items.append(sorted(found.union(old_items or ())))
                counts = pa.array([n for n, _, _ in found_], pa.int64())
                columns = [batch.column("id"), batch.column("body"), counts]
                for name, values in (("spans", spans), ("items", items)):
                    columns.append(pa.array(values, batch.schema.field(name).type))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "body", "n_words", "spans", "items"])

        return map_batches(rows, run, shape)

    done = 0
    for phrases in blocks(benchmark, item_col, item_text_col, window):
        rows = search(cut(rows) if done else rows, phrases)
        done += 1
    if not done:
        rows = search(rows, Phrases([], window))
    return rows.drop("body")


def contamination(found: DataFrame) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) from what `find_spans` gives."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["first"])
    return found.select(
        "id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def remove_passages(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, length_col: str | None = None,
) -> DataFrame:
    """All rows and columns of `docs`, benchmark passages cut out of their texts.

    Cutting goes on until no phrase is left, also none that a cut has put together.
    `length_col`, if given, becomes the code points of texts that changed. Documents
    stay, even when nothing is left of their text; untouched texts stay as they are.
    """
    context = docs.sparkSession.sparkContext

    def clean(docs: DataFrame, phrases: Phrases) -> DataFrame:
        sent = context.broadcast(phrases)

        def run(batches: Batches) -> Batches:
            release()
            for batch in batches:
                bodies = _bodies(batch, text_col)
                changed: set[int] = set()
                open_ = list(range(len(bodies)))
                while open_:
                    found = sent.value.find([bodies[i] for i in open_])
                    hit = [(i, spans) for i, (_, spans, _) in zip(open_, found) if spans]
                    for i, spans in hit:
                        bodies[i] = without(bodies[i], spans)
                    open_ = [i for i, _ in hit]
                    changed.update(open_)
                yield _changed(batch, changed, bodies, text_col, length_col)

        return map_batches(docs, run, docs.schema)

    found = list(zip(range(2), blocks(benchmark, item_col, item_text_col, window)))
    if not found:
        return docs
    if len(found) == 1:
        return clean(docs, found[0][1])
    while True:  # more than one block: a cut for one may put together a phrase of another
        for phrases in blocks(benchmark, item_col, item_text_col, window):
            docs = cut(clean(docs, phrases))
        left = find_spans(docs, benchmark, docs.columns[0], text_col, item_col, item_text_col, window)
        if left.filter(F.size("spans") > 0).isEmpty():
            return docs


def _changed(
    batch: pa.RecordBatch, changed: set[int], bodies: list[bytes], text_col: str, length_col: str | None,
) -> pa.RecordBatch:
    if not changed:
        return batch
    names = batch.schema.names
    columns = list(batch.columns)
    at = names.index(text_col)
    texts = columns[at].to_pylist()
    lengths = columns[names.index(length_col)].to_pylist() if length_col in names else None
    for i in changed:
        texts[i] = bodies[i].decode()
        if lengths is not None:
            lengths[i] = len(texts[i])
    columns[at] = pa.array(texts, columns[at].type)
    if lengths is not None:
        columns[names.index(length_col)] = pa.array(lengths, columns[names.index(length_col)].type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)
