"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

The model predicts the class of a token: one of the most frequent tokens, or one of a
fixed number of hashed classes that share all others; within a hashed class a token has
its smoothed share of the class's count. Two positions of context are combined linearly:
the class of the token before, and the last anchor (a very frequent token) before that.
There are few enough contexts to normalise each once, by products of batches of context
vectors with all class vectors.

Counts, and what training gathers, come from every training document. Each scan task
trains on its own documents from the same start; the parameters are averaged, weighted
by tokens, row by row in Spark. Only tables of fixed size reach the driver: the
frequent tokens, class totals, and the parameters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from srcgraph.functions.joins import keyed_join
from srcgraph.llm.common import Batches, cut, kept, map_batches, texts, with_id

#: Sizes of the model: classes of one token, hashed classes, anchors, dimensions.
SINGLE, HASHED, ANCHORS, DIMS = 4096, 64, 32, 16
#: Most tokens whose counts are sent to every task, and bytes of one of them; others are counted by a join.
KNOWN, KNOWN_BYTES = 1 << 18, 64
NOISE, BATCH, RATE = 64, 1024, 0.2
#: Each pass trains on one in so many training documents, from the averaged parameters of the pass before.
PASSES = (8, 1)
FLUSH = 400_000
#: Tokens scored at once.
CHUNK = 1 << 17
#: The token after the last word; no word is empty.
END = b""


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


# -- counts ---------------------------------------------------------------------------------------

def _count(batches: Batches) -> Batches:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"],
        )

    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(words_of(text))
            counts[END] += 1
            if len(counts) >= FLUSH:
                yield flush()
                counts.clear()
    if counts:
        yield flush()


def count_tokens(rows: DataFrame) -> DataFrame:
    """(word, n) over all texts of `rows` (id, text), each counted in its task first."""
    return map_batches(rows, _count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Totals, and the counts of the most frequent tokens in order; the first are classes of their own."""

    tokens: int
    distinct: int
    known: list[tuple[bytes, int]]
    hashed_tokens: np.ndarray
    hashed_distinct: np.ndarray

    def __post_init__(self):
        self.single = min(SINGLE, len(self.known))
        self.classes = self.single + HASHED
        #: kept once, as numbers by word and counts by number
        own, self.known = self.known, []
        self.counts = np.array([n for _, n in own], np.int64)
        self.number = {w: i for i, (w, _) in enumerate(own)}
        self.class_of = np.array(
            [i if i < self.single else self.hashed_class(w) for i, (w, _) in enumerate(own)], np.int64,
        )
        rest, kinds = self.hashed_tokens.copy(), self.hashed_distinct.copy()
        for w, n in own[:self.single]:
            rest[crc32(w) % HASHED] -= n
            kinds[crc32(w) % HASHED] -= 1
        #: what divides (count + 1) of a token of a hashed class: its tokens, its kinds, and one kind for unknown ones
        self.divisor = (rest + kinds + 1).astype(np.float64)
        mass = np.concatenate([self.counts[:self.single], rest]).astype(np.float64) + 1
        self.share = mass / mass.sum()

    def hashed_class(self, word: bytes) -> int:
        return self.single + crc32(word) % HASHED


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded part of the counts that goes to the driver and the tasks."""
    bucket = (F.crc32("word") % HASHED).alias("bucket")
    totals = counts.groupBy(bucket).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tokens, kinds = np.zeros(HASHED, np.int64), np.zeros(HASHED, np.int64)
    for r in totals:
        tokens[r["bucket"]], kinds[r["bucket"]] = r["n"], r["v"]
    # a sort for the first KNOWN would end in one task; instead counts are put on rungs of a few per cent
    rung = F.floor(F.log2(F.col("n").cast("double")) * 16)
    short = counts.filter(F.octet_length("word") <= KNOWN_BYTES).withColumn("rung", rung)
    sizes = {r["rung"]: r["v"] for r in short.groupBy("rung").agg(F.count("*").alias("v")).collect()}
    lowest, taken = max(sizes, default=0) + 1, 0
    for step in sorted(sizes, reverse=True):
        taken += sizes[step]
        if taken > KNOWN:
            break
        lowest = step
    top = short.filter(F.col("rung") >= lowest).select("word", "n")
    table = top.toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    known = list(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))
    return Vocabulary(int(tokens.sum()), int(kinds.sum()), known, tokens, kinds)


# -- the model ------------------------------------------------------------------------------------

@dataclass
class Model:
    """Vectors of context classes (one more for the start), anchors (one more for none) and predicted classes."""

    before: np.ndarray
    anchor: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, words: Vocabulary, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)

        def small(n: int) -> np.ndarray:
            return rng.normal(0, 0.1, (n, DIMS)).astype(np.float32)

        return cls(
            small(words.classes + 1), small(ANCHORS + 1), small(words.classes), np.log(words.share).astype(np.float32),
        )

    def rows(self) -> np.ndarray:
        """All parameters as rows of DIMS + 1 numbers."""
        parts = [np.pad(p, ((0, 0), (0, 1))) for p in (self.before, self.anchor)]
        return np.concatenate([*parts, np.concatenate([self.out, self.bias[:, None]], axis=1)])

    def with_rows(self, rows: np.ndarray) -> Model:
        a, b = len(self.before), len(self.before) + len(self.anchor)
        rows = rows.astype(np.float32)
        return Model(rows[:a, :DIMS], rows[a:b, :DIMS], rows[b:, :DIMS], rows[b:, DIMS])


def contexts(classes: np.ndarray, anchors: int, classes_in_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Per token of one text the class before it, and the last anchor before that; anchors are the first classes."""
    n = len(classes)
    before = np.empty(n, np.int64)
    before[0] = classes_in_all
    before[1:] = classes[:-1]
    place = np.where(before < anchors, np.arange(n), -1)
    latest = np.maximum.accumulate(place)
    previous = np.concatenate([[-1], latest[:-1]])
    return before, np.where(previous >= 0, before[previous], anchors)


def encode(words: Vocabulary, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of the tokens (-1 if not among the known ones), their classes, and the tokens not known."""
    tokens = words_of(text)
    tokens.append(END)
    number = np.fromiter(map(words.number.get, tokens, repeat(-1)), np.int64, len(tokens))
    unknown = np.flatnonzero(number < 0)
    classes = words.class_of[number] if len(words.class_of) else np.zeros(len(number), np.int64)
    rest = [tokens[i] for i in unknown.tolist()]
    if rest:
        classes[unknown] = [words.hashed_class(w) for w in rest]
    return number, classes, rest


def _scatter(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indexes and the sums of their rows."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive steps: data against noise from the classes' shares, with unnormalised scores."""

    def __init__(self, words: Vocabulary, model: Model, seed: int):
        self.words, self.rng, self.tokens = words, np.random.default_rng(seed), 0
        self.model = Model(*(p.copy() for p in (model.before, model.anchor, model.out, model.bias)))
        self.squares = [np.full(p.shape, 1e-3, np.float32) for p in (model.before, model.anchor, model.out, model.bias)]
        self.log_noise = np.log(NOISE * words.share).astype(np.float32)
        self.steps_of_noise = np.cumsum(words.share)

    def _update(self, part: int, index: np.ndarray, values: np.ndarray) -> None:
        weights = (self.model.before, self.model.anchor, self.model.out, self.model.bias)[part]
        rows, grad = _scatter(index, values)
        square = self.squares[part]
        square[rows] += grad * grad
        weights[rows] += RATE * grad / np.sqrt(square[rows])

    def step(self, before: np.ndarray, anchor: np.ndarray, target: np.ndarray) -> None:
        m = self.model
        self.tokens += len(target)
        context = m.before[before] + m.anchor[anchor]
        noise = np.minimum(np.searchsorted(self.steps_of_noise, self.rng.random(NOISE)), self.words.classes - 1)
        out = m.out[target]
        real = (context * out).sum(axis=1) + m.bias[target] - self.log_noise[target]
        fake = context @ m.out[noise].T + m.bias[noise] - self.log_noise[noise]
        scale = np.float32(1 / 64)
        d_real = (0.5 - 0.5 * np.tanh(0.5 * real)) * scale
        d_fake = -(0.5 + 0.5 * np.tanh(0.5 * fake)) * scale
        d_context = d_real[:, None] * out + d_fake @ m.out[noise]
        where = np.concatenate([target, noise])
        self._update(2, where, np.concatenate([d_real[:, None] * context, d_fake.T @ context]))
        self._update(3, where, np.concatenate([d_real, d_fake.sum(axis=0)]))
        self._update(0, before, d_context)
        self._update(1, anchor, d_context)


def _train_task(words, model) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        task = TaskContext.get()
        trainer = Trainer(words.value, model.value, task.partitionId() if task else 0)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        anchors = min(ANCHORS, words.value.single)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                _, classes, _ = encode(words.value, text)
                held.append((*contexts(classes, anchors, words.value.classes), classes))
                size += len(classes)
                if size >= BATCH:
                    parts = [np.concatenate(p) for p in zip(*held)]
                    for at in range(0, size, BATCH):
                        trainer.step(*(p[at:at + BATCH] for p in parts))
                    held, size = [], 0
        if held:
            trainer.step(*(np.concatenate(p) for p in zip(*held)))
        if trainer.tokens:
            rows = trainer.model.rows()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), trainer.tokens)),
                 *(pa.array(rows[:, d].astype(np.float64)) for d in range(DIMS + 1))],
                names=["row", "tokens", *(f"v{d}" for d in range(DIMS + 1))],
            )
    return run


def train(rows: DataFrame, words: Vocabulary) -> Model:
    """Train on `rows` (id, text): every task on its own documents, then an average weighted by tokens."""
    context = rows.sparkSession.sparkContext
    model = Model.start(words)
    sent_words = context.broadcast(words)
    columns = [f"v{d}" for d in range(DIMS + 1)]
    shape = "row bigint, tokens bigint, " + ", ".join(f"{c} double" for c in columns)
    for one_in in PASSES:
        some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0) if one_in > 1 else rows
        trained = map_batches(some, _train_task(sent_words, context.broadcast(model)), shape)
        mean = [(F.sum(F.col(c) * F.col("tokens")) / F.sum("tokens")).alias(c) for c in columns]
        got = trained.groupBy("row").agg(*mean).toPandas().sort_values("row")
        if len(got):
            model = model.with_rows(got[columns].to_numpy())
    return model


class Scorer:
    """Normalised log10 probabilities of classes in context; normalisers are kept by context."""

    def __init__(self, words: Vocabulary, model: Model):
        self.words, self.model = words, model
        self.anchors = min(ANCHORS, words.single)
        self.normal = np.full((words.classes + 1) * (ANCHORS + 1), np.nan)
        self.weights = np.ascontiguousarray(model.out.T)

    def classes(self, before: np.ndarray, anchor: np.ndarray, target: np.ndarray) -> np.ndarray:
        context = before * (ANCHORS + 1) + anchor
        new = np.unique(context[np.isnan(self.normal[context])])
        for at in range(0, len(new), 256):
            some = new[at:at + 256]
            vectors = self.model.before[some // (ANCHORS + 1)] + self.model.anchor[some % (ANCHORS + 1)]
            scores = vectors @ self.weights + self.model.bias
            top = scores.max(axis=1)
            self.normal[some] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1, dtype=np.float64))
        own = ((self.model.before[before] + self.model.anchor[anchor]) * self.model.out[target]).sum(axis=1)
        return (own + self.model.bias[target] - self.normal[context]) / np.log(10)


def scorer(words, model) -> Scorer:
    """The scorer of this Python process for a broadcast model."""
    return kept(("lm", words.value.tokens, model.value.out.tobytes()), lambda: Scorer(words.value, model.value))


# -- scores ---------------------------------------------------------------------------------------

def _chunks(words: Vocabulary, batch: pa.RecordBatch):
    """The batch's ids and encoded texts, so many at a time that they have about `CHUNK` tokens."""
    first, size, encoded = 0, 0, []
    for i, text in enumerate(batch.column("text")):
        encoded.append(encode(words, text.as_py()))
        size += len(encoded[-1][0])
        if size >= CHUNK or i == batch.num_rows - 1:
            yield batch.column("id").slice(first, len(encoded)), encoded
            first, size, encoded = i + 1, 0, []


def _score_task(words, model, shape: pa.Schema) -> Callable[[Batches], Batches]:
    """Per text one row with what is known here, and one row per distinct token whose count is not.

    A text's row has no word; its sums leave out log10(count + 1) of the tokens not known.
    """
    def run(batches: Batches) -> Batches:
        own = scorer(words, model)
        known = words.value
        log_counts = np.log10(known.counts + 1.0)
        base_divisor = np.log10(known.tokens + known.distinct + 1.0)
        log_divisor = np.log10(known.divisor)
        done = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36

        for batch in batches:
            for ids, encoded in _chunks(known, batch):
                sizes = np.array([len(n) for n, _, _ in encoded])
                first = np.cumsum(sizes) - sizes
                number = np.concatenate([n for n, _, _ in encoded])
                classes = np.concatenate([c for _, c, _ in encoded])
                seen = [contexts(c, own.anchors, known.classes) for _, c, _ in encoded]
                before, anchor = (np.concatenate(p) for p in zip(*seen))
                score = own.classes(before, anchor, classes)
                there = number >= 0
                counted = np.where(there, log_counts[number], 0.0) if len(log_counts) else np.zeros(len(number))
                hashed = classes >= known.single
                score += np.where(hashed, counted - log_divisor[np.where(hashed, classes - known.single, 0)], 0.0)
                rows = done + np.arange(len(encoded))
                done += len(encoded)
                sums = [np.add.reduceat(v, first) for v in (there.astype(np.int64), counted - base_divisor, score)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.nulls(len(rows), pa.binary()), ids, pa.array(sizes), *map(pa.array, sums)],
                    schema=shape,
                )
                rest = [
                    (r, w, n) for r, (_, _, unknown) in zip(rows.tolist(), encoded) for w, n in Counter(unknown).items()
                ]
                if rest:
                    r, w, n = zip(*rest)
                    nothing = [pa.nulls(len(r), shape.field(f).type) for f in ("known", "base", "score")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r, pa.int64()), pa.array(w, pa.binary()), pa.nulls(len(r), shape.field("id").type),
                         pa.array(n, pa.int64()), *nothing], schema=shape,
                    )
    return run


def score_documents(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score): one row per row of `docs`.

    The model and the counts learn from the rows for which `learn` holds. A text's tokens
    are its words and one end; a null text is empty and has the end alone. Scores are sums
    of log10 probabilities: `base_score` of smoothed single counts, `score` of the model.
    Without training rows every token's base is 1 and all classes are those hashed.
    """
    rows = texts(docs, id_col, text_col)
    learned = texts(docs.filter(learn), id_col, text_col)
    counts = cut(count_tokens(learned))
    words = vocabulary(counts)
    model = train(learned, words)
    context = docs.sparkSession.sparkContext
    struct = with_id(docs, id_col, "row bigint, word binary, n bigint, known bigint, base double, score double")
    struct = StructType([struct["row"], struct["word"], struct["id"], *struct.fields[3:]])
    shape = to_arrow_schema(struct)
    scored = cut(map_batches(rows, _score_task(context.broadcast(words), context.broadcast(model), shape), struct))
    rest = keyed_join(
        scored.filter("word IS NOT NULL").select("row", "word", F.col("n").alias("times")), counts, ["word"],
    )
    added = rest.groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"),
    )
    whole = scored.filter("word IS NULL").drop("word").join(added, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return whole.select(
        "id", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
