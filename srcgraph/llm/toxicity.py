"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a word (a hashed embedding and how much more often toxic documents
have it) and as characters (the mean of its bytes' embeddings, and how much more often
toxic documents have its character n-grams, at most and on average). Every window of 32
consecutive words is scored: a word's states are the same for all windows that hold it
(each direction has read at least 16 words before the word, or all there are), and a
window pools its words' states by attention, so windows cost sums only. A document's
score is that of its most toxic window, a shorter one is a window; training learns from
the most toxic windows of labelled documents.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import Batches, kept, map_batches, texts, with_id
from srcgraph.llm.decontaminate import words_of
from srcgraph.llm.labelled import sample_ids, sampled

#: Words of a window (a power of two), words read before a row's own ones, and a row's own words in scoring.
WINDOW, CONTEXT, CORE = 32, 16, 96
HIDDEN, EMBED = 8, 4
STAT_BITS, WORD_BITS = 18, 13
NGRAMS = (4, 5)
INPUTS = 3 + 2 * EMBED
#: Bounds of the sample the model is fitted on: documents per class, and code points of one of them.
PER_CLASS, SAMPLE_CHARS = 2000, 65_536
ROUNDS, LEAST_STEPS, BATCH = 6, 160, 256
MAX_WORDS = 60_000
CHUNK, GROUP_WORDS = 1024, 98_304


@dataclass
class Words:
    """Distinct words: their bytes one after the other, their buckets, and the buckets of their n-grams likewise."""

    letters: np.ndarray
    lengths: np.ndarray
    own: np.ndarray
    grams: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Words:
        mask = (1 << STAT_BITS) - 1
        grams = array("i")
        sizes = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            ended = b"<" + word + b">"
            before = len(grams)
            for n in NGRAMS:
                grams.extend([crc32(ended[k:k + n]) & mask for k in range(len(ended) - n + 1)])
            if len(grams) == before:
                grams.append(crc32(ended) & mask)
            sizes[i] = len(grams) - before
        return cls(
            np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64),
            np.array([crc32(w) & mask for w in words], np.int64), np.array(grams, np.int32), sizes,
        )

    def take(self, index: np.ndarray) -> Words:
        return Words(
            self.letters[_stretches(self.lengths, index)], self.lengths[index], self.own[index],
            self.grams[_stretches(self.sizes, index)], self.sizes[index],
        )


def _stretches(sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Places of the stretches with these numbers among stretches of these sizes that lie one after the other."""
    starts = (np.cumsum(sizes) - sizes)[index]
    own = sizes[index]
    return np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))


@dataclass
class Net:
    """Parameters. Gates: update, reset, candidate; direction 0 reads forwards, 1 backwards."""

    word_odds: np.ndarray
    gram_odds: np.ndarray
    words: np.ndarray
    bytes_: np.ndarray
    enter: np.ndarray
    bias: np.ndarray
    recur: np.ndarray
    attend: np.ndarray
    out: np.ndarray
    base: np.ndarray

    TRAINED = ("words", "bytes_", "enter", "bias", "recur", "attend", "out", "base")

    @classmethod
    def start(cls, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)

        def small(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        return cls(
            word_odds, gram_odds, small(1 << WORD_BITS, EMBED, scale=0.05), small(256, EMBED, scale=0.05),
            small(INPUTS, 6 * HIDDEN, scale=0.3), np.zeros(6 * HIDDEN, np.float32),
            small(2, HIDDEN, 3 * HIDDEN, scale=0.3), small(2 * HIDDEN, scale=0.3), small(2 * HIDDEN, scale=0.5),
            np.full(1, -1.0, np.float32),
        )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def word_inputs(net: Net, words: Words) -> np.ndarray:
    """Input vector of each distinct word."""
    starts = np.cumsum(words.sizes) - words.sizes
    grams = net.gram_odds[words.grams]
    first = np.cumsum(words.lengths) - words.lengths
    out = np.empty((len(words.own), INPUTS), np.float32)
    out[:, 0] = net.word_odds[words.own]
    out[:, 1] = np.maximum.reduceat(grams, starts)
    out[:, 2] = np.add.reduceat(grams, starts) / words.sizes
    out[:, 3:3 + EMBED] = net.words[words.own & ((1 << WORD_BITS) - 1)]
    out[:, 3 + EMBED:] = np.add.reduceat(net.bytes_[words.letters], first, axis=0) / words.lengths[:, None]
    return out


def _states(net: Net, gates: np.ndarray, there: np.ndarray, keep: bool = False):
    """States of both directions at the own words of rows: (own words, rows, 2 * HIDDEN), in the order of the text.

    gates: (time, 2, rows, 3 * HIDDEN), each direction in its own time order, its first `CONTEXT` places before the
    own words. there: (time, 2, rows), False where the text has no word; such a place leaves the state as it is.
    """
    time, _, n, _ = gates.shape
    h = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((time, 2, n, HIDDEN), np.float32)
    kept = []
    for t in range(time):
        a = h @ net.recur
        zr = _sigmoid(gates[t, ..., :2 * HIDDEN] + a[..., :2 * HIDDEN])
        z, r = zr[..., :HIDDEN] * there[t, ..., None], zr[..., HIDDEN:]
        c = np.tanh(gates[t, ..., 2 * HIDDEN:] + r * a[..., 2 * HIDDEN:])
        if keep:
            kept.append((h, z, r, c, a[..., 2 * HIDDEN:]))
        h = h + z * (c - h)
        states[t] = h
    both = np.concatenate([states[CONTEXT:, 0], states[CONTEXT:, 1][::-1]], axis=-1)
    return (both, kept) if keep else both


def _run(net: Net, gates: np.ndarray, there: np.ndarray, keep: bool = False):
    """Logits of windows, one a row. Windows without words get the logit of the bias alone."""
    both, kept = _states(net, gates, there, keep=True)
    attention = np.where(there[CONTEXT:, 0], both @ net.attend, -np.inf)
    top = attention.max(axis=0)
    weight = np.exp(attention - np.where(np.isfinite(top), top, 0))
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", weight, both)
    logit = pooled @ net.out + net.base[0]
    return (logit, both, weight, pooled, kept) if keep else logit


def _gates(net: Net, inputs: np.ndarray) -> np.ndarray:
    return inputs @ net.enter + net.bias


def _timed(projected: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Gate inputs of rows of word numbers (rows, 2, time) in the order `_states` takes them."""
    both = projected.reshape(-1, 3 * HIDDEN)
    return both[(2 * rows + np.arange(2)[None, :, None]).transpose(2, 1, 0)]


@dataclass
class Laid:
    """Documents' word numbers one after the other; where each starts, and its words."""

    flat: np.ndarray
    sizes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Laid:
        sizes = np.array([len(d) for d in docs], np.int64)
        return cls(np.concatenate([*docs, np.zeros(1, np.int32)]), sizes, np.cumsum(sizes) - sizes)

    def rows(self, doc: np.ndarray, start: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (rows, 2, time) for `own` words of documents from `start` on, and whether a word is there."""
        time = np.arange(CONTEXT + own)
        place = start[:, None, None] + np.stack([time - CONTEXT, own + CONTEXT - 1 - time])
        there = (place >= 0) & (place < self.sizes[doc][:, None, None])
        return np.where(there, self.flat[np.where(there, self.first[doc][:, None, None] + place, 0)], 0), there


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of every `WINDOW` consecutive values, by doubling."""
    step = 1
    while step < WINDOW and len(x):
        x = x[:-step] + x[step:]
        step *= 2
    return x


def window_logits(net: Net, projected: np.ndarray, laid: Laid) -> np.ndarray:
    """Logit of the window that starts at each word; -inf where none does. Whole documents are shorter windows."""
    counts = -(-laid.sizes // CORE)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = CORE * (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts))
    weight, value = np.empty((2, len(laid.flat) - 1))
    done = 0
    for at in range(0, len(doc), CHUNK):
        rows, there = laid.rows(doc[at:at + CHUNK], start[at:at + CHUNK], CORE)
        both = _states(net, _timed(projected, rows), there.transpose(2, 1, 0))
        own = there[:, 0, CONTEXT:]
        upto = done + int(own.sum())
        weight[done:upto] = (both @ net.attend).T[own]
        value[done:upto] = (both @ net.out).T[own]
        done = upto
    weight = np.exp(weight)
    value *= weight
    logit = np.full(len(weight), -np.inf)
    within = np.arange(len(weight)) - np.repeat(laid.first, laid.sizes)
    whole = within + WINDOW <= np.repeat(laid.sizes, laid.sizes)
    places = np.flatnonzero(whole)
    if len(places):
        logit[places] = _sums(value)[places] / _sums(weight)[places]
    short = (laid.sizes > 0) & (laid.sizes < WINDOW)
    if short.any():
        some = laid.sizes > 0
        sums = np.add.reduceat(np.stack([value, weight]), laid.first[some], axis=1)[:, short[some]]
        logit[laid.first[short]] = sums[0] / sums[1]
    return logit + net.base[0]


def _tops(net: Net, logit: np.ndarray, laid: Laid) -> np.ndarray:
    """The highest logit of each document; without words the bias alone."""
    top = np.full(len(laid.sizes), float(net.base[0]))
    some = laid.sizes > 0
    if some.any():
        top[some] = np.maximum.reduceat(logit, laid.first[some])
    return top


# -- training -------------------------------------------------------------------------------------

def _odds(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Shrunken log odds of toxic against other documents that have something of a bucket; counts by label."""
    odds = np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))
    seen = counts.sum(axis=0)
    return (np.clip(odds * seen / (seen + 10), -4, 4) / 2).astype(np.float32)


def _gradient(net: Net, words: Words, inputs, index, there, target):
    """Gradients of the mean loss on windows; `index` numbers the words as rows do, `inputs` has their vectors."""
    projected = _gates(net, inputs)
    logit, both, weight, pooled, kept = _run(net, _timed(projected, index), there, keep=True)
    chance = _sigmoid(logit)
    d_logit = ((chance - target) / len(target)).astype(np.float32)
    grads = {"out": pooled.T @ d_logit, "base": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * net.out
    d_weight = np.einsum("nh,tnh->tn", d_pooled, both)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grads["attend"] = np.einsum("tn,tnh->h", d_score, both)
    d_both = weight[..., None] * d_pooled + d_score[..., None] * net.attend
    d_states = np.zeros((len(kept), 2, len(target), HIDDEN), np.float32)
    d_states[CONTEXT:, 0], d_states[CONTEXT:, 1] = d_both[..., :HIDDEN], d_both[::-1, :, HIDDEN:]
    d_gates = np.empty((*d_states.shape[:3], 3 * HIDDEN), np.float32)
    d_recur = np.zeros_like(net.recur)
    d_h = np.zeros_like(d_states[0])
    for t in reversed(range(len(kept))):
        h, z, r, c, a = kept[t]
        d_h = d_h + d_states[t]
        d_c = d_h * z * (1 - c * c)
        d_r = d_c * a * r * (1 - r)
        d_z = d_h * (c - h) * z * (1 - z)
        d_gates[t] = np.concatenate([d_z, d_r, d_c], axis=-1)
        d_a = np.concatenate([d_z, d_r, d_c * r], axis=-1)
        d_recur += h.transpose(0, 2, 1) @ d_a
        d_h = d_h * (1 - z) + d_a @ net.recur.transpose(0, 2, 1)
    grads["recur"] = d_recur
    d_projected = np.zeros_like(projected)
    for side, part in enumerate((d_projected[:, :3 * HIDDEN], d_projected[:, 3 * HIDDEN:])):
        np.add.at(part, index[:, side].T.ravel(), d_gates[:, side].reshape(-1, 3 * HIDDEN))
    grads["enter"], grads["bias"] = inputs.T @ d_projected, d_projected.sum(axis=0)
    d_inputs = d_projected @ net.enter.T
    grads["words"], grads["bytes_"] = np.zeros_like(net.words), np.zeros_like(net.bytes_)
    np.add.at(grads["words"], words.own & ((1 << WORD_BITS) - 1), d_inputs[:, 3:3 + EMBED])
    of_letters = np.repeat(d_inputs[:, 3 + EMBED:] / words.lengths[:, None], words.lengths, axis=0)
    np.add.at(grads["bytes_"], words.letters, of_letters)
    return grads


class _Adam:
    def __init__(self, net: Net, rate: float):
        self.net, self.rate, self.steps = net, rate, 0
        self.mean = {n: np.zeros_like(getattr(net, n)) for n in Net.TRAINED}
        self.square = {n: np.zeros_like(getattr(net, n)) for n in Net.TRAINED}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for name, grad in grads.items():
            m, s = self.mean[name], self.square[name]
            m += 0.1 * (grad - m)
            s += 0.001 * (grad * grad - s)
            scale = self.rate * (1 - 0.999 ** self.steps) ** 0.5 / (1 - 0.9 ** self.steps)
            setattr(self.net, name, getattr(self.net, name) - scale * m / (np.sqrt(s) + 1e-8))


def train(bodies: list[bytes], labels: list[int], seed: int = 7) -> Net:
    """Fit the network to documents and their labels.

    What the odds say of a document's words never stems from the half of the sample that
    it belongs to. Without documents of both classes the network stays at its start.
    """
    rng = np.random.default_rng(seed)
    target = np.array(labels, np.int64)
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(b)], np.int32) for b in bodies]
    words = Words.of([*number, b"?"])  # so that there is one
    del number, bodies
    half = rng.permutation(len(docs)) % 2
    word_counts, gram_counts = np.zeros((2, 2, 1 << STAT_BITS)), np.zeros((2, 2, 1 << STAT_BITS))
    totals = np.zeros((2, 2))
    for doc, side, label in zip(docs, half, target):
        some = np.unique(doc)
        word_counts[side, label, np.unique(words.own[some])] += 1
        gram_counts[side, label, np.unique(words.grams[_stretches(words.sizes, some)])] += 1
        totals[side, label] += 1
    net = Net.start(_odds(word_counts.sum(axis=0), totals.sum(axis=0)), _odds(gram_counts.sum(axis=0), totals.sum(axis=0)), seed)
    if len(set(labels)) < 2:
        return net
    odds = [(_odds(word_counts[1 - side], totals[1 - side]), _odds(gram_counts[1 - side], totals[1 - side])) for side in (0, 1)]
    del word_counts, gram_counts
    full = net.word_odds, net.gram_odds
    sides = [np.flatnonzero(half == side) for side in (0, 1)]
    laid = [Laid.of([docs[i] for i in own]) for own in sides]
    adam = _Adam(net, 0.01)
    rounds = max(ROUNDS, min(40, LEAST_STEPS * BATCH // (2 * len(docs))))  # few documents are few steps a round
    for round_ in range(rounds):
        for side in (0, 1):
            net.word_odds, net.gram_odds = odds[side]
            texts_, label = laid[side], target[sides[side]]
            worst, other = _picked(window_logits(net, _gates(net, word_inputs(net, words)), texts_), texts_, label, rng)
            doc = np.concatenate([np.arange(len(label)), other[0]])
            start = np.concatenate([worst, other[1]])
            order = rng.permutation(len(doc))
            doc, start = doc[order], start[order]
            adam.rate = 0.01 if round_ < rounds // 2 else 0.004
            for at in range(0, len(doc), BATCH):
                rows, there = texts_.rows(doc[at:at + BATCH], start[at:at + BATCH], WINDOW)
                used, index = np.unique(rows, return_inverse=True)
                some = words.take(used)
                adam.step(_gradient(
                    net, some, word_inputs(net, some), index.reshape(rows.shape), there.transpose(2, 1, 0),
                    label[doc[at:at + BATCH]].astype(np.float32),
                ))
    net.word_odds, net.gram_odds = full
    return net


def _picked(logit: np.ndarray, laid: Laid, label: np.ndarray, rng) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Where each document's most toxic window starts; as many windows of clean documents by chance, as (doc, start)."""
    worst = np.array([
        int(logit[f:f + n].argmax()) if n else 0 for f, n in zip(laid.first.tolist(), laid.sizes.tolist())
    ], np.int64)
    clean = np.flatnonzero(label == 0)
    if not len(clean):
        return worst, (worst[:0], worst[:0])
    count = np.maximum(laid.sizes[clean] - WINDOW + 1, 1)  # windows of each document
    chosen = rng.integers(0, int(count.sum()), min(int(count.sum()), len(label)))
    at = np.searchsorted(np.cumsum(count), chosen, side="right")
    return worst, (clean[at], chosen - (np.cumsum(count) - count)[at])


# -- scoring --------------------------------------------------------------------------------------

class Scorer:
    """Scores documents; gate inputs of the words met are kept, up to `MAX_WORDS` of them."""

    def __init__(self, net: Net):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.projected = np.zeros((1, 6 * HIDDEN), np.float32)

    def score(self, bodies: list[bytes]) -> np.ndarray:
        """Toxicity of each text: the highest of its windows. A text without words has the bias alone."""
        out = np.empty(len(bodies))
        first, size = 0, 0
        group: list[list[bytes]] = []
        for i, body in enumerate(bodies):
            group.append(words_of(body))
            size += len(group[-1])
            if size >= GROUP_WORDS or i == len(bodies) - 1:
                out[first:i + 1] = self._group(group)
                first, size, group = i + 1, 0, []
        return out

    def _group(self, docs: list[list[bytes]]) -> np.ndarray:
        if len(self.number) > MAX_WORDS:
            self._reset()
        known = self.number
        new = list({w for words in docs for w in words if w not in known})
        if new:
            known.update(zip(new, range(len(known) + 1, len(known) + 1 + len(new))))
            self.projected = np.concatenate([self.projected, _gates(self.net, word_inputs(self.net, Words.of(new)))])
        laid = Laid.of([np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in docs])
        top = _tops(self.net, window_logits(self.net, self.projected, laid), laid)
        return 1 / (1 + np.exp(-top))


def scorer(sent: Broadcast) -> Scorer:
    """The scorer of this Python process for a broadcast network."""
    net = sent.value
    return kept(("toxicity", net.base.tobytes(), net.out.tobytes(), net.enter.tobytes()), lambda: Scorer(net))


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id",
    text_col: str = "text", per_class: int = PER_CLASS,
) -> Net:
    """Train on a bounded sample: up to `per_class` documents of either label, none over `SAMPLE_CHARS` long.

    Of several rows of an id the least text is taken.
    """
    ids = sample_ids(labels, label_col, learn, per_class, id_col)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = sampled(docs.filter(F.length(text) <= SAMPLE_CHARS), ids, id_col)
    one = rows.groupBy(id_col, "__label").agg(F.min(F.coalesce(text_col, F.lit(""))).alias("body"))
    got = one.orderBy(id_col).collect()
    return train([r["body"].encode() for r in got], [r["__label"] for r in got])


def score_documents(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per row of `docs`; null texts are empty ones, which get the score of an empty window."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            score = scorer(sent).score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], names=["id", "score"])

    return map_batches(texts(docs, id_col, text_col), run, with_id(docs, id_col, "score double"))


def drop_toxic(docs: DataFrame, net: Net, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score under `threshold`, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            bodies = [b or b"" for b in batch.column(text_col).cast(pa.binary()).to_pylist()]
            if bodies:
                yield batch.filter(pa.array(scorer(sent).score(bodies) < threshold))

    return map_batches(docs, run, docs.schema)
