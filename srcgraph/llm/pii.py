"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans. A field over the tokens that hold a digit or an @ adds
spans: neighbouring tokens share a chain potential, and distant tokens that are repeated
or similar (same digits, or same letters) share a skip potential, so that a mention whose
own form is broken takes the label of its other mentions. Loopy message passing runs over
the graphs of a whole batch of documents at once. Tokens of base spans have the label of
their span for sure. The field learns from base spans, half of them hidden, and from
their tokens repeated in a form that no pattern finds.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.common import Batches, map_batches, texts, with_id

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the sample the field is fitted on: documents with a digit or an @, and code points of one of them.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 65_536
FEATURE_BITS = 14
ROUNDS = 8
STEPS = 80
SURE = 0.9

#: What the base spans look like. Runs are possessive where a shorter run could not match either.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WHITE = str.maketrans("\t\n\x0b\x0c\r", "     ")
MARK = re.compile(r"[0-9@]")


# -- base spans -----------------------------------------------------------------------------------

def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run before an @ as far as the last match allows, then the longest domain."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, in order; offsets count code points."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if MARK.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- graphs ---------------------------------------------------------------------------------------

def tokens_of(text: str) -> list[tuple[int, int]]:
    """Tokens between ASCII white space that hold a digit or an @."""
    flat = text.translate(WHITE)
    out = []
    found = MARK.search(flat)
    while found:
        start = flat.rfind(" ", 0, found.start()) + 1
        end = flat.find(" ", found.start())
        end = len(flat) if end < 0 else end
        out.append((start, end))
        found = MARK.search(flat, end)
    return out


def _shape(token: str) -> str:
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "0", token[:64]))
    return re.sub(r"(.)\1+", r"\1", shape)


def _key(token: str) -> str:
    """What repeated or similar tokens have in common: around an @ letters and digits, else five digits or more.

    Four groups of up to three digits stay groups, so that an address is not like a number.
    """
    if "@" in token:
        return "".join(c for c in token.lower() if c.isalnum())
    groups = re.findall(r"[0-9]+", token)
    if len(groups) == 4 and max(map(len, groups)) <= 3:
        return ".".join(groups)
    digits = "".join(groups)
    return digits if len(digits) >= 5 else ""


def _features(text: str, tokens: list[tuple[int, int]], at: int) -> list[int]:
    start, end = tokens[at]
    token = text[start:end]
    before = text[max(0, start - 24):start].split()
    after = text[end:end + 24].split()
    digits = sum(c in "0123456789" for c in token)
    names = (
        "bias", f"shape {_shape(token)}", f"digits {min(digits, 20)}", f"length {min(len(token) // 4, 10)}",
        f"at {token.count('@')}", f"dots {min(token.count('.'), 5)}", f"first {token[0]}", f"last {token[-1]}",
        f"before {before[-1].lower() if before else ''}", f"after shape {_shape(after[0]) if after else ''}",
    )
    return [crc32(n.encode()) & ((1 << FEATURE_BITS) - 1) for n in names]


@dataclass
class Graph:
    """Token graphs of several documents: features per node, and edges (from, to, kind), each with its reverse."""

    features: np.ndarray
    source: np.ndarray
    target: np.ndarray
    kind: np.ndarray
    doc: np.ndarray
    spans: list[tuple[int, int]]


FORWARD, BACKWARD, SKIP = 0, 1, 2


def graph_of(bodies: list[str]) -> Graph:
    features, pairs, doc, spans = [], [], [], []
    for number, text in enumerate(bodies):
        tokens = tokens_of(text)
        latest: dict[str, int] = {}
        for i, (start, end) in enumerate(tokens):
            node = len(spans)
            spans.append((start, end))
            doc.append(number)
            features.append(_features(text, tokens, i))
            chained = i and not text[tokens[i - 1][1]:start].strip()
            if chained:
                pairs.append((node - 1, node, FORWARD))
            key = _key(text[start:end])
            if key:  # each mention is linked to the one before it
                if key in latest and not (chained and latest[key] == node - 1):
                    pairs.append((latest[key], node, SKIP))
                latest[key] = node
    edges = np.array(pairs, np.int64).reshape(-1, 3)
    kind = edges[:, 2]
    return Graph(
        np.array(features, np.int64).reshape(len(spans), 10),
        np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]]),
        np.concatenate([kind, np.where(kind == FORWARD, BACKWARD, SKIP)]), np.array(doc, np.int64), spans,
    )


# -- the field ------------------------------------------------------------------------------------

LABELS = len(KINDS) + 1
#: Score of the labels that a token with a known label does not have.
CERTAIN = -30.0


@dataclass
class Field:
    """Weights of features by label, and potentials of chain and skip edges by the labels at their ends."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def potentials(self) -> np.ndarray:
        return np.stack([self.chain, self.chain.T, (self.skip + self.skip.T) / 2])


def _normal(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=-1, keepdims=True)
    return scores - top - np.log(np.exp(scores - top).sum(axis=-1, keepdims=True))


def infer(field: Field, graph: Graph, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of nodes and of edges (first half of the edge list) by loopy sum-product passing, damped.

    `known`: labels of nodes that are certain, 0 for the others.
    """
    own = field.unary[graph.features].sum(axis=1)
    if known is not None:
        sure = np.flatnonzero(known)
        own[sure] = CERTAIN
        own[sure, known[sure]] = 0
    potential = field.potentials()[graph.kind]
    edges = len(graph.source)
    back = np.concatenate([np.arange(edges // 2, edges), np.arange(edges // 2)])
    message = np.zeros((edges, LABELS))

    def beliefs() -> np.ndarray:
        got = own.copy()
        np.add.at(got, graph.target, message)
        return got

    for _ in range(ROUNDS if edges else 0):
        out = beliefs()[graph.source] - message[back]
        sent = out[:, :, None] + potential
        top = sent.max(axis=1)
        new = _normal(top + np.log(np.exp(sent - top[:, None]).sum(axis=1)))
        message = 0.5 * message + 0.5 * new
    belief = beliefs()
    first = slice(0, edges // 2)
    joint = (
        (belief[graph.source] - message[back])[first, :, None] + (belief[graph.target] - message)[first, None, :]
        + potential[first]
    )
    flat = _normal(joint.reshape(-1, LABELS * LABELS)) if edges else joint.reshape(0, LABELS * LABELS)
    return np.exp(_normal(belief)) if len(belief) else belief, np.exp(flat).reshape(-1, LABELS, LABELS)


def _labels(graph: Graph, bases: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Label of each token: the kind of the base span it overlaps first, 0 for none."""
    out = np.zeros(len(graph.spans), np.int64)
    for node, ((start, end), doc) in enumerate(zip(graph.spans, graph.doc.tolist())):
        for a, kind, b in bases[doc]:
            if a < end and start < b:
                out[node] = kind + 1
                break
    return out


def with_broken(text: str, base: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with lines put after it that repeat tokens of its base spans in forms no pattern finds, and their spans."""
    words, out, spans = text.split(), [text], []
    size = len(text)
    for start, end in tokens_of(text):
        kind = next((k for a, k, b in base if a < end and start < b), None)
        token = text[start:end].strip(".,;:!?()[]{}<>\"'")
        if kind is None or not _key(token):
            continue
        form = re.sub(r"[^\w@]+", rng.choice(["_", "/", "|"]), token.lstrip("+"))
        if base_spans(form) or _key(form) != _key(token):
            continue
        before, after = rng.choice(words)[:24], rng.choice(words)[:24]
        if MARK.search(before + after):
            before = after = "is"
        out.append(f"\n{before} {form} {after}")
        spans.append((size + len(before) + 2, kind, size + len(before) + 2 + len(form)))
        size += len(out[-1])
    return "".join(out), spans


def train(bodies: list[str], seed: int = 7) -> Field:
    """Fit by gradient steps on the log-likelihood, expectations by message passing.

    Every text is taken as it is, and once more with broken repeats where it has base
    spans. Half of the base spans are known as they are later, the others are to be found.
    """
    rng = random.Random(seed)
    field = Field(np.zeros((1 << FEATURE_BITS, LABELS)), np.zeros((LABELS, LABELS)), np.eye(LABELS))
    bases = [base_spans(b) for b in bodies]
    whole = list(bodies)
    spans = [list(b) for b in bases]
    for text, base in zip(bodies, bases):
        if base:
            longer, broken = with_broken(text, base, rng)
            if broken:
                whole.append(longer)
                spans.append([*base, *broken])
                bases.append(base)
    graph = graph_of(whole)
    if not len(graph.spans):
        return field
    label = _labels(graph, spans)
    shown = [[span for span in base if n >= len(bodies) or rng.random() < 0.5] for n, base in enumerate(bases)]
    known = _labels(graph, shown)
    half = len(graph.source) // 2
    source, target, kind = graph.source[:half], graph.target[:half], graph.kind[:half]
    squares = [np.full_like(p, 1e-6) for p in (field.unary, field.chain, field.skip)]
    for _ in range(STEPS):
        node, edge = infer(field, graph, known)
        error = -node
        error[np.arange(len(label)), label] += 1
        error[known > 0] = 0
        grads = [np.zeros_like(field.unary), np.zeros_like(field.chain), np.zeros_like(field.skip)]
        np.add.at(grads[0], graph.features.ravel(), np.repeat(error, graph.features.shape[1], axis=0))
        for number, grad in ((FORWARD, grads[1]), (SKIP, grads[2])):
            own = kind == number
            np.add.at(grad, (label[source[own]], label[target[own]]), 1.0)
            grad -= edge[own].sum(axis=0)
        for weights, grad, square in zip((field.unary, field.chain, field.skip), grads, squares):
            grad = grad / len(label) - 1e-5 * weights
            square += grad * grad
            weights += 0.3 * grad / np.sqrt(square)
    return field


def added_spans(
    text: str, tokens: list[tuple[int, int]], marginal: np.ndarray, base: list[tuple[int, int, int]],
) -> list[tuple[int, int, int]]:
    """Spans of neighbouring tokens whose label is sure and which no base span overlaps, trimmed of punctuation."""
    out: list[tuple[int, int, int]] = []
    label = marginal.argmax(axis=1)
    sure = (label > 0) & (marginal.max(axis=1) >= SURE)
    for i, (start, end) in enumerate(tokens):
        if not sure[i] or any(a < end and start < b for a, _, b in base):
            continue
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while start < end and not text[end - 1].isalnum():
            end -= 1
        if start == end:
            continue
        kind = int(label[i]) - 1
        if out and i and out[-1][1] == kind and sure[i - 1] and not text[tokens[i - 1][1]:tokens[i][0]].strip():
            out[-1] = (out[-1][0], kind, end)
        else:
            out.append((start, kind, end))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_spans(field: Field, bodies: list[str]) -> list[tuple[list, list]]:
    """Per text its base spans, and base and added spans in order."""
    bases = [base_spans(b) if MARK.search(b) else [] for b in bodies]
    marked = [i for i, b in enumerate(bodies) if MARK.search(b)]
    all_spans = list(bases)
    if marked:
        graph = graph_of([bodies[i] for i in marked])
        marginal, _ = infer(field, graph, _labels(graph, [bases[i] for i in marked]))
        edge = np.searchsorted(graph.doc, np.arange(len(marked) + 1))
        for n, i in enumerate(marked):
            own = slice(edge[n], edge[n + 1])
            all_spans[i] = sorted(bases[i] + added_spans(bodies[i], graph.spans[own], marginal[own], bases[i]))
    return list(zip(bases, all_spans))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> Field:
    """Fit on a bounded sample: up to `sample` documents with a digit or an @, none over `SAMPLE_CHARS` long.

    Of several rows of an id the least text is taken.
    """
    text = docs[text_col]
    some = docs.filter(F.length(text).between(1, SAMPLE_CHARS) & text.rlike("[0-9@]") & docs[id_col].isNotNull())
    ids = [r[0] for r in some.select(docs[id_col]).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()]
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(i,) for i in ids], f"__id {docs.schema[id_col].dataType.simpleString()}").distinct()
    rows = some.join(F.broadcast(chosen), some[id_col] == chosen["__id"]).groupBy(chosen["__id"]).agg(F.min(some[text_col]).alias("body"))
    return train(sorted(r["body"] for r in rows.collect()))


def find_personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans): one row per row of `docs`.

    The counts and `base` are of base spans; `spans` has added ones as well. Both are
    kind:start:end in order of start, then kind, joined by commas; ends are exclusive.
    Null and empty texts have none; bytes that are no UTF-8 count as U+FFFD.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = find_spans(sent.value, [b.decode(errors="replace") for b in batch.column("text").to_pylist()])
            counts = np.array([[sum(k == n for _, k, _ in base) for n in range(4)] for base, _ in found], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *map(pa.array, counts.reshape(-1, 4).T),
                 pa.array([_joined(b) for b, _ in found], pa.string()),
                 pa.array([_joined(s) for _, s in found], pa.string())],
                names=["id", *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    rest = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string"
    return map_batches(texts(docs, id_col, text_col), run, with_id(docs, id_col, rest))
