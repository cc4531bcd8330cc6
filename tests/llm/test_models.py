"""The trained operators: gradients, held-out accuracy, normalised probabilities, exact parts, edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcgraph.llm import lm as L
from srcgraph.llm import pii as P
from srcgraph.llm import quality as Q
from srcgraph.llm import toxicity as T
from srcgraph.llm.common import id_hash_mod


def prose(rnd, n):
    parts = ["the", "an", "on", "tion", "er", "re", "in", "ou", "he", "st"]
    return " ".join("".join(rnd.choices(parts, k=rnd.randrange(1, 4))) for _ in range(n))


# -- toxicity -------------------------------------------------------------------------------------

def insults(rnd, n):
    words = prose(rnd, n).split()
    for _ in range(3):
        words.insert(rnd.randrange(len(words)), rnd.choice(["grobian", "Lump."]) if rnd.random() < 0.6 else "kwusk" + prose(rnd, 1))
    return " ".join(words)


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    net = T.Net.start(rng.normal(size=1 << T.STAT_BITS), rng.normal(size=1 << T.STAT_BITS))
    for name in T.Net.TRAINED:
        setattr(net, name, getattr(net, name).astype(np.float64) * 3)
    words = [b"one", b"two", b"three", b"four", b"five"]
    laid = T.Laid.of([rng.integers(0, 5, n) for n in (40, 4, 9)])
    index, there = laid.rows(np.arange(3), np.array([20, 0, 0]), 6)
    there = there.transpose(2, 1, 0)
    target = np.array([1.0, 0.0, 1.0])
    all_words = T.Words.of(words)

    def inputs():
        return T.word_inputs(net, all_words).astype(np.float64)

    def loss():
        projected = T._gates(net, inputs())
        chance = 1 / (1 + np.exp(-T._run(net, T._timed(projected, index), there)))
        return -(target * np.log(chance) + (1 - target) * np.log(1 - chance)).mean()

    grads = T._gradient(net, all_words, inputs(), index, there, target)
    for name in T.Net.TRAINED:
        weights = getattr(net, name)
        flat = np.abs(grads[name]).ravel().argsort()[-3:]
        for at in flat.tolist():
            place = np.unravel_index(at, weights.shape)
            keep = weights[place]
            weights[place] = keep + 1e-2
            up = loss()
            weights[place] = keep - 1e-2
            down = loss()
            weights[place] = keep
            assert abs((up - down) / 2e-2 - grads[name][place]) < 2e-3, name


def plain_logits(net, vectors):
    """Logit of every window of one document, word by word: states from the block's own context on, softmax by hand."""
    n, hidden = len(vectors), T.HIDDEN

    def gru(side, order):
        h = np.zeros(hidden)
        for i in order:
            x = vectors[i] @ net.enter[:, 3 * hidden * side:3 * hidden * (side + 1)] + net.bias[3 * hidden * side:][:3 * hidden]
            a = h @ net.recur[side]
            z, r = (1 / (1 + np.exp(-(x + a)[k * hidden:(k + 1) * hidden])) for k in (0, 1))
            h = (1 - z) * h + z * np.tanh(x[2 * hidden:] + r * a[2 * hidden:])
        return h

    states = []
    for i in range(n):
        block = i - i % T.CORE
        left, right = max(0, block - T.CONTEXT), min(n, block + T.CORE + T.CONTEXT)
        states.append(np.concatenate([gru(0, range(left, i + 1)), gru(1, range(right - 1, i - 1, -1))]))
    out = []
    for start in range(max(1, n - T.WINDOW + 1)):
        some = np.array(states[start:start + T.WINDOW])
        if not len(some):
            return [float(net.base[0])]
        weight = np.exp(some @ net.attend)
        out.append(float((weight / weight.sum()) @ some @ net.out + net.base[0]))
    return out


def test_every_window_equals_a_plain_forward_pass():
    rng = np.random.default_rng(2)
    net = T.Net.start(rng.normal(size=1 << T.STAT_BITS), rng.normal(size=1 << T.STAT_BITS))
    words = T.Words.of([b"one", b"two", b"three", b"four", b"five", b"six"])
    inputs = T.word_inputs(net, words)
    docs = [rng.integers(0, 6, n) for n in (0, 1, 31, 32, 33, 0, 96, 97, 230)]
    laid = T.Laid.of(docs)
    got = T.window_logits(net, T._gates(net, inputs), laid)
    tops = T._tops(net, got, laid)
    for doc, first, top in zip(docs, laid.first, tops):
        want = plain_logits(net, inputs[doc].astype(float))
        own = got[first:first + len(doc)]
        assert abs(top - max(want)) < 1e-4
        if len(doc):
            assert np.isfinite(own).sum() == len(want) and np.allclose(own[:len(want)], want, atol=1e-4)
    assert T.window_logits(net, T._gates(net, inputs), T.Laid.of([docs[0]])).shape == (0,)


def test_a_verdict_does_not_depend_on_the_place(toxic_net):
    rnd = random.Random(8)
    clean = [w for w in prose(rnd, 400).split()]
    scorer = T.Scorer(toxic_net)
    for length in (8, 12, 16):
        for _ in range(4):
            stretch = insults(rnd, length - 3).split()
            at = range(100, 100 + T.CORE + 8, 5)
            scores = scorer.score([" ".join(clean[:k] + stretch + clean[k:]).encode() for k in at])
            assert len({bool(x >= 0.5) for x in scores}) == 1


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rnd = random.Random(6)
    data = [(i, insults(rnd, 60) if i % 3 == 0 else prose(rnd, 60), int(i % 3 == 0)) for i in range(500)]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in data], "doc_id bigint, text string, id string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(3, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    return docs, labels, {i: y for i, _, y in data}


@pytest.fixture(scope="module")
def toxic_net(toxic_tables):
    docs, labels, _ = toxic_tables
    return T.fit(docs, labels, id_hash_mod(F.col("doc_id"), 5) != 0)


def test_held_out_accuracy_and_filter(spark, toxic_tables, toxic_net):
    docs, labels, truth = toxic_tables
    net = toxic_net
    odd = spark.createDataFrame(
        [(900, None), (901, ""), (902, "..."), (None, "the an on"), (903, prose(random.Random(1), 30_000)), (900, None)],
        "doc_id bigint, text string",
    ).withColumns({"id": F.lit("x"), "score": F.lit(0.5)})
    everything = docs.unionByName(odd)
    got = T.score_documents(everything, net).collect()
    assert len(got) == 506 and all(0 <= r.score <= 1 for r in got)
    scores = {r.id: r.score for r in got}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scores[i] >= 0.5) == truth[i] for i in held) >= 0.93 * len(held)
    assert scores[900] == scores[901] == scores[902] < 0.5
    left = T.drop_toxic(everything, net)
    assert left.columns == everything.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.id) for r in got if r.score < 0.5)


def test_toxicity_without_rows_or_labels(toxic_tables):
    docs, labels, _ = toxic_tables
    net = T.fit(docs, labels.limit(0), F.lit(True))
    assert T.score_documents(docs.limit(0), net).collect() == []
    assert all(0 <= r.score <= 1 for r in T.score_documents(docs.limit(5), net).collect())
    assert T.train([b"a b"], [1]).base.shape == (1,)


# -- quality --------------------------------------------------------------------------------------

def test_rules_in_spark_equal_rules_in_numpy_and_separate(rows):
    rnd = random.Random(2)
    data = []
    for i in range(400):
        text = prose(rnd, rnd.randrange(5, 80)) + "."
        data.append((i, text if i % 2 else text.replace(" ", "&&& ").upper(), i % 2))
    docs = rows([(i, t, 3, "l") for i, t, _ in data], "doc_id bigint, text string, id int, label string")
    labels = rows([(i, y) for i, _, y in data], "doc_id bigint, quality int")
    ensemble = Q.fit(docs, labels, id_hash_mod(F.col("doc_id"), 3) != 1)
    assert 1 <= len(ensemble.rules) < Q.TREES * 8
    odd = rows([(900, None, 1, ""), (901, "", 1, ""), (None, " ", 1, ""), (902, "x" * 300_000, 1, ""), (900, None, 1, "")], docs.schema.simpleString()[7:-1].replace(":", " "))
    everything = docs.unionByName(odd)
    got = Q.score_documents(everything, ensemble).collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 for r in got)
    scores = {r.id: r.score for r in got}
    assert scores[900] == scores[901]
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((scores[i] >= 0.5) == y for i, y in held) >= 0.97 * len(held)
    stats = Q._with_statistics(everything, "text", F.col("doc_id").alias("id")).collect()
    numpy = dict(zip([r.id for r in stats], ensemble.score(np.array([r[1:] for r in stats], float))))
    assert all(abs(numpy[i] - scores[i]) < 1e-9 for i in scores)
    assert Q.score_documents(docs.limit(0), ensemble).collect() == []


def test_quality_without_labels(rows):
    docs = rows([(1, "a")], "doc_id bigint, text string")
    labels = rows([], "doc_id bigint, quality int")
    assert [r.score for r in Q.score_documents(docs, Q.fit(docs, labels, F.lit(True))).collect()] == [0.5]


def test_lasso_keeps_few_weights():
    rng = np.random.default_rng(0)
    held = rng.random((800, 40)) < 0.5
    target = held[:, 3].astype(float)
    base, weights = Q.lasso(held.astype(float), target, np.ones(800), penalty=0.02)
    assert weights.argmax() == 3 and (np.abs(weights) > 1e-3).sum() < 12
    assert ((held @ weights + base > 0) == (target > 0)).all()


# -- personal data --------------------------------------------------------------------------------

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def slow_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2:
                twice = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(twice) % 10:
                    continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(8)
    for _ in range(20_000):
        text = "".join(rnd.choice("0123456789..@@ab-+ ()1425é\n") for _ in range(rnd.randrange(45)))
        assert P.base_spans(text) == slow_spans(text), text
    assert P.base_spans("9" * 50_000 + ".1.1.1") == [] and P.base_spans("a" * 200_000) == []
    assert P.base_spans("4012888888881881") == [(0, 2, 16)]


def slow_marginals(field, graph):
    """Marginals by listing all labellings of a small graph."""
    import itertools

    n, potential = len(graph.spans), field.potentials()
    own = field.unary[graph.features].sum(axis=1)
    half = len(graph.source) // 2
    out, total = np.zeros((n, P.LABELS)), 0.0
    for labels in itertools.product(range(P.LABELS), repeat=n):
        score = sum(own[i, y] for i, y in enumerate(labels))
        score += sum(potential[graph.kind[e], labels[graph.source[e]], labels[graph.target[e]]] for e in range(half))
        total += math.exp(score)
        for i, y in enumerate(labels):
            out[i, y] += math.exp(score)
    return out / total


def test_message_passing_on_a_tree_is_exact():
    rng = np.random.default_rng(4)
    field = P.Field(rng.normal(size=(1 << P.FEATURE_BITS, P.LABELS)) * 0.3, rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    graph = P.graph_of(["a@b 12345 c x9 word 12345"])
    assert set(graph.kind.tolist()) == {P.FORWARD, P.BACKWARD, P.SKIP}
    P_rounds, P.ROUNDS = P.ROUNDS, 60
    try:
        got, _ = P.infer(field, graph)
    finally:
        P.ROUNDS = P_rounds
    assert np.abs(got - slow_marginals(field, graph)).max() < 1e-3


def test_repeats_share_a_label(rows):
    rnd = random.Random(3)

    def mail():
        return f"{prose(rnd, 1)}{rnd.randrange(100)}@mail{rnd.randrange(9)}.example.com"

    bodies = [f"{prose(rnd, 20)} {mail()} {prose(rnd, 5)} {rnd.randrange(900)} {prose(rnd, 5)}" for _ in range(200)]
    field = P.train(bodies)
    assert field.skip[1, 1] > field.skip[0, 1]
    broken = "Write to jo81@mail7.example.com now. Later jo81@mail7example,com again."
    base, spans = P.find_spans(field, [broken])[0]
    assert set(base) <= set(spans) and len(base) == 1
    data = [(1, broken), (2, None), (3, ""), (None, "call +1 (555) 555-7713"), (4, "word " * 30_000), (1, broken)]
    docs = rows([(i, t, 1, "b") for i, t in data], "doc_id bigint, text string, n_email int, base string")
    got = P.find_personal_data(docs, field).collect()
    for r in got:
        text = dict(data)[r.id] or ""
        want = slow_spans(text)
        assert r.base == ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    assert len(got) == len(data)
    assert P.find_personal_data(docs.limit(0), P.fit(docs.limit(0))).collect() == []


# -- language model -------------------------------------------------------------------------------

def lm_fixture(rows):
    rnd = random.Random(12)
    left, right = ["der", "die", "und", "ein"], ["the", "and", "of", "in"]
    data = []
    for i in range(300):
        own = rnd.choice([left, right])
        data.append((i, " ".join(rnd.choices(own, k=30)) + f" w{rnd.randrange(2000)}"))
    data += [(1000, None), (1001, ""), (1002, "UND\tthe\x0bx"), (None, "of in"), (1003, "z" * 100_000 + " the"), (1000, None)]
    return data, rows([(i, t, 0.0, b"w") for i, t in data], "doc_id bigint, text string, score double, word binary")


@pytest.mark.parametrize("known", [1 << 18, 6])
def test_counts_base_and_model(rows, monkeypatch, known):
    monkeypatch.setattr(L, "KNOWN", known)
    monkeypatch.setattr(L, "SINGLE", min(known, 40))
    data, docs = lm_fixture(rows)
    got = L.score_documents(docs, id_hash_mod(docs["doc_id"], 7) != 2).collect()
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]) for i, t in data]
    counts = Counter(w for i, ws in tokens if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(str((i, len(ws), sum(counts[w] > 0 for w in ws), n)) for i, ws in tokens)
    assert sorted(str((r.id, r.n_tokens, r.n_known, r.train_tokens)) for r in got) == want
    by_id = {r.id: r for r in got}
    for i, ws in tokens:
        assert math.isclose(by_id[i].base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert by_id[i].score <= 0
    held = [i for i, _ in data if i is not None and i < 300 and zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(by_id[i].score for i in held) > sum(by_id[i].base_score for i in held)


def test_probabilities_add_up_to_one(rows, monkeypatch):
    monkeypatch.setattr(L, "SINGLE", 5)
    monkeypatch.setattr(L, "HASHED", 3)
    data, docs = lm_fixture(rows)
    counted = L.count_tokens(L.texts(docs))
    words = L.vocabulary(counted)
    model = L.Model.start(words)
    scorer = L.Scorer(words, model)
    every = np.arange(words.classes)
    for before, anchor in ((words.classes, L.ANCHORS), (2, 0), (6, 1)):
        log10 = scorer.classes(np.full(words.classes, before), np.full(words.classes, anchor), every)
        assert abs((10 ** log10).sum() - 1) < 1e-5
    inside = [0.0] * L.HASHED
    for r in counted.collect():
        word = bytes(r["word"])
        if words.number.get(word, words.single) >= words.single:
            c = words.hashed_class(word) - words.single
            inside[c] += (r["n"] + 1) / words.divisor[c]
    assert all(abs(x + 1 / words.divisor[c] - 1) < 1e-9 for c, x in enumerate(inside))


def test_contexts():
    before, anchor = L.contexts(np.array([1, 9, 0, 8, 7]), 2, 99)
    assert before.tolist() == [99, 1, 9, 0, 8] and anchor.tolist() == [2, 2, 1, 1, 0]


def test_model_without_training_rows(rows):
    _, docs = lm_fixture(rows)
    got = L.score_documents(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)
    assert L.score_documents(docs.limit(0), F.lit(True)).collect() == []
