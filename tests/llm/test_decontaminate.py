"""Decontamination against a plain search for every window."""

import hashlib
import random
import re

import numpy as np
import pytest

from srcgraph.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow(docs, items):
    owners = {}
    for item, text in items:
        words = slow_words(text)
        for k in range(max(1, len(words) - 9)):
            if words:
                owners.setdefault(tuple(words[k:k + 10]), set()).add(str(item) if item is not None else "")
    out = []
    for i, text in docs:
        words = slow_words(text)
        hit, found = set(), set()
        for phrase, own in owners.items():
            n = len(phrase)
            for k in range(len(words) - n + 1):
                if tuple(words[k:k + n]) == phrase:
                    hit.update(range(k, k + n))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def fixture(seed=0):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(40)] + ["é", "漢字", "9", "A"]
    items = [(n, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 9, 10, 11, 30])))) for n in range(25) if n]
    items += [(7, items[3][1]), (7, items[6][1]), (None, " ".join(rnd.choices(vocabulary, k=12))), (50, ""), (51, None), (52, "-- !")]
    items = [x for x in items if len(slow_words(x[1])) != 1] + [(60, "rareword")]
    docs = []
    for n in range(60):
        words = rnd.choices(vocabulary + ["other"], k=rnd.randrange(80))
        for _ in range(rnd.randrange(3)):
            own = slow_words(rnd.choice(items)[1])
            at = rnd.randrange(len(own) + 1)
            words[rnd.randrange(len(words) + 1):0] = own[at:] if rnd.random() < 0.3 else own
        docs.append((n, rnd.choice([" ", "\n", "_", ", "]).join(words)))
    long = docs[5][1] + " pad" * 30_000 + " " + items[6][1].upper() + (" " + " ".join(vocabulary)) * 200
    return docs + [(100, None), (101, ""), (102, "..."), (103, "rareword"), (104, long), (None, items[8][1]), (1, docs[1][1])], items


def frames(rows, docs, items):
    return (
        rows([(i, t, 1, "z", None if t is None else len(t)) for i, t in docs], "doc_id bigint, text string, id int, body string, n_chars bigint"),
        rows([(i, t, 0) for i, t in items], "item_id bigint, text string, spans int"),
    )


@pytest.mark.parametrize(("pieces", "shard"), [(256, 1 << 19), (24, 64)])
def test_find_equals_plain_search(monkeypatch, pieces, shard):
    monkeypatch.setattr(D, "PIECE_WORDS", pieces)
    monkeypatch.setattr(D, "SHARD_WORDS", shard)
    docs, items = fixture(3)
    phrases = D.Phrases([(str(i), w) for i, t in items if (w := D.words_of((t or "").encode()))], 10)
    found = phrases.find([(t or "").encode() for _, t in docs])
    want = {str(r) for r in slow([(n, t) for n, (_, t) in enumerate(docs)], items)}
    for n, ((_, text), (size, spans, own)) in enumerate(zip(docs, found)):
        assert size == len(slow_words(text))
        own = {"" if i == "None" else i for i in own}
        sha = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        hit = sum(b - a for a, b in spans)
        assert str((n, len(slow_words(text)), hit, len(own), sha, hit > 0)) in want


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_query_equals_plain_search(rows, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    docs, items = fixture()
    got = D.contamination(D.find_spans(*frames(rows, docs, items))).collect()
    assert sorted(map(tuple, got), key=str) == slow(docs, items)


@pytest.mark.parametrize("block", [1 << 24, 400])
def test_nothing_is_left_after_cutting(rows, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    docs, items = fixture(1)
    frame, benchmark = frames(rows, docs, items)
    clean = D.remove_passages(frame, benchmark, length_col="n_chars")
    assert clean.columns == frame.columns
    got = clean.collect()
    assert sorted(r.doc_id is None or r.doc_id for r in got) == sorted(i is None or i for i, _ in docs)
    assert not any(r[-1] for r in slow([(r.doc_id, r.text) for r in got], items))
    clear = {i for i, *_, hit in slow(docs, items) if not hit}
    before = dict(docs)
    assert clear and all(r.text == before[r.doc_id] for r in got if r.doc_id in clear)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_empty_tables(rows):
    docs, items = fixture()
    frame, benchmark = frames(rows, docs, items)
    assert D.find_spans(frame.limit(0), benchmark).collect() == []
    none = D.contamination(D.find_spans(frame, benchmark.limit(0))).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert D.remove_passages(frame, benchmark.limit(0)).count() == len(docs)


def test_ranks_and_suffixes():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(1, 6, rng.integers(1, 40)) for _ in range(30)]
    index = D.FmIndex(pieces, 5)
    for symbol in range(6):
        for at in range(0, index.size + 1, 7):
            got = index.wavelet.rank(np.array([symbol]), np.array([at]))[0]
            assert got == (index.bwt[:at] == symbol).sum()
    phrase = np.array([[1, 2], [5, 5], [3, 1]])
    row, low, high = index.search(phrase)
    places = index.locate(low, high)
    got = sorted(zip(np.repeat(row, high - low).tolist(), places[0].tolist(), places[1].tolist()))
    want = sorted((r, p, k) for r, ph in enumerate(phrase.tolist()) for p, piece in enumerate(pieces)
                  for k in range(len(piece) - 1) if piece[k:k + 2].tolist() == ph)
    assert got == want
