"""Byte-level BPE against the rank file's own library, and the streaming decoder."""

import hashlib
import itertools
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from srcgraph.llm import bpe as B
from srcgraph.llm.queries import RANKS

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def pair():
    encoder, decoder = B.tools(RANKS, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})
    return encoder, decoder, library


TEXTS = [
    "", " ", "  x", "a", "Hello world's  end\n\n\tfoo", "don't 'S we'll", "x\x1cy \x85 z ", "日本語のテキスト",
    "😀👍🏽 zero‍join", "1234 56,78", "a" * 3000, "ab " * 500, " " * 700, "é" * 301, "\n" * 50 + "x", "word. word, word!",
]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(pair, text):
    encoder, decoder, library = pair
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text)
    assert decoder.decode(ids) == text


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(alphabet=st.sampled_from(" \n\t'sdtlmre.,;19aeionthßéñ漢字 한 글😀👍🏽\u3000\x85"), max_size=60))
def test_any_text(pair, text):
    encoder, decoder, library = pair
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text)
    assert decoder.decode(ids) == text


def test_tables_that_are_full_change_nothing(pair, monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("thewhandionré 'n.") for _ in range(80)) for _ in range(150)]
    want = [pair[2].encode_ordinary(t) for t in texts]
    for states, words, pairs in ((1, 1, 1), (50, 3, 10), (10**9, 10**9, 10**9)):
        monkeypatch.setattr(B, "MAX_STATES", states)
        monkeypatch.setattr(B, "MAX_WORDS", words)
        monkeypatch.setattr(B, "MAX_PAIRS", pairs)
        fresh = B.Encoder(B.read_ranks(RANKS), PATTERN)
        assert [fresh.encode(t) for t in texts] == want


def test_tokens_no_merge_makes():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257}
    encoder = B.Encoder(ranks, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("xyz", "xyzab", "abab", "axyz", " xyz ab"):
        assert encoder.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(4))
def test_utf8_machine_in_any_cuts(seed):
    rnd = random.Random(seed)
    for _ in range(1500):
        data = bytes(rnd.choice([rnd.randrange(256), rnd.randrange(0x80, 0xC0), 0xE2, 0xF0, 0x61]) for _ in range(rnd.randrange(12)))
        machine, out, at = B.Utf8Machine(), "", 0
        while at < len(data):
            step = rnd.randrange(1, 4)
            out += machine.feed(data[at:at + step])
            at += step
        assert out + machine.end() == data.decode(errors="replace")


def test_documents(rows, pair):
    data = [(1, "Hello there", 5), (2, None, 5), (3, "", 5), (None, "x y", 5), (1, "Hello there", 5), (4, "ab " * 50_000, 5)]
    docs = rows(data, "doc_id bigint, text string, ids int")
    got = B.encode_documents(docs, RANKS, PATTERN).collect()
    want = []
    for i, t, _ in data:
        ids = pair[2].encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(str, ((r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got))) == sorted(map(str, want))
    back = B.decode_documents(B.encode_documents(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted(map(str, ((r.id, r.text) for r in back))) == sorted(map(str, ((i, t or "") for i, t, _ in data)))
    assert B.encode_documents(docs.limit(0), RANKS, PATTERN).collect() == []


def test_words_kept_from_other_texts_change_nothing(pair):
    """What ends in white space is never taken from the table, for it may join what follows."""
    fresh = B.Encoder(B.read_ranks(RANKS), PATTERN)
    for text in ("x\n", " \n", "a", " ", "x\n \n \n", " \ny", "a  \n b", "x\n  y", "  ", "a\t \n", " a \n \n\n  b ", " \x1c \x1c a"):
        for again in (text, "x" + text, text + "y", text * 3):
            assert fresh.encode(again) == pair[2].encode_ordinary(again), again


@pytest.mark.parametrize("bound", [2, 12, 300])
def test_thinning_keeps_what_branches(pair, monkeypatch, bound):
    rnd = random.Random(3)
    words = ["".join(rnd.choice(["th", "é", "an", "tion", "q", "ur"]) for _ in range(rnd.randrange(1, 9))) for _ in range(600)]
    monkeypatch.setattr(B, "MAX_STATES", bound)
    fresh = B.Encoder(B.read_ranks(RANKS), PATTERN)
    longest = max(len(w.encode()) for w in words)
    for word in words * 2:
        assert list(fresh.piece(word.encode())) == pair[2].encode_ordinary(word)
        assert len(fresh.states) <= bound + longest


def _library_calls(pair, texts, monkeypatch):
    """An encoder of its own, the steps and ends it has worked out for the texts, and whether its ids are the library's."""
    fresh, asked = B.Encoder(B.read_ranks(RANKS), PATTERN), []
    for name in ("_step", "_last"):
        own = getattr(fresh, name)
        monkeypatch.setattr(fresh, name, lambda state, byte, own=own, name=name: asked.append((name, state, byte)) or own(state, byte))
    ids, counts = fresh.encode_all(pa.array(texts))
    cuts = [0, *counts.cumsum().tolist()]
    return asked, [ids[i:j].tolist() for i, j in zip(cuts, cuts[1:])] == [pair[2].encode_ordinary(t) for t in texts]


def test_new_words_of_many_rows_ask_once(pair, monkeypatch):
    rnd = random.Random(5)
    words = ["".join(rnd.choice(["th", "é", "an", "tion", "q", "ur"]) for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    texts = [" ".join(rnd.choices(words, k=40)) + rnd.choice(["", ".", "\n", " \n  x", "  "]) for _ in range(50)]
    texts += ["", " ", "\n \n", "  a", "x" * 200, "日本語" * 30, " ".join(words)]
    asked, same = _library_calls(pair, texts, monkeypatch)
    steps = [a for a in asked if a[0] == "_step"]
    assert same and len(steps) == len(set(steps)) and len(asked) < 1000  # 300 words have some 4,000 bytes


def test_states_forget_tokens_that_no_longer_matter(pair, monkeypatch):
    """Prefixes that end alike share their states, though their open tokens differ."""
    words = ["".join(p) for p in itertools.product("ab", repeat=8)]
    assert _library_calls(pair, [" ".join(words)], monkeypatch)[1]
    fresh = B.Encoder(B.read_ranks(RANKS), PATTERN)
    fresh.encode(" ".join(words))
    assert len(fresh.states) < 150


def test_slices_of_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(B, "ROWS", 3)
    monkeypatch.setattr(B, "BYTES", 10)
    texts = [b"a" * n for n in (1, 1, 1, 1, 9, 1, 1, 50, 2, 2)] + [b"\xff\xfea"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary())})
    got = [s.column("text").to_pylist() for s in B.slices([batch, batch.slice(0, 0)])]
    assert [len(g) for g in got] == [3, 2, 2, 1, 3] and sum(got, []) == texts
    assert [s.num_rows for s in B.slices([batch], 0.4)] == [1] * 11
    assert B.as_strings(batch.column("text")).to_pylist()[-1] == "��a"


def test_decoder_of_many_texts(pair):
    texts = ["Hello there", "", "漢字😀 é", "plain", "\U0001f44d\U0001f3fd"]
    ids, counts = pair[0].encode_all(pa.array(texts))
    assert [bytes(d).decode() for d in pair[1].decode_all(ids, counts.cumsum())] == texts
    none, counts = pair[0].encode_all(pa.array(["", ""]))
    assert [bytes(d) for d in pair[1].decode_all(none, counts.cumsum())] == [b"", b""]
