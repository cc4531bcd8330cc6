"""What the skip-chain field adds to the patterns: mentions in broken form, by their other mentions."""

import random

import pytest

from srcgraph.llm import pii as P

WORDS = "the of and call mail from to at server paid with card under version page see again later".split()


def mention(rnd):
    kind = rnd.randrange(4)
    if kind == 0:
        return f"jo.{rnd.randrange(100)}@mail{rnd.randrange(9)}.example.com"
    if kind == 1:
        return ".".join(str(rnd.randrange(1, 256)) for _ in range(4))
    if kind == 2:
        digits = "".join(str(rnd.randrange(10)) for _ in range(15))
        return next(digits + c for c in "0123456789" if P.luhn(digits + c))
    return f"+1 ({rnd.randrange(100, 999)}) 555-{rnd.randrange(1000, 9999)}"


def document(rnd):
    words = [rnd.choice(WORDS) for _ in range(40)]
    for _ in range(2):
        words.insert(rnd.randrange(len(words)), mention(rnd))
    for number in (rnd.randrange(10**6), rnd.randrange(10**15, 10**16), rnd.randrange(2020)):  # what is none, repeated too
        for _ in range(2):
            words.insert(rnd.randrange(len(words)), f"x {number} x")
    return " ".join(words)


@pytest.fixture(scope="module")
def field():
    rnd = random.Random(5)
    return P.train([document(rnd) for _ in range(300)])


def test_broken_mentions_follow_whole_ones(field):
    rnd = random.Random(6)
    found = planted = added = 0
    for _ in range(200):
        text = document(rnd)
        base = P.base_spans(text)
        longer, broken = P.with_broken(text, base, rnd)
        assert longer.startswith(text) and P.base_spans(longer) == base
        (own, spans), = P.find_spans(field, [longer])
        assert own == base and set(base) <= set(spans)
        more = set(spans) - set(base)
        found += len(more & set(broken))
        planted += len(broken)
        added += len(more)
    assert planted > 200
    assert found >= 0.9 * planted
    assert found >= 0.9 * added


def test_documents_without_broken_mentions_get_next_to_nothing(field):
    rnd = random.Random(7)
    more = [len(spans) - len(base) for base, spans in P.find_spans(field, [document(rnd) for _ in range(300)])]
    assert sum(more) <= 3


def test_a_repeated_id_is_one_text(rows):
    docs = rows([(1, f"mail a{i}@b.cd", 0) for i in range(50)], "doc_id bigint, text string, `__id` int")
    import srcgraph.llm.pii as module

    seen = []
    train, module.train = module.train, lambda bodies: seen.append(bodies) or train([])
    try:
        P.fit(docs)
    finally:
        module.train = train
    assert seen == [["mail a0@b.cd"]]
