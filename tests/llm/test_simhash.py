"""SimHash near-dedup against all pairs on small fixtures."""

import random
import re

import numpy as np
import pytest
import xxhash

from srcgraph.llm import simhash as S


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if words else 0


def slow_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


TEXTS = ["", " ", "one", "ONE\ttwo", "a b c d", "A b c d e", "é É ß x y", "w " * 40_000, "one two three four five six"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == slow_fingerprint(text)


def test_every_word_is_near_few_codewords():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 4000)
    for flips in (1, 2):
        other = words.copy()
        for _ in range(flips):
            other ^= 1 << rng.integers(0, 23, len(words))
        mine, yours = S.near_indices(words), S.near_indices(other)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(mine, yours))
    moved = words ^ (1 << rng.integers(0, 23, len(words)))
    assert all(n in near for n, near in zip(S.nearest_index(words), S.near_indices(moved)))


def test_keys_lose_no_pair():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2)
    other = fps.copy()
    for _ in range(4):
        other ^= np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)

    def by_row(values):
        out = [set() for _ in values]
        for key, row, kind in zip(*(x.tolist() for x in S.keys_of(values))):
            out[row].add((key, kind))
        return out

    for mine, yours in zip(by_row(fps), by_row(other)):
        assert any((key, {0: 1, 1: 0, 2: 2}[kind]) in yours for key, kind in mine)


def near_fps(rnd, groups, size):
    out = set()
    for _ in range(groups):
        fp = rnd.getrandbits(64)
        for _ in range(size):
            other = fp
            for _ in range(rnd.randrange(6)):
                other ^= 1 << rnd.randrange(64)
            out.add(other)
    return sorted(out)


@pytest.mark.parametrize("large", [2048, 12, 2])
def test_links_connect_like_all_pairs(spark, rows, large):
    fps = near_fps(random.Random(9), 12, 40) + [0, 1, (1 << 64) - 1]
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    frame = rows([(v,) for v in set(signed.values())], "fp bigint")
    found = S.near_links(frame, large).collect()
    assert all(bin((r.a ^ r.b) & ((1 << 64) - 1)).count("1") <= 4 for r in found)
    linked = {(r.a, r.b) for r in found}
    got = slow_components(set(signed.values()), lambda a, b: (a, b) in linked)
    want = slow_components(set(signed.values()), lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4)
    assert got == want


def test_components_of_long_chains(rows):
    links = [(i, i + 1) for i in range(60)] + [(100, 102), (101, 102), (200, 101)]
    got = {r.node: r.root for r in S.components(rows(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100, 200: 100}


def test_documents(rows):
    base = " ".join(f"w{i}" for i in range(400))
    data = [(9, base), (4, base), (None, base), (7, base.replace("w399", "changed")), (20, "something else here now"),
            (21, None), (22, ""), (23, " \n"), (20, "something else here now")]
    docs = rows([(i, t, 1, "z") for i, t in data], "doc_id bigint, text string, fp int, component_id string")
    got = S.near_duplicates(docs).collect()
    fps = {i: slow_fingerprint(t) for i, t in data}
    assert sorted(map(str, ((r.id, r.fp & ((1 << 64) - 1)) for r in got))) == sorted(map(str, ((i, slow_fingerprint(t)) for i, t in data)))
    ids = {r.id: r.component_id for r in got}
    near = bin(fps[9] ^ fps[7]).count("1") <= 4
    assert ids == {9: 4, 4: 4, None: 4, 7: 4 if near else 7, 20: 20, 21: 21, 22: 21, 23: 21}
    left = S.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({4, 20, 21} | (set() if near else {7}))
    assert S.near_duplicates(docs.limit(0)).collect() == []
