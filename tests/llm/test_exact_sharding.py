"""Exact dedup and sharding against plain loops, and their defined edge cases."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest

from srcgraph.llm import exact_dedup as E
from srcgraph.llm import sharding as S

SCHEMA = "doc_id bigint, text string, id string, key int, digest string"
SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def table(rows, data):
    return rows([(i, t, "x", 1, "y") for i, t in data], SCHEMA)


CASES = [
    (5, "a b"), (3, "ab"), (4, " a b "), (7, None), (6, ""), (8, " \t"), (9, "é "), (10, "é  "),
    (11, "long " * 20_000), (12, "LONG"), (12, "LONG"), (None, "ab"), (13, "x"),
]


def expected(data):
    groups = defaultdict(list)
    for i, t in data:
        groups[(t or "").translate(SPACE)].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in data:
        own = groups[(t or "").translate(SPACE)]
        best = min(own)
        out.append((i, None if best[1] else best[2], len(own)))
    return sorted(out, key=str)


def test_groups_and_keepers(rows):
    got = E.exact_dedup(table(rows, CASES)).collect()
    assert sorted(((r.id, r.keep_id, r.group_size) for r in got), key=str) == expected(CASES)
    by_text = {(i, (t or "").translate(SPACE)) for i, t in CASES}
    assert {(r.id, bytes(r.digest)) for r in got} == {(i, hashlib.sha256(t.encode()).digest()) for i, t in by_text}
    assert {r.id for r in got if r.kept} == {4, 8, 10, 11, 12, 13}


def test_of_equal_rows_one_document_stays(rows):
    docs = table(rows, CASES)
    left = E.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [4, 8, 10, 11, 12, 13]


def test_empty_table_and_withdrawn_texts(rows):
    assert E.exact_dedup(table(rows, [])).collect() == []
    assert E.drop_copies(table(rows, [])).collect() == []
    gone = rows([("a  b",)], "text string")
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(table(rows, CASES[:4]), withdrawn=gone).collect()}
    assert got == {5: (None, 0, False), 3: (None, 0, False), 4: (None, 0, False), 7: (7, 1, True)}


def test_cuckoo_index_inserts_deletes_and_resizes():
    index = E.CuckooIndex(buckets=2, kicks=4)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for n, d in enumerate(digests):
        index.insert(d, [n])
    assert index.resizes > 3 and index.size == 3000
    assert all(index.get(d) == [n] for n, d in enumerate(digests))
    assert index.get(hashlib.sha256(b"other").digest()) is None
    assert all(index.delete(d) for d in digests[::2]) and not index.delete(digests[0])
    assert all((index.get(d) is None) == (n % 2 == 0) for n, d in enumerate(digests))
    assert sum(map(len, index.filter)) == index.size == 1500


def test_a_fingerprint_hit_is_verified():
    index = E.CuckooIndex()
    one = hashlib.sha256(b"one").digest()
    twin = one[:-1] + bytes([one[-1] ^ 1])  # same fingerprint, same bucket
    index.insert(one, [1])
    assert index.may_have(twin) and index.get(twin) is None


def smallest_capacity(sizes, shards):
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        new = [0] + [float("inf")] * len(sizes)
        for end in range(1, len(sizes) + 1):
            total = 0
            for start in range(end, 0, -1):
                total += sizes[start - 1]
                new[end] = min(new[end], max(best[start - 1], total))
        best = [min(a, b) for a, b in zip(best, new)]
    return best[-1]


@pytest.mark.parametrize("seed", range(3))
def test_smallest_capacity(rows, seed, monkeypatch):
    monkeypatch.setattr(S, "DIGITS", 1)  # several rounds of finer sums
    rnd = random.Random(seed)
    sizes = {hashlib.sha256(os.urandom(8)).hexdigest(): rnd.choice([1, 2, 3, 50, 200 * (seed == 2) + 1]) for _ in range(60)}
    groups = rows([(d, s) for d, s in sizes.items()], "digest string, size bigint")
    cuts, capacity = S.minimax_cuts(groups, 5)
    assert capacity == smallest_capacity([sizes[d] for d in sorted(sizes)], 5)
    shard = defaultdict(int)
    for d, s in sizes.items():
        shard[sum(d >= c for c in cuts)] += s
    assert max(shard.values()) <= capacity


def test_shards_of_documents(rows):
    rnd = random.Random(4)
    data = [(i, "copy") for i in range(150)] + [(1000 + i, "w" * rnd.randrange(60)) for i in range(300)]
    data += [(None, None), (2000, None), (2001, ""), (2002, "long " * 400), (2000, None)]
    got = S.shard_documents(table(rows, data), 8).collect()
    assert len(got) == len(data) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    by_id = {r.id: r for r in got}
    for i, t in data:
        body = (t or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32) == (len(body) + 1, zlib.crc32(body))
    shards, home = defaultdict(list), defaultdict(set)
    for r in got:
        shards[r.shard].append(r.slot)
        home[(r.size, r.text_crc32)].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert all(len(h) == 1 for h in home.values()) and set(shards) <= set(range(8))


def test_fewer_groups_than_shards(rows):
    got = S.shard_documents(table(rows, [(1, "a"), (2, "a"), (3, "b")]), 16).collect()
    assert len({r.shard for r in got}) == 2 and sorted(r.slot for r in got) == [0, 0, 1]
    assert S.shard_documents(table(rows, []), 16).collect() == []
