"""Ranked search, Merkle manifest and host rules against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from srcgraph.llm import host_rules, merkle, term_pipeline

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WIDE = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, term string, block int, score double, " \
    "tree int, digest string, host string, kept int, __row0 int"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked(docs, items, k=10):
    terms = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in terms]
    n_all, total = sum(1 for s in sizes if s), sum(sizes)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in sorted({(i, t) for i, t in items}, key=repr):
        scored = []
        for (doc_id, counts), n in zip(terms, sizes):
            score = 0
            for t in TERM.findall(low(text)):
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
                    m = 25 + (75 * n * n_all) // total
                    score += w * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **how):
    a = spark.createDataFrame([(i, t, "x", "s", 1, 2, "t", 3, 0.5, 1, "d", "h", 1, 1) for i, t in docs], WIDE)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = term_pipeline.search(a.repartition(3), b, **how).collect()
    return sorted(((r["item_id"], r["rank"], r["id"], r["score"]) for r in got), key=repr)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["the"] * 30 + ["Éa", "de", "x9", "Ñ"] * 5 + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 25)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "..--"), (n + 3, "the the. THE\x00the-the\tx9"), (n + 4, docs[3][1])]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(7)]
    return docs, [*items, (7, None), (8, ""), (9, "nowhere"), (10, "the the w1"), (10, "the the w1"), (10, "w2")]


def test_search_equals_scoring_every_pair(spark, monkeypatch):
    docs, items = corpus(120)
    want = ranked(docs, items)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, owners=1) == want
    monkeypatch.setattr(term_pipeline, "fits_broadcast", lambda *a, **k: False)
    assert searched(spark, docs, items, owners=3) == want


def test_search_over_several_blocks_and_bundles(spark):
    docs = [(i, "common " + ("rare " if i % 2500 == 0 else "") + f"u{i % 50}") for i in range(9000)]
    items = [(i, f"common u{i % 50} rare" if i % 3 else "rare common common") for i in range(300)]
    got = searched(spark, docs, items)
    assert got == ranked(docs, items)
    assert len({r[0] for r in got}) == 300


def test_search_repeated_ids_ties_and_long_text(spark):
    docs = [(5, "a b"), (5, "a b"), (4, "a b"), (None, "a b"), (9, "z " * 3000 + "a")]
    got = searched(spark, docs, [(1, "a"), (2, "z z")], k=3)
    assert got == ranked(docs, [(1, "a"), (2, "z z")], 3)
    assert [r[2] for r in got if r[0] == 1] == [None, 4, 5]


def test_long_texts_are_read_in_pieces_between_terms(monkeypatch):
    monkeypatch.setattr(term_pipeline, "PIECE", 10)
    text = "Abc déf " * 40 + "x" * 50
    assert {k.decode(): v for k, v in term_pipeline.count_terms(text.encode()).items()} == Counter(TERM.findall(low(text)))


def test_search_without_rows(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []


# --- manifest ----------------------------------------------------------------------

def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests, arity=3):
    """The top, and each start's siblings as (before, after) per level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p - p % arity:p - p % arity + arity]
            paths[i].append(("".join(run[:p % arity]), "".join(run[p % arity + 1:])))
            at[i] = p // arity
        level = [h("".join(level[j:j + arity])) for j in range(0, len(level), arity)]
    return level[0], paths


def by_hand(rows, arity=3):
    groups = {}
    for doc_id, source, lang, n, text in rows:
        leaf = h("".join(map(field, (doc_id, source, lang, n, text))))
        even = zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 2 == 0
        now = h("".join(map(field, (doc_id, source, lang, n, None if text is None else text.replace("\n", "")))))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, now if even else leaf, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    lower = [tree([r[2] for r in sorted(groups[s])], arity) for s in names]
    root, upper = tree([top for top, _ in lower], arity)
    out = []
    for s, (top, paths), high in zip(names, lower, upper):
        for (_, _, leaf, start, doc_id), path in zip(sorted(groups[s]), paths):
            end = start
            for before, after in path + high:
                end = h(before + end + after)
            out.append((doc_id, leaf, top, root, "".join(b + a for b, a in path + high), end))
    return sorted(out, key=repr)


def listed(spark, rows, arity=3):
    wide = [(i, t, l, s, n, 2, "t", 3, 0.5, 1, "d", "h", 1, 1) for i, s, l, n, t in rows]
    docs = spark.createDataFrame(wide, WIDE).repartition(3)
    fields = ["doc_id", "source", "lang", "n_chars"]
    changed = merkle.row_digest([*[docs[c] for c in fields], F.regexp_replace(docs["text"], "\n", "")])
    even = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 2 == 0
    found = merkle.manifest(docs, [*fields, "text"], observed=F.when(even, changed), arity=arity)
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_equals_trees_by_hand(spark, arity):
    rng = random.Random(arity)
    rows = [(i * 7 % 101, rng.choice(["hot", "hot", "b", "é", "", None, f"s{i % 4}"]), rng.choice(["en", None]), i,
             rng.choice([f"one\ntwo {i}", f"é{i}", "", None])) for i in range(60)]
    rows += [rows[3], rows[3], (rows[5][0], rows[5][1], "fr", 9, "other\n"), (None, "b", "x", None, "t\n"), (500, "lone", "en", 1, "a\n")]
    got = listed(spark, rows, arity)
    assert got == by_hand(rows, arity)
    assert 0 < sum(r[3] == r[5] for r in got) < len(got)


def test_manifest_of_one_row_and_of_none(spark):
    one = [(1, "a", "en", 3, "x\ny")]
    got = listed(spark, one)
    assert got == by_hand(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == ""
    assert listed(spark, []) == []


def test_a_level_of_the_manifest_is_one_join_over_one_shuffle(spark):
    nodes = spark.createDataFrame([(0, 2, p, bytes([p])) for p in range(5)], "tree bigint, height int, place bigint, digest binary")
    level = merkle.with_siblings(nodes, 3)
    got = {r["place"]: (r["run"], bytes(r["sibs"])) for r in level.collect()}
    assert got == {0: (0, b"\1\2"), 1: (0, b"\0\2"), 2: (0, b"\0\1"), 3: (1, b"\4"), 4: (1, b"\3")}
    plan = level._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin") == 1 and plan.count("ReusedExchange") == 1


# --- host rules --------------------------------------------------------------------

def counted(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    wins = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {p for i in range(len(words) - 4) if wins[tuple(words[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def judged(spark, rows):
    wide = [(i, t, "en", s, 1, 2, "t", 3, 0.5, 1, "d", "h", 1, 1) for i, s, t in rows]
    return host_rules.judge(spark.createDataFrame(wide, WIDE)).collect()


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_and_base_equal_plain_counts(spark):
    rng = random.Random(4)
    rows = [(i, f"s{i % 3}", " ".join(rng.choices(["a", "b", "Ñé", "#x", "|", "c\n", "\x0b", "d\n\n"], k=rng.randrange(0, 60)))) for i in range(80)]
    rows += [(80, None, None), (81, None, ""), (82, "s0", " \n\t\n"), (83, "s0", "one two three four five " * 900), (84, "s1", "same\n same\nsame\n\nsame\r")]
    got = {r["id"]: r for r in judged(spark, rows)}
    assert len(got) == len(rows)
    for i, _, text in rows:
        want = counted(text)
        assert tuple(got[i][c] for c in COUNTS) == want, text
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def prose(i, n=40):
    return " ".join(f"word{i}x{j}" for j in range(n))


def test_rules_hold_where_their_failures_are_a_habit(spark):
    clean = [(i, f"h{i % 5}", prose(i)) for i in range(1500)]
    noisy = [(2000 + i, "junk", " ".join(f"w{i}x{j}###" for j in range(30))) for i in range(60)]
    noisy += [(2100 + i, "junk", prose(2100 + i)) for i in range(20)]
    lone = [(3000, "h1", " ".join(f"w{j}$$$" for j in range(30)))]
    mild = [(3001, "junk", " ".join(f"q{j}" + ("#" if j % 13 == 0 else "") for j in range(39)))]
    got = {r["id"]: r for r in judged(spark, clean + noisy + lone + mild)}
    assert all(got[i]["kept"] for i, _, _ in clean)
    assert not any(got[2000 + i]["kept"] for i in range(60)) and all(got[2100 + i]["kept"] for i in range(20))
    assert got[3000]["kept"], "one failure among 300 documents is no habit"
    assert got[3001]["broken"] == "symbols", "a host of failures is held to half the limits"


def test_small_hosts_are_drawn_to_the_mean(spark):
    hosts = [("a", 1, 1)] + [(f"b{i}", 100, 2 if i % 2 else 0) for i in range(20)]
    rows = [(1, h, int(j < f)) for h, n, f in hosts for j in range(n)]
    judged_rows = spark.createDataFrame([(True, h, f) for _, h, f in rows], "named boolean, host string, fails_x int")
    got = {r["host"]: r["rate_x"] for r in host_rules.shrunk_rates(judged_rows, ["x"]).collect()}
    assert 0.01 < got["a"] < 0.2 and got["b0"] < got["b1"] < 0.02


def test_drop_failing_keeps_rows_and_columns(spark):
    data = [(1, prose(1), "en", "s", 1, 2, "t", 3, 0.5, 1, "d", "h", 1, 1)] * 2
    data += [(2, "too short", "en", None, 1, 2, "t", 3, 0.5, 1, "d", "h", 1, 1), (None, None, "en", "s", 1, 2, "t", 3, 0.5, 1, "d", "h", 1, 7)]
    docs = spark.createDataFrame(data, WIDE)
    kept = host_rules.drop_failing(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1, 1]


def test_host_rules_without_rows_and_without_python(spark):
    assert judged(spark, []) == []
    docs = spark.createDataFrame([(1, "s", "a b")], "doc_id bigint, source string, text string")
    plan = host_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
