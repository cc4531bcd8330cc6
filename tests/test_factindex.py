"""The written index of facts against scoring all of them."""

import random
import re
from collections import Counter

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from srcgraph.operators import factindex, search

FACTS = "group_id string, uuid string, fact string"
ASKED = "group_id string, question_id bigint, question string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(n, seed=2):
    rng = random.Random(seed)
    vocabulary = ["the"] * 40 + ["of"] * 20 + [f"w{i}" for i in range(40)]
    facts = [("hot" if i % 3 else f"g{i % 4}", f"f{i:05}", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(n)]
    facts += [("hot", "empty", ""), ("hot", "null", None), ("hot", "twin1", "w1 W1, of"), ("hot", "twin2", "w1 w1 of")]
    asked = [("hot", 1, "the w3 of"), ("hot", 2, "w1"), ("hot", 3, "the"), ("g0", 4, "w5 w6 the the"), ("hot", 5, ""), ("hot", 6, None),
             ("none", 7, "the"), ("hot", 8, "unheard")]
    return facts, asked


def test_index_gives_what_all_facts_give(rows, spark, tmp_path):
    facts, asked = corpus(600)
    table, questions = rows(facts, FACTS), rows(asked, ASKED)
    path = str(tmp_path / "index")
    factindex.add_facts(table.filter("uuid < 'f00300'"), path, 0)
    factindex.add_facts(table.filter("uuid >= 'f00300'"), path, 1)
    want = rows_of(search.search_facts(table, questions))
    assert rows_of(factindex.search_index(spark, path, questions)) == want and len(want) > 30
    assert rows_of(factindex.search_index(spark, path, questions, k=3)) == rows_of(search.search_facts(table, questions, k=3))
    factindex.add_facts(table.filter("uuid >= 'f00300'"), path, 1)  # the job runs again
    assert rows_of(factindex.index_context(spark, path, questions)) == rows_of(search.query_context(table, questions))


def test_blocks_that_cannot_reach_the_floor_are_not_read(rows, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(factindex, "RANGE_BITS", 4)
    monkeypatch.setattr(factindex, "PROBES", 16)
    rng = random.Random(5)
    facts = [("hot", f"f{i:05}", " ".join(["the"] * rng.randrange(1, 9) + [f"x{rng.randrange(1000)}" for _ in range(rng.randrange(1, 30))])) for i in range(3000)]
    questions = rows([("hot", 1, "the x3"), ("hot", 2, "x9 x9"), ("hot", 3, "x7 the x5 unheard")], ASKED)
    table, path = rows(facts, FACTS), str(tmp_path / "index")
    factindex.add_facts(table, path, 0)
    blocks, met = factindex._weighted(spark, path, questions)
    kept = factindex.blocks_to_read(blocks, met, 10)
    n_met, n_kept = met.count(), kept.count()
    assert 0 < n_kept < n_met * 0.5
    assert blocks.agg(F.max(F.size("postings"))).first()[0] <= 16
    assert rows_of(factindex.search_index(spark, path, questions)) == rows_of(search.search_facts(table, questions))


def test_a_batch_without_its_facts_is_not_read(rows, spark, tmp_path):
    path = str(tmp_path / "index")
    one, two = rows([("g", "a", "x y"), ("g", "b", "x")], FACTS), rows([("g", "c", "x")], FACTS)
    factindex.add_facts(one, path, 0)
    factindex.add_facts(two, path, 1)
    spark.read.parquet(f"{path}/postings/batch=1").write.parquet(f"{path}/postings/batch=2")  # broken off before its facts
    got = factindex.search_index(spark, path, rows([("g", 1, "x")], ASKED))
    assert [(r["uuid"], r["rank"]) for r in got.orderBy("rank").collect()] == [("b", 1), ("c", 2), ("a", 3)]


def test_words_are_counted_and_gathered_without_moving_them(rows, spark, tmp_path, monkeypatch):
    wide = []
    plain = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **kw: (wide.append(self._df), plain(self, *a, **kw))[1])
    path, (facts, asked) = str(tmp_path / "index"), corpus(3000, 9)
    factindex.add_facts(rows(facts, FACTS), path, 0)
    plan = wide[0]._jdf.queryExecution().executedPlan().toString()
    assert "/postings" not in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in plan
    counted = {(g, w, u): (tf, len(ws)) for g, u, ws in ((g, u, re.findall(r"\w+", (t or "").lower())) for g, u, t in facts)
               for w, tf in Counter(ws).items()}
    got = {(r["group_id"], r["word"], p["uuid"]): (p["tf"], p["len"]) for r in spark.read.parquet(f"{path}/postings").collect() for p in r["postings"]}
    assert got == counted
    blocks = spark.read.parquet(f"{path}/postings").collect()
    assert all((b["n"], b["max_tf"], b["min_len"]) == (len(b["postings"]), max(p["tf"] for p in b["postings"]), min(p["len"] for p in b["postings"])) for b in blocks)
    assert max(b["n"] for b in blocks) <= 1 << factindex.RANGE_BITS and len({(b["group_id"], b["word"], b["range"]) for b in blocks}) == len(blocks)
    monkeypatch.setattr(factindex, "GATHERED", 50)
    factindex.add_facts(rows(facts, FACTS), path, 0)
    assert sorted(map(repr, blocks)) == sorted(map(repr, spark.read.parquet(f"{path}/postings").collect()))
