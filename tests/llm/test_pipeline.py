"""The pipeline, and every query of the subpackage over the smallest tables."""

import hashlib
import os
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from srcgraph.llm import bpe, decontaminate, exact_dedup, simhash
from srcgraph.llm.oracles import ORACLES
from srcgraph.llm.queries import QUERIES, RANKS

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def plain(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, frame[columns].values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(con.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - {"op11_term_pipeline"}))  # its rows are ranks of items
def test_query_has_each_document_once(spark, documents, name):
    got = QUERIES[name](spark, SF).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in documents)


def test_sharding_query(spark, documents):
    got = QUERIES["op10_sharding"](spark, SF).collect()
    body = {i: (t or "").encode() for i, t in documents}
    assert all((r.size, r.text_crc32) == (len(body[r.doc_id]) + 1, zlib.crc32(body[r.doc_id])) for r in got)
    assert {r.shard for r in got} <= set(range(16))


def test_pipeline_stage_by_stage(spark, tmp_path):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    items = [(str(r.item_id), decontaminate.words_of((r.text or "").encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    phrases = decontaminate.Phrases(items, 10)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if number < 4:
            assert out.columns == columns
            assert dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(str(tmp_path / str(number)))
        out = spark.read.parquet(str(tmp_path / str(number)))
        rows = out.collect()
        if name == "toxicity":
            assert 0 < len(rows) < len(before)
        elif name == "exact dedup":
            texts = {r.text: 0 for r in rows}
            keys = {(t or "").translate(str.maketrans("", "", " \t\n\x0b\x0c\r")) for t in before.values()}
            assert len(texts) == len(rows) == len({(t or "").translate(str.maketrans("", "", " \t\n\x0b\x0c\r")) for t in texts})
            assert set(before.values()) >= set(texts) and len(keys) == len(rows)
        elif name == "near dedup":
            fps = [simhash.fingerprint((r.text or "").encode()) for r in rows]
            assert all(bin(a ^ b).count("1") > 4 for n, a in enumerate(fps) for b in fps[:n])
        elif name == "decontamination":
            assert {r.doc_id for r in rows} == set(before)
            assert not any(s for _, s, _ in phrases.find([(r.text or "").encode() for r in rows]))
            assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id])
        else:
            library = tiktoken.Encoding(
                "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={},
            )
            for r in rows:
                assert r.ids == library.encode_ordinary(before[r.doc_id] or "")
                assert r.decoded_sha256 == hashlib.sha256((before[r.doc_id] or "").encode()).hexdigest()
        docs, before = out, ({r.doc_id: r.text for r in rows} if number < 4 else before)


def test_run_equals_its_stages(spark):
    run = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_exact_copies(spark, corpus_pipeline.drop_toxic(spark, docs, SF), SF)
    ids = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, kept, SF).select("doc_id").collect()}
    assert {r.doc_id for r in run.select("doc_id").collect()} == ids


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.collect() == [] and (number == 4 or out.columns == docs.columns)
    assert exact_dedup.drop_copies(docs).count() == 0
