"""Columns of documents that have the operators' own names, and bytes that are no UTF-8."""

import pytest

from public_tokenizers import PATTERN

from srcgraph.llm import bpe, exact_dedup, line_dedup, pii, simhash
from srcgraph.llm import decontaminate as D
from srcgraph.llm.labelled import sampled
from srcgraph.llm.queries import RANKS

NAMES = ["__key", "__KEY_", "__gone", "__id", "__kept_key", "__stay", "key", "id", "copies"]
TEXT = " ".join(f"word{i}" for i in range(12))


@pytest.fixture
def clashing(rows):
    data = [(i, f"{TEXT}\nown line number{i} {'abcdefgh'[i]}", *(f"{n} {i}" for n in NAMES)) for i in range(8)]
    data += [(8, data[0][1], *(f"{n} 8" for n in NAMES))]
    return rows(data, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.mark.parametrize("drop", [
    exact_dedup.drop_copies, simhash.drop_near_duplicates, line_dedup.drop_recurring_passages,
    lambda docs: line_dedup.drop_recurring_lines(docs, min_docs=3),
])
def test_columns_keep_names_and_values(clashing, drop):
    out = drop(clashing)
    assert out.columns[:len(clashing.columns)] == clashing.columns
    got = out.collect()
    assert got
    for row in got:
        assert [row[n] for n in NAMES] == [f"{n} {row.doc_id}" for n in NAMES]


def test_exact_copies_go_and_recurring_lines_too(clashing):
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(clashing).collect()) == list(range(8))
    assert all(TEXT not in r.text for r in line_dedup.drop_recurring_lines(clashing, min_docs=3).collect())


def test_sampled_rows_with_a_label_column(rows):
    docs = rows([(1, "a", 7, 7), (2, "b", 7, 7)], "doc_id bigint, text string, __label int, __id int")
    assert [(r.doc_id, r["__label"], r["__id"]) for r in sampled(docs, [(2, 1)]).collect()] == [(2, 1, 7)]


@pytest.mark.parametrize("window", [256, 257, 300, 700])
def test_windows_of_any_length(window):
    item = [f"w{i % 97}" if i % 2 else f"x{i}" for i in range(window)]
    finder = D.Phrases([("one", [w.encode() for w in item])], window)
    text = " ".join(["before"] * 400 + item + ["after"] * 400).encode()
    assert finder.find([text]) == [(800 + window, [(400, 400 + window)], {"one"})]


def test_bytes_that_are_no_utf8(rows):
    docs = rows([(1,)], "doc_id bigint").selectExpr("doc_id", "cast(unhex('61FF20622B') as string) as text")
    same = rows([(1, "a� b+")], "doc_id bigint, text string")
    assert bpe.encode_documents(docs, RANKS, PATTERN).collect() == bpe.encode_documents(same, RANKS, PATTERN).collect()
    field = pii.train([])
    assert pii.find_personal_data(docs, field).collect() == pii.find_personal_data(same, field).collect()
