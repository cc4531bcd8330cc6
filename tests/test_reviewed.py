"""The whole analysis with every kind of answer: what the answers add and the review removes is seen in the queries."""

import os

import pytest

import __spark_entry__ as entry
from srcgraph.plans import catalog

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_answers_and_review_reach_the_registered_graph(spark):
    run = entry.queries()
    rows = run["reviewed_nodes"](spark, SF).collect()
    found = {(r["type"], r["label"]) for r in rows}
    # routes and models of the sources have no such labels
    assert any(t == "api" and label.startswith("POST /d") for t, label in found)
    assert any(t == "database" and label.startswith("U") and label[1:].isdigit() for t, label in found)
    assert any(label.startswith("Svc") for _, label in found)
    assert not any(r["id"].startswith("0") for r in rows)


def test_a_review_needs_no_analysis_of_its_own(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(catalog, "analyze", lambda source, **given: calls.append(given) or _Seen())
    monkeypatch.setattr(catalog.fixtures, "view", lambda *a: None)
    catalog._reviewed(spark, "")
    assert len(calls) == 1 and callable(calls[0]["verdict_answers"])


class _Seen:
    """Takes any attribute or call."""

    def __getattr__(self, name):
        return self

    def __call__(self, *args, **kwargs):
        return self
