"""Line dedup against a plain template tree."""

import re
from collections import defaultdict

import pytest

from srcgraph.llm import line_dedup as D

WS = re.compile(r"[\x20\x09-\x0D]+")


def slow(data, min_docs):
    def tokens(line):
        return ["<*>" if re.search("[0-9]", t) else t for t in WS.split(line) if t]

    leaves = defaultdict(list)
    for _, text in data:
        for line in (text or "").split("\n"):
            if own := tokens(line):
                leaves[len(own), tuple(own[:3])].append(own)

    def alike(key):
        rest = key[0] - 3
        parts = min(max(rest, 0), 16)
        cuts = [(p, p + 1) for p in range(rest)] if rest <= 16 else [(rest * p // 16, rest * (p + 1) // 16) for p in range(16)]
        same = sum(len({tuple(own[3 + a:3 + b]) for own in leaves[key]}) == 1 for a, b in cuts[:parts])
        return same >= parts * 0.5

    found = {key: alike(key) for key in leaves}

    def template(own):
        key = len(own), tuple(own[:3])
        return key if found[key] else tuple(own)

    docs = defaultdict(set)
    for i, text in data:
        for line in (text or "").split("\n"):
            if own := tokens(line):
                docs[template(own)].add((i, text))
    out = []
    for i, text in data:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if not (own := tokens(x)) or len(docs[template(own)]) < min_docs]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LONG = " ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
DATA = [
    *[(i, f"Only here {chr(97 + i)}{chr(98 + i)}\nJob {i} done at 12:{i} by root\n\nAll rights reserved.") for i in range(8)],
    *[(20 + i, f"user login from {w} at home now\n{LONG} {w}\n{LONG.replace('tab', w)}") for i, w in enumerate("abcdef")],
    *[(40 + i, "one two three " + " ".join(w * (k + 2) for k in range(4))) for i, w in enumerate("abcdef")],
    (60, None), (61, ""), (62, "\n \n\t"), (63, "All rights reserved.\r"), (64, "All rights reserved.\nAll rights reserved."),
    (None, "All rights reserved."), (65, "x" * 200_000 + "\n" + "9" * 200_000), (0, "Job 7 done at 12:9 by root"),
    (66, "a b"), (66, "a b"), (67, "a b\na b"), (68, "\x0b\nend\n"),
]


@pytest.mark.parametrize(("min_docs", "small"), [(2, True), (3, False), (6, True)])
def test_equals_plain_tree(rows, monkeypatch, min_docs, small):
    from srcgraph.functions import joins

    for module in (D, joins):
        monkeypatch.setattr(module, "fits_broadcast", lambda *_: small)
    docs = rows([(i, t, 5, "k", "l") for i, t in DATA], "doc_id bigint, text string, n_lines int, key string, leaf string")
    got = D.drop_recurring_lines(docs, min_docs=min_docs)
    assert got.columns == ["doc_id", "text", "key", "leaf", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == slow(DATA, min_docs)


def test_variable_fields_are_one_template_and_python_is_not_used(spark, rows):
    docs = rows(DATA, "doc_id bigint, text string")
    frame = D.drop_recurring_lines(docs, min_docs=6)
    dropped = {r.doc_id: r.n_dropped for r in frame.collect()}
    assert all(dropped[20 + i] == 3 for i in range(6)) and all(dropped[40 + i] == 0 for i in range(6))
    lines = D.lines_of(docs, "doc_id", "text")
    for plan in (frame, D.recurring(docs, "doc_id", "text", 6), lines, D.templates(lines, lines.select("leaf").distinct())):
        assert not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().executedPlan().toString())


def test_empty_table(rows):
    docs = rows([], "doc_id bigint, text string")
    assert D.drop_recurring_lines(docs).collect() == []
