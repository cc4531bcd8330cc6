"""Line dedup by dominant templates against a plain template tree and the oracle."""

import os
import re
from collections import Counter, defaultdict

import pytest

from srcgraph.llm import line_dedup as D
from srcgraph.llm.oracles import ORACLES

WS = re.compile(r"[\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
FILLER = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]


def tokens(line):
    return ["<*>" if re.search("[0-9]", t) else t for t in WS.split(line) if t]


def slow(data, least):
    seen = {(tuple(own), text) for _, text in data for line in (text or "").split("\n") if (own := tokens(line))}
    docs = Counter(own for own, _ in seen)
    values = defaultdict(Counter)
    for own, n in docs.items():
        for p, token in enumerate(own[3:]):
            values[len(own), own[:3], p][token] += n

    def template(own):
        key = len(own), own[:3]
        best = [max(values[*key, p].items(), key=lambda e: (e[1], e[0].encode()))[0] for p in range(len(own) - 3)]
        return key if len(own) > 3 and 2 * sum(a == b for a, b in zip(own[3:], best)) >= len(best) else own

    often = defaultdict(set)
    for own, text in seen:
        often[template(own)].add(text)
    out = []
    for i, text in data:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if not (own := tuple(tokens(x))) or len(often[template(own)]) < least(len(own))]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in frame.collect()), key=str)


def edited(i):
    """A line of thirty tokens, one of which is another in each copy."""
    own = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30)]
    own[3 + i % 27] = "z" + chr(97 + i % 26) + chr(97 + i // 26)
    return " ".join(own)


DATA = [
    *[(i, f"only {'q' * (i + 1)}\n{edited(i)}\nuser login from {'v' * (i + 1)} at home now") for i in range(24)],
    (30, "user login from some quite other words\n" + "wa" + edited(0)[2:]),
    *[(40 + i, "user login from " + " ".join(FILLER[(i + k * (i + 1)) % 7] for k in range(4))) for i in range(7)],
    (60, None), (61, ""), (62, "\n \n\t"), (None, "user login from a at home now"), (63, "a b"), (63, "a b"), (64, "a b\na b"),
]
LONG = " ".join(f"l{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(50))
#: A licence in five texts, one in four, a long passage in three, one in two; whole copies.
FEW = [
    *[(100 + i, f"first {chr(97 + i)}{chr(98 + i)}\nReleased under the licence\n{'Kept by all four of us' if i else ''}\n"
       f"{LONG if i < 3 else ''}\n{LONG[1:] if i < 2 else ''}") for i in range(5)],
    *[(110 + i, "A whole copy of one text\n" + LONG[2:]) for i in range(9)],
]


def test_passages_of_few_documents_go_and_whole_copies_stay(rows):
    frame = D.drop_recurring_passages(rows(FEW, "doc_id bigint, text string"))
    assert {r.doc_id: r.n_dropped for r in frame.collect()} == {
        100: 2, 101: 2, 102: 2, 103: 1, 104: 1, **{110 + i: 0 for i in range(9)}}


def test_one_edited_word_per_copy_and_a_stranger_leave_the_template(rows):
    frame = D.drop_recurring_passages(rows(DATA, "doc_id bigint, text string"))
    dropped = {r.doc_id: r.n_dropped for r in frame.collect()}
    assert all(dropped[i] == 2 for i in range(24))
    # decided over whole leaves, the edited lines stay
    old = {r.doc_id: r.n_dropped for r in D.drop_recurring_lines(rows(DATA, "doc_id bigint, text string")).collect()}
    assert all(old[i] < 2 for i in range(24)) and dropped[60] == dropped[61] == 0


@pytest.mark.parametrize("small", [True, False])
def test_equals_plain_tree(rows, monkeypatch, small):
    from srcgraph.functions import joins

    for module in (D, joins):
        monkeypatch.setattr(module, "fits_broadcast", lambda *_: small)
    frame = D.drop_recurring_passages(rows(DATA + FEW, "doc_id bigint, text string"))
    assert got(frame) == slow(DATA + FEW, lambda n: 3 if n >= 50 else 5)
    assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().executedPlan().toString())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_equals_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    expected = con.execute(ORACLES["op6_passage_dedup"]).fetchall()
    assert got(D.drop_recurring_passages(docs)) == sorted(expected, key=str)
