"""Quality rules judged host by host, in DataFrame functions only.

Every document is measured and held against a few rules. Failures are counted per host and
rule; the rates are drawn towards a beta prior that is fitted to all hosts by moments, so
that a host with few documents is not judged by chance. A rule is in force on hosts whose
shrunk rate reaches `ENFORCE`: there its failures are a habit, and documents that fail
it go; elsewhere a single failure is let pass. On hosts where half of all documents or more
(shrunk too) fail some rule, all rules are in force at half their limits. Documents that break
no rule stay on every host.

Defined results: a null text has no words, so it fails the base; null hosts are one host;
repeated rows are judged each; an empty table gives no rows. Counts are of whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.joins import lookup_join
from srcgraph.llm.common import cut
from srcgraph.llm.merkle import row_digest

SPACE_RUN = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
CAPITALS = "[A-Z]"
SHINGLE = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of the words

#: Rule -> (what is counted, of what, limit in percent): broken where 100 * a > limit * b.
RULES: dict[str, tuple[str, str, int]] = {
    "symbols": ("n_symbols", "n_words", 10),
    "capitals": ("n_capitals", "word_chars", 40),
    "marks": ("n_marks", "n_words", 20),
    "lines": ("n_dup_lines", "n_lines", 40),
    "long_words": ("word_chars", "n_words", 2500),
}
#: A host's shrunk rate of a rule from which on the rule is in force there.
ENFORCE = 0.01
#: The shrunk share of documents with a broken rule from which on a host is held to half the limits.
STRICT = 0.5


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` computed once however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def _found(text: Column, characters: str) -> Column:
    """How many of the characters of a class a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that are found twice or more, the first included.

    Windows are sorted with their places, so that equal ones are neighbours; what the
    places of the repeated ones cover is summed up in order.
    """
    def starts(rows: Column) -> Column:
        def again(k: Column) -> Column:
            same = [F.get(rows, k + d)["window"] == F.get(rows, k)["window"] for d in (-1, 1)]
            return F.when(F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False)), F.get(rows, k)["at"])

        found = F.transform(F.sequence(F.lit(0), F.size(rows) - 1), again)
        return F.array_sort(F.filter(found, lambda x: x.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.aggregate(
            F.sequence(F.lit(1), F.size(at) - 1), F.lit(SHINGLE),
            lambda sum_, k: sum_ + F.least(F.lit(SHINGLE), F.get(at, k) - F.get(at, k - 1)),
        )
        return F.when(F.size(at) > 1, steps).otherwise(0)

    def hashed(w: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])

    def count(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - SHINGLE)
        # Windows are told apart by themselves; the hash only makes most comparisons short.
        windows = F.transform(places, lambda i: F.struct(
            hashed(w, i).alias("hash"), F.array_join(F.slice(w, i + 1, SHINGLE), " ").alias("window"), i.alias("at"),
        ))
        # Different hashes are different windows; only a text with equal ones has its windows compared.
        hashes = F.transform(places, lambda i: hashed(w, i))
        repeats = _let(hashes, lambda h: F.size(h) > F.size(F.array_distinct(h)))
        return F.when(
            (F.size(w) >= SHINGLE) & repeats, _let(_let(F.array_sort(windows), starts), covered)
        ).otherwise(0)

    return _let(words, count)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """`(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_marks, n_lines)`."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE_RUN), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_SPACE))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": _found(text, SYMBOLS),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(words),
        "n_capitals": _found(text, CAPITALS),
        "n_marks": _found(text, "!"),
        "n_lines": F.size(lines),
    }
    return docs.select(
        docs[id_col].alias("id"), docs[host_col].cast("string").alias("host"),
        *[c.cast("bigint").alias(name) for name, c in counts.items()],
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def broken(rule: str, part: int = 1) -> Column:
    """Whether a document breaks a rule at its limit, or at the limit divided by `part`."""
    a, b, limit = RULES[rule]
    return part * 100 * F.col(a) > limit * F.col(b)


def shrunk_rates(judged: DataFrame, names: list[str]) -> DataFrame:
    """`(named, host, rate_<name>...)`: failure rates per host, drawn to a beta prior fitted to all hosts.

    judged  (named, host, fails_<name>...) with 0 or 1 per document; a host is known by both columns

    The prior has the mean m of all documents and the strength m(1 - m)/v - 1, v being the
    variance between hosts: that of the observed rates, weighted by documents, less what chance
    gives. If nothing is left of it, every host has the mean.
    """
    hosts = judged.groupBy("named", "host").agg(
        F.count("*").alias("n"), *[F.sum(f"fails_{x}").alias(f"f_{x}") for x in names],
    )
    sums = [
        c for x in names for c in (
            F.sum(f"f_{x}").alias(f"s_{x}"),
            F.sum(F.col(f"f_{x}").cast("double") * F.col(f"f_{x}") / F.col("n")).alias(f"q_{x}"),
        )
    ]
    totals = hosts.agg(F.sum("n").alias("all"), F.count("*").alias("hosts"), *sums).first()  # one row of numbers
    n_all, n_hosts = float(totals["all"] or 1), totals["hosts"]

    def rate(x: str) -> Column:
        mean = (totals[f"s_{x}"] or 0) / n_all
        spread = mean * (1 - mean)
        between = (totals[f"q_{x}"] or 0.0) / n_all - mean * mean - spread * (n_hosts - 1) / n_all
        if between <= 1e-12:
            return F.lit(mean).alias(f"rate_{x}")
        strength = max(spread / between - 1, 0.0)
        return ((F.col(f"f_{x}") + F.lit(strength * mean)) / (F.col("n") + F.lit(strength))).alias(f"rate_{x}")

    return hosts.select("named", "host", *[rate(x) for x in names])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: its counts, `base_failed`, `broken` (rules in force that it breaks), `kept`."""
    # Measured once: hosts are counted over it and their verdicts joined back to it.
    measured = measure(docs, id_col, text_col, host_col).select(
        "*", F.col("host").isNotNull().alias("named"), base_failed().alias("base_failed"),
    )
    stats = cut(measured.withColumn("host", F.coalesce("host", F.lit(""))))
    names = [*RULES, "any"]
    any_broken = F.lit(False)
    for x in RULES:
        any_broken = any_broken | broken(x)
    fails = [broken(x).cast("int").alias(f"fails_{x}") for x in RULES]
    rates = shrunk_rates(stats.select("named", "host", *fails, any_broken.cast("int").alias("fails_any")), names)
    verdicts = cut(rates.select(
        "named", "host", (F.col("rate_any") >= STRICT).alias("strict"),
        *[(F.col(f"rate_{x}") >= ENFORCE).alias(f"held_{x}") for x in RULES],
    ))
    joined = lookup_join(stats, verdicts, ["named", "host"])
    rules = [
        F.when((F.col(f"held_{x}") & broken(x)) | (F.col("strict") & broken(x, 2)), F.lit(x)) for x in RULES
    ]
    return joined.withColumn("broken", F.concat_ws(",", *rules)).select(
        "id", F.when(F.col("named"), F.col("host")).alias("host"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "broken", (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"),
    )


def drop_failing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rows of `docs` that are kept, all their columns; a row given several times is judged, and kept, each time."""
    own = row_digest([docs[id_col], docs[host_col], docs[text_col]])
    key = next(name for name in (f"__row{i}" for i in range(10_000)) if name not in docs.columns)
    keyed = docs.withColumn(key, own)
    gone = judge(keyed, key, text_col, host_col).filter(~F.col("kept")).select(F.col("id").alias(key)).distinct()
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
