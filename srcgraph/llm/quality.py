"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Trees are grown on a bounded sample of labelled documents; every path from a root is a
rule, a conjunction of comparisons. A logistic model with an L1 penalty keeps few of the
rules. Statistics, rules and the score are Spark column expressions, so scoring stays in
the scan and moves nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.llm.labelled import sample_ids, sampled

#: Bounds of the sample the rules are fitted on and of the ensemble.
PER_CLASS = 4000
TREES, DEPTH, LEAF = 40, 3, 10
PENALTY = 0.002

#: Characters that only stand between or beside words of prose, and the rest of ASCII punctuation.
PROSE = ".,;:'\"()?-"
SYMBOLS = "!#$%&*+/<=>@[\\]^_`{|}~"


def _count(text: Column, characters: str) -> Column:
    """How many of these ASCII characters the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Name and expression of each statistic; `text` is not null."""
    length = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": length / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "line_length": length / F.size(lines).cast("double"),
        "upper": _count(text, upper) / length,
        "digits": _count(text, "0123456789") / length,
        "prose_marks": _count(text, PROSE) / length,
        "symbols": _count(text, SYMBOLS) / length,
        "stops": _count(text, ".") / n_words,
        "commas": _count(text, ",") / n_words,
    }


NAMES = [
    "log_chars", "log_words", "word_length", "distinct_words", "distinct_lines", "line_length", "upper", "digits",
    "prose_marks", "symbols", "stops", "commas",
]


@dataclass(frozen=True)
class Rule:
    """All of (statistic, whether at most, bound) hold."""

    tests: tuple[tuple[int, bool, float], ...]

    def on(self, rows: np.ndarray) -> np.ndarray:
        held = np.ones(len(rows), bool)
        for column, at_most, bound in self.tests:
            held &= (rows[:, column] <= bound) == at_most
        return held

    def column(self, names: list[str]) -> Column:
        return reduce(
            lambda a, b: a & b, [F.col(names[c]) <= F.lit(b) if low else F.col(names[c]) > F.lit(b) for c, low, b in self.tests],
        )


@dataclass(frozen=True)
class Ensemble:
    base: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        for rule, weight in zip(self.rules, self.weights):
            total += weight * rule.on(rows)
        return 1 / (1 + np.exp(-total))

    def column(self, names: list[str]) -> Column:
        """The score over columns of the statistics."""
        total = F.lit(self.base)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(names), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _split(rows: np.ndarray, target: np.ndarray, columns: np.ndarray) -> tuple[float, int, float] | None:
    """Best (gain, statistic, bound) by squared error, among up to 32 bounds per statistic."""
    best = None
    whole = target.sum() ** 2 / len(target)
    for c in columns.tolist():
        values = np.unique(rows[:, c])
        if len(values) < 2:
            continue
        at = np.unique(np.linspace(0, len(values) - 2, min(32, len(values) - 1)).astype(int))
        for bound in ((values[at] + values[at + 1]) / 2).tolist():
            low = rows[:, c] <= bound
            n = int(low.sum())
            if n < LEAF or len(target) - n < LEAF:
                continue
            left = target[low].sum()
            gain = left ** 2 / n + (target.sum() - left) ** 2 / (len(target) - n) - whole
            if best is None or gain > best[0]:
                best = gain, c, bound
    return best


def grow_rules(rows: np.ndarray, target: np.ndarray, seed: int = 11) -> list[Rule]:
    """Paths of trees, each grown on what the trees before it got wrong, on half of the rows and statistics."""
    rng = np.random.default_rng(seed)
    left = target - target.mean()
    rules: dict[Rule, None] = {}

    def grow(own: np.ndarray, tests: tuple, fitted: np.ndarray) -> None:
        if tests:
            rules[Rule(tests)] = None
        columns = rng.permutation(rows.shape[1])[:max(1, rows.shape[1] * 2 // 3)]
        best = _split(rows[own], left[own], columns) if len(tests) < DEPTH and len(own) >= 2 * LEAF else None
        if best is None or best[0] < 1e-6:
            fitted[Rule(tests).on(rows)] = left[own].mean()
            return
        low = rows[own, best[1]] <= best[2]
        grow(own[low], (*tests, (best[1], True, best[2])), fitted)
        grow(own[~low], (*tests, (best[1], False, best[2])), fitted)

    for _ in range(TREES):
        fitted = np.zeros(len(rows))
        grow(rng.permutation(len(rows))[:max(2 * LEAF, len(rows) // 2)], (), fitted)
        left = left - 0.3 * fitted
    return list(rules)


def lasso(held: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = 400):
    """Base and weights of a logistic model with an L1 penalty, by accelerated proximal gradient steps."""
    share = weight / weight.sum()
    rate = 4.0 / max(1.0, float(np.linalg.norm(held * np.sqrt(share)[:, None], 2) ** 2) + 1)
    w, base, v, vb, pace = np.zeros(held.shape[1]), 0.0, np.zeros(held.shape[1]), 0.0, 1.0
    for _ in range(steps):
        error = share * (1 / (1 + np.exp(-(held @ v + vb))) - target)
        new = v - rate * (held.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_base = vb - rate * error.sum()
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        v, vb = new + (pace - 1) / faster * (new - w), new_base + (pace - 1) / faster * (new_base - base)
        w, base, pace = new, new_base, faster
    return base, w


def train(rows: np.ndarray, labels: np.ndarray, seed: int = 11) -> Ensemble:
    """Fit the ensemble. With one class only, it has no rules and its share of 1s as the score; with no rows, 0.5."""
    target = np.asarray(labels, float)
    if len(set(target.tolist())) < 2:
        share = (target.sum() + 1) / (len(target) + 2)
        return Ensemble(float(np.log(share / (1 - share))), (), ())
    rules = grow_rules(rows, target, seed)
    held = np.stack([r.on(rows) for r in rules], axis=1).astype(float)
    base, weights = lasso(held, target, np.ones(len(target)))
    kept = np.flatnonzero(np.abs(weights) > 1e-3)
    return Ensemble(float(base), tuple(rules[i] for i in kept), tuple(float(weights[i]) for i in kept))


def _with_statistics(docs: DataFrame, text_col: str, *kept: Column) -> DataFrame:
    body = docs.select(*kept, F.coalesce(docs[text_col], F.lit("")).alias("__body"))
    return body.select(
        *[c for c in body.columns if c != "__body"],
        *[c.cast("double").alias(f"__{n}") for n, c in statistics(F.col("__body")).items()],
    )


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id",
    text_col: str = "text", per_class: int = PER_CLASS,
) -> Ensemble:
    """Fit on a bounded sample: up to `per_class` documents of either label; only their statistics reach the driver.

    Of several rows of an id the least text is taken.
    """
    rows = sampled(docs, sample_ids(labels, label_col, learn, per_class, id_col), id_col)
    one = rows.groupBy(id_col, "__label").agg(F.min(F.coalesce(text_col, F.lit(""))).alias("__text"))
    got = _with_statistics(one, "__text", F.col(id_col).alias("id"), F.col("__label").alias("label")).collect()
    got.sort(key=lambda r: (r["id"], tuple(r[2:])))
    return train(np.array([r[2:] for r in got], float).reshape(len(got), len(NAMES)), np.array([r["label"] for r in got]))


def score_documents(docs: DataFrame, ensemble: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per row of `docs`; null texts are empty ones, which are scored like any other."""
    rows = _with_statistics(docs, text_col, docs[id_col].alias("id"))
    return rows.select("id", ensemble.column([f"__{n}" for n in NAMES]).alias("score"))
