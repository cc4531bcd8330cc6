"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in their scan tasks, in blocks of at most 4,096 documents: a block holds for
each term the documents that have it, with their counts. The terms of the items are dealt to a
few owners of about equal postings, rarest terms first. Items travel in bundles of 256: a
bundle carries the sparse accumulators (item, document, score so far) of one block from owner to
owner, and every stage is a cogroup of the bundles with its owner's postings that adds whole
numbers. The last owner, who has the commonest terms, passes on each item's best
documents of the block only; the best of all blocks are selected in the end. Nothing is pruned.

A group of a cogroup is one bundle and one block, bounded in documents and items, so a term that
every document has is spread over all blocks. The items' vocabulary is sent to the scan if it
is measured to be small; otherwise all terms are indexed and the join picks those asked for.

Defined results: null and empty texts have no terms; documents of no term are no documents of the
collection, items of no term get no rows; equal rows of the items count once, rows of one id with
different texts are ranked each; repeated documents are documents each, and stand next
to each other in a ranking; tables without rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from srcgraph.functions.joins import fits_broadcast, keyed_join
from srcgraph.functions.ranking import position, running_total
from srcgraph.llm.common import Batches, cut, map_batches, record, send_package, texts

TOP = 10
OWNERS = 4
BLOCK_DOCS = 4096
BLOCK_BYTES = 32 << 20
BUNDLE_ITEMS = 256
PIECE = 1 << 20

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

_BUNDLE = "bundle bigint, block bigint, slots binary, at binary, scores binary"
_BEST = "item bigint, block bigint, at int, score bigint"


def count_terms(text: bytes) -> Counter:
    """Terms of a whole text with their counts; long texts are read in pieces that end between terms."""
    if len(text) <= PIECE:
        return Counter(_TERM.findall(text.lower()))
    counts, start = Counter(), 0
    while start < len(text):
        found = _BREAK.search(text, start + PIECE)
        end = found.start() if found else len(text)
        counts.update(_TERM.findall(text[start:end].lower()))
        start = end
    return counts


class _Block:
    """Documents of one block while it is filled."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.postings: dict[bytes, list[int]] = {}
        self.n_bytes = 0

    def add(self, doc_id, text: bytes, vocabulary: frozenset | None) -> None:
        counts, at = count_terms(text), len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(sum(counts.values()))
        self.n_bytes += len(text)
        for term, tf in counts.items():
            if vocabulary is None or term in vocabulary:
                self.postings.setdefault(term, []).extend((at, tf))

    def rows(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row of the block itself (its ids in order), and one per term."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)
        yield record(
            schema, [number], [None], [None], [None], [None], [[self.ids[i] for i in order]],
            [int((lengths > 0).sum())], [int(lengths.sum())],
        )
        terms = list(self.postings.items())
        for start in range(0, len(terms), 4096):
            some = terms[start:start + 4096]
            at, tf, n = [], [], []
            for _, flat in some:
                pairs = np.array(flat, np.int64).reshape(-1, 2)
                at.append(place[pairs[:, 0]].astype("<u2").tobytes())
                tf.append(pairs[:, 1].astype("<i4").tobytes())
                n.append(lengths[pairs[:, 0]].astype("<i4").tobytes())
            none = [None] * len(some)
            yield record(schema, [number] * len(some), [t for t, _ in some], at, tf, n, none, none, none)


def index(docs: DataFrame, id_col: str, text_col: str, vocabulary: frozenset | None) -> DataFrame:
    """Blocks and their postings: rows with a null term are blocks (ids in order, n_docs, n_terms).

    Postings are arrays: `at` (uint16 places in the block's ids), `tf` and `n` (int32).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    ddl = (
        f"block bigint, term binary, at binary, tf binary, n binary, ids array<{id_type}>, n_docs bigint, n_terms bigint"
    )
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Batches) -> Batches:
        known, schema, block = sent.value, None, _Block()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if schema is None:
                schema = _arrow(batch.schema.field("id").type)
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"]):
                block.add(doc_id, text.as_py(), known)
                if len(block.ids) == BLOCK_DOCS or block.n_bytes >= BLOCK_BYTES:
                    yield from block.rows(number, schema)
                    block, number = _Block(), number + 1
        if block.ids:
            yield from block.rows(number, schema)

    return map_batches(texts(docs, id_col, text_col), read, StructType.fromDDL(ddl))


def _arrow(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("block", pa.int64()), ("term", pa.binary()), ("at", pa.binary()), ("tf", pa.binary()), ("n", pa.binary()),
        ("ids", pa.list_(id_type)), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
    ])


def asked_terms(items: DataFrame) -> DataFrame:
    """`(item, term, times)` of numbered items (item, text)."""
    schema = pa.schema([("item", pa.int64()), ("term", pa.binary()), ("times", pa.int64())])

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for item, text in zip(batch["id"].to_pylist(), batch["text"]):
                counts = count_terms(text.as_py())
                yield record(schema, [item] * len(counts), list(counts), list(counts.values()))

    return map_batches(texts(items, "item", "text"), read, StructType.fromDDL("item bigint, term binary, times bigint"))


def contributions(tf: np.ndarray, n: np.ndarray, weight: int, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence of a term in an item adds to each document's score; 64-bit, rounded down."""
    m = 25 + (75 * n * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _added(bundle: pa.Table, postings: pa.Table, n_docs: int, n_terms: int) -> np.ndarray:
    """Scores so far (item slot, place in the block) with an owner's contributions added."""
    scores = np.zeros((BUNDLE_ITEMS, BLOCK_DOCS), np.int64)
    for row in bundle.to_pylist():
        scores[np.frombuffer(row["slots"], "<u2"), np.frombuffer(row["at"], "<u2")] = np.frombuffer(row["scores"], "<i8")
    for row in postings.to_pylist():
        at = np.frombuffer(row["at"], "<u2")
        tf, n = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("tf", "n"))
        added = contributions(tf, n, row["weight"], n_docs, n_terms)
        for asker in row["askers"]:
            scores[asker["slot"], at] += asker["times"] * added
    return scores


def _stage(bundles: DataFrame, postings: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """One owner: bundles with the accumulators that its postings leave them with."""
    schema = pa.schema([
        ("bundle", pa.int64()), ("block", pa.int64()), ("slots", pa.binary()), ("at", pa.binary()), ("scores", pa.binary()),
    ])

    def visit(key, bundle: pa.Table, own: pa.Table) -> pa.Table:
        scores = _added(bundle, own, n_docs, n_terms)
        slots, at = np.nonzero(scores)
        return pa.Table.from_batches([record(
            schema, [key[0].as_py()], [key[1].as_py()], [slots.astype("<u2").tobytes()], [at.astype("<u2").tobytes()],
            [scores[slots, at].astype("<i8").tobytes()],
        )])

    return _by_bundle(bundles).cogroup(_by_bundle(postings)).applyInArrow(visit, _BUNDLE)


def _last_stage(bundles: DataFrame, postings: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The last owner: the best `k` documents of the block for each item."""
    schema = pa.schema([("item", pa.int64()), ("block", pa.int64()), ("at", pa.int32()), ("score", pa.int64())])

    def visit(key, bundle: pa.Table, own: pa.Table) -> pa.Table:
        scores = _added(bundle, own, n_docs, n_terms)
        first, block = key[0].as_py() * BUNDLE_ITEMS, key[1].as_py()
        out = []
        for slot in np.flatnonzero(scores.any(axis=1)):
            at = np.flatnonzero(scores[slot] > 0)
            # Places follow the ids, and the sort is stable, so equal scores stand by ascending id.
            best = at[np.argsort(-scores[slot, at], kind="stable")[:k]]
            out.append((np.full(len(best), first + slot), np.full(len(best), block), best, scores[slot, best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], [], []]
        return pa.Table.from_batches([record(schema, *columns)])

    return _by_bundle(bundles).cogroup(_by_bundle(postings)).applyInArrow(visit, _BEST)


def _by_bundle(df: DataFrame):
    return df.groupBy("bundle", "block")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", owners: int = OWNERS) -> DataFrame:
    """`(item_col, rank, id, score)`: each item's `k` documents of the highest scores above zero."""
    spark = docs.sparkSession
    send_package(spark)
    texts_of = items.select(items[item_col].alias("name"), items[item_text_col].alias("text")).distinct()
    numbered = position(texts_of.withColumn("one", F.lit(0)), ["one"], "name", "nth", then=("text",)).select(
        (F.col("nth") - 1).alias("item"), "name", "text",
    )
    asked = cut(asked_terms(numbered))
    vocabulary = asked.select("term").distinct()
    small = fits_broadcast(vocabulary.select(F.hex("term").alias("term")))
    known = frozenset(bytes(r["term"]) for r in vocabulary.collect()) if small else None

    indexed = cut(index(docs, id_col, text_col, known))
    postings = indexed.filter(F.col("term").isNotNull()).select("block", "term", "at", "tf", "n")
    blocks = indexed.filter(F.col("term").isNull())
    totals = blocks.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = totals["docs"] or 0, totals["terms"] or 1

    # Owners: terms by ascending frequency, cut where each has its share of all postings.
    frequency = postings.groupBy("term").agg(F.sum(F.octet_length("at") / 2).cast("bigint").alias("df"))
    wanted = frequency if small else frequency.join(vocabulary, "term", "left_semi")
    running = running_total(wanted.withColumn("one", F.lit(0)), ["one"], "df", F.col("df"), "upto", then=("term",))
    total = running.agg(F.coalesce(F.max("upto"), F.lit(1)).alias("t")).first()["t"]
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    owned = running.select(
        "term", weight.alias("weight"), F.call_function("div", (F.col("upto") - F.col("df")) * owners, F.lit(total)).alias("owner"),
    )
    askers = asked.groupBy(F.call_function("div", "item", F.lit(BUNDLE_ITEMS)).alias("bundle"), "term").agg(
        F.collect_list(F.struct((F.col("item") % BUNDLE_ITEMS).cast("int").alias("slot"), "times")).alias("askers")
    )
    lookup = cut(askers.join(owned, "term"))
    sized = lookup.select(F.hex("term").alias("term"), "askers")
    met = (
        postings.join(F.broadcast(lookup), "term") if fits_broadcast(sized) else keyed_join(postings, lookup, ["term"])
    ).select("bundle", "block", "owner", "weight", "askers", "at", "tf", "n")

    bundles = spark.createDataFrame([], _BUNDLE)
    for owner in range(owners - 1):
        bundles = _stage(bundles, met.filter(F.col("owner") == owner), n_docs, n_terms)
    best = _last_stage(bundles, met.filter(F.col("owner") >= owners - 1), n_docs, n_terms, k)

    by_score = Window.partitionBy("item").orderBy(F.desc("score"))
    ties = best.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= k).drop("place")
    named = ties.join(blocks.select("block", "ids"), "block").select(
        "item", "score", "block", "at", F.get("ids", F.col("at")).alias("id"),
    )
    in_order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"), "block", "at")
    ranked = named.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "name"), "item").select(
        F.col("name").alias(item_col), "rank", "id", "score",
    )
