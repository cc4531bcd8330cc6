"""Sharding by a minimax contiguous partition.

Equal texts form an atomic group. Groups are ordered by the SHA-256 of their text and
cut into contiguous shards so that the largest shard is as small as it can be. The
smallest capacity is found by binary search, each candidate checked by filling shards
greedily. The driver never sees all groups: it holds sums over ranges of the order
(by leading hex digits) and asks for finer sums only of ranges in which a cut may fall,
until those are single groups. Each round brings 4,096 sums per such range.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.functions.joins import keyed_join
from srcgraph.llm.common import cut

DIGITS = 3


class Span:
    """Groups that follow each other in the order: bytes, first digest, and whether it is one group."""

    __slots__ = ("size", "first", "prefix", "atomic")

    def __init__(self, size: int, first: str, prefix: str, atomic: bool):
        self.size, self.first, self.prefix, self.atomic = size, first, prefix, atomic


def _fill(spans: list[Span], sums: list[int], capacity: int, shards: int, divisible: bool) -> list[int] | None:
    """Indexes of the spans at which a greedy filling starts shards 1, 2, ...; None if `shards` do not hold all.

    A span of several groups that does not fit is cut freely if `divisible`, else put whole into the next shard.
    """
    cuts, done = [], 0
    for k in range(shards):
        at = bisect_right(sums, done + capacity)
        if at == len(spans):
            return cuts
        if k == shards - 1:
            return None
        before = sums[at - 1] if at else 0
        cuts.append(at)
        if divisible and not spans[at].atomic:
            done += capacity
        elif before == done:
            return None
        else:
            done = before
    return None


def _smallest(spans: list[Span], shards: int, divisible: bool) -> tuple[int, list[int]]:
    """Smallest feasible capacity by binary search, and its cuts."""
    sums = list(accumulate(s.size for s in spans))
    total = sums[-1]
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        if _fill(spans, sums, middle, shards, divisible) is None:
            low = middle + 1
        else:
            high = middle
    return low, _fill(spans, sums, low, shards, divisible) or []


def _level(spans: list[Span], capacity: int, shards: int) -> list[int]:
    """Cuts with no shard over `capacity`, each as near as it may be to an even share of what is left.

    A greedy filling leaves the last shards small or empty; any cut between the latest
    start (greedy from the left) and the earliest (greedy from the right) is feasible too.
    """
    sums = [0, *accumulate(s.size for s in spans)]
    earliest, end = [], len(spans)
    for _ in range(shards - 1):
        while end and sums[len(spans) if not earliest else earliest[-1]] - sums[end - 1] <= capacity:
            end -= 1
        earliest.append(end)
    earliest.reverse()
    cuts, done = [], 0
    for k in range(shards - 1):
        share = sums[done] + (sums[-1] - sums[done]) / (shards - k)
        at = bisect_right(sums, share) - 1
        if at + 1 < len(sums) and abs(sums[at + 1] - share) < abs(sums[at] - share):
            at += 1
        latest = bisect_right(sums, sums[done] + capacity) - 1
        at = max(done, earliest[k], min(at, latest))
        cuts.append(at)
        done = at
    return cuts


def _sums(groups: DataFrame, digits: int) -> list[Span]:
    """Sums by the first `digits` hex digits; partial sums leave each task, one row per range arrives."""
    prefix = F.substring("digest", 1, digits).alias("prefix")
    rows = groups.groupBy(prefix).agg(
        F.sum("size").alias("size"), F.min("digest").alias("first"), F.max("digest").alias("last"),
    ).collect()
    return sorted((Span(r["size"], r["first"], r["prefix"], r["first"] == r["last"]) for r in rows), key=lambda s: s.first)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """First digests of shards 1, 2, ... and the smallest capacity, for `groups` (digest, size).

    A digest may occur in many rows. An empty shard starts at the digest of the next one,
    or behind all digests ("g").
    """
    spans = _sums(groups, DIGITS)
    if not spans:
        return ["g"] * (shards - 1), 0
    while True:
        low, cuts = _smallest(spans, shards, divisible=True)
        high, whole = _smallest(spans, shards, divisible=False)
        if low == high:
            break
        # filled as if ranges could be cut anywhere, `low` would do: look into the ranges cut
        coarse = {i for i in (*cuts, *whole) if not spans[i].atomic}
        spans = sorted([s for i, s in enumerate(spans) if i not in coarse] + _finer(groups, [spans[i] for i in coarse]),
                       key=lambda s: s.first)
    return [spans[c].first if c < len(spans) else "g" for c in _level(spans, high, shards)], high


def _finer(groups: DataFrame, spans: list[Span]) -> list[Span]:
    out = []
    for digits in sorted({len(s.prefix) for s in spans}):
        inside = [s.prefix for s in spans if len(s.prefix) == digits]
        out += _sums(groups.filter(F.substring("digest", 1, digits).isin(inside)), digits + DIGITS)
    return out


def shard_of(digest: Column, cuts: list[str]) -> Column:
    shard = F.lit(0)
    for first in cuts:
        shard = shard + (digest >= F.lit(first)).cast("int")
    return shard


def shard_documents(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): one row per row of `docs`.

    size: UTF-8 bytes of the text plus 1. Law `bytes`: shards are near equal in bytes, as
    far as groups of equal texts (which stay whole) allow. A null text is empty. Slots of a
    shard run from 0 without gaps, in the order in which the scan met the rows; they are
    counted within each scan task, to which the sums of the tasks before are added, so no
    task sees a whole shard. No rows give no rows; shards may be empty when there are
    fewer groups than shards. grown_shard is null: adding a shard moves the cuts.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    base = cut(docs.select(
        docs[id_col].alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    ))
    cuts, _ = minimax_cuts(base.select("digest", "size"), shards)
    rows = base.select(
        "id", "size", "text_crc32", shard_of(F.col("digest"), cuts).cast("int").alias("shard"), "row",
        F.shiftright("row", 33).alias("task"),
    )
    counts = rows.groupBy("shard", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("task", "shard").orderBy("row")
    placed = keyed_join(rows.withColumn("nth", F.row_number().over(own) - 1), offsets, ["shard", "task"])
    return placed.select(
        "id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("nth") + F.col("offset")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
