"""Joins against a side whose size is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.session import cut

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024

#: So many rows of a key, about, and at most so many of its lookup meet in one place of `dealt_join`.
PAIR_ROWS = 512
PAIR_LOOKUPS = 2048
MOST_TASKS = 10_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure `df` by its rows and bytes: one partial sum per task, no rows move.

    The estimate counts text as it is, arrays by their elements, and 16 bytes for any other column.
    """
    size = F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        if kind == "string":
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            size = size + 16 * F.greatest(F.size(name), F.lit(0))
        else:
            size = size + 16
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return got["n"] <= max_rows and got["b"] <= max_bytes


def keyed_join(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join `rows`, whose keys may be very uneven, to a lookup that an aggregate by `on` has just made.

    Such a lookup is already partitioned by its keys, so Spark would join it in place;
    then adaptive execution, which splits only partitions that were shuffled for the
    join itself, never splits a hot key. One more key, a hash of the others, makes both
    sides shuffle for the join. Hashing text keeps int and bigint keys equal.
    """
    mixed = F.xxhash64(*[F.col(c).cast("string") for c in on])
    return (
        rows.withColumn("__mixed", mixed)
        .join(lookup.withColumn("__mixed", mixed), [*on, "__mixed"], how).drop("__mixed")
    )


def lookup_join(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join wide `rows` to a lookup with one row per key.

    A lookup that fits is broadcast, so that `rows` (which may carry file contents)
    do not move. A larger one is a shuffle join, whose hot keys adaptive execution splits.
    """
    if fits_broadcast(lookup):
        return rows.join(F.broadcast(lookup), on, how)
    return keyed_join(rows, lookup, on, how)


def dealt_join(rows: DataFrame, lookup: DataFrame, on: list[str], row_id: list[str], place: str, how: str = "inner") -> DataFrame:
    """Join `rows` to a lookup with many rows per key: a row meets all of its key's.

    row_id  columns that tell a key's rows apart
    place   number of a lookup row within its key, from 0

    A lookup that fits is broadcast. A larger one is not shuffled by key: what comes out of a key is a product, which the
    bytes of the two sides do not show, so adaptive execution would leave it to one task. The key's rows are dealt
    into slices, its lookup into blocks, and each slice meets each block in a place of its own. A place holds one block in
    memory, and what is shuffled (every block once per slice, every row once per block) is a small part of what comes out.
    """
    if fits_broadcast(lookup):
        return rows.join(F.broadcast(lookup), on, how)
    blocks = lookup.withColumn("__block", F.expr(f"{place} div {PAIR_LOOKUPS}"))
    sizes = cut(
        rows.groupBy(*on).agg(F.count("*").alias("__rows"))
        .join(blocks.groupBy(*on).agg(F.count("*").alias("__lookups"), F.collect_set("__block").alias("__blocks")), on)
        .withColumn("__slices", F.ceil(F.col("__rows") / PAIR_ROWS))
    )
    spark, pairs = rows.sparkSession, sizes.agg(F.sum(F.col("__rows") * F.col("__lookups")).alias("n")).first()["n"] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(pairs // (PAIR_ROWS * PAIR_LOOKUPS) + 1, MOST_TASKS))
    zero = F.lit(0).cast("bigint")
    asking = lookup_join(rows, sizes.select(*on, "__slices", "__blocks"), on, "left")
    dealt = asking.select(
        *rows.columns, F.pmod(F.xxhash64(*row_id), F.coalesce("__slices", F.lit(MOST_TASKS))).alias("__slice"),
        F.explode(F.coalesce("__blocks", F.array(zero))).alias("__block"),
    )
    copied = lookup_join(blocks, sizes.select(*on, "__slices"), on).select(
        *lookup.columns, "__block", F.explode(F.sequence(zero, F.col("__slices") - 1)).alias("__slice"))
    keys = [*on, "__slice", "__block"]
    # Their number is given, for adaptive execution would join small partitions whose products are large.
    return dealt.repartition(tasks, *keys).join(copied.repartition(tasks, *keys), keys, how).drop("__slice", "__block")
