"""Order-dependent steps that stay parallel inside one huge group.

A plain `row_number() OVER (PARTITION BY session ...)` sends a whole session to one
task. Here rows are dealt by ranges of their order, so that a group lies over as many
tasks as its rows fill, and are counted in blocks bounded in rows: sums per block, sums
of the blocks before, and the rows of one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.functions.joins import fits_broadcast
from srcgraph.session import cut

#: A block holds at most 2**BLOCK_BITS rows.
BLOCK_BITS = 16


def in_order(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """`df` dealt and sorted by `keys`, then `by`, and written, with `__block` and `__at` added.

    `__at` grows along the order; a block is a stretch of at most 2**16 rows of one task.
    Written, because ranges are drawn from a sample: dealt a second time, rows could fall
    into other ranges.
    """
    order = [*keys, *by]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # A task's rows are numbered from (task << 33), so the high bits tell tasks and then blocks apart.
    numbered = dealt.withColumn("__at", F.monotonically_increasing_id())
    return cut(numbered.withColumn("__block", F.shiftright("__at", BLOCK_BITS)))


def _before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)


def running_total(
    df: DataFrame, keys: list[str], ord_col: str, value: Column, out: str, then: tuple[str, ...] = ()
) -> DataFrame:
    """Add `out`: the sum of `value` over all rows of `keys` up to and including this one.

    Rows are ordered by `ord_col`, then by the columns in `then`, nulls first; rows of a key that
    agree in all of them stand in any order. Keys must not be null. However many rows share an
    `ord_col`, a window sees one block of rows or a key's block sums, one row per 2**16 rows.
    `df` is read once to be sampled and once to be written.
    """
    rows = in_order(df.withColumn("__value", value.cast("bigint")), keys, [ord_col, *then])
    sums = rows.groupBy(*keys, "__block").agg(F.sum("__value").alias("__sum"))
    offsets = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(_before(keys)), F.lit(0))).drop("__sum")
    inside = (
        Window.partitionBy(*keys, "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("__inside", F.sum("__value").over(inside)).join(offsets, [*keys, "__block"])
        .withColumn(out, F.col("__inside") + F.col("__offset"))
        .select(*df.columns, out)
    )


def position(df: DataFrame, keys: list[str], ord_col: str, out: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Add `out`: 1-based position of the row within its `keys`, ordered as in `running_total`.

    Rows of a key follow each other within a block, so no window sees rows at all.
    """
    rows = in_order(df, keys, [ord_col, *then])
    sums = rows.groupBy(*keys, "__block").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    offsets = sums.withColumn("__offset", F.coalesce(F.sum("__n").over(_before(keys)), F.lit(0))).drop("__n")
    if fits_broadcast(offsets):
        offsets = F.broadcast(offsets)
    return (
        rows.join(offsets, [*keys, "__block"])
        .withColumn(out, F.col("__at") - F.col("__first") + F.col("__offset") + 1)
        .select(*df.columns, out)
    )


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First `n` rows per key. The limit runs before the shuffle too, so hot keys stay small."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n).drop("__rn")
