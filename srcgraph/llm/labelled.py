"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_ids(
    labels: DataFrame, label_col: str, learn: Column, per_class: int, id_col: str = "doc_id",
) -> list[tuple[object, int]]:
    """Up to `per_class` (id, label) of either class, those whose ids hash lowest.

    `learn` says which rows may be learned from. Rows without an id or a label of 0 or 1
    are left out; an id with both labels counts as 1.
    """
    known = labels.filter(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    one = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    out: list[tuple[object, int]] = []
    for label in (0, 1):
        rows = one.filter(F.col("label") == label).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
        out += [(r[0], r[1]) for r in rows.collect()]
    return out


def sampled(docs: DataFrame, ids: list[tuple[object, int]], id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose ids were sampled, with their label in `__label`."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = spark.createDataFrame(ids, f"__id {kind}, __label int")
    own = docs.drop("__label")
    return own.join(F.broadcast(chosen), own[id_col] == chosen["__id"]).drop(chosen["__id"])
