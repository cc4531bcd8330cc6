"""Exact dedup by a cuckoo-filter index of live digests.

A digest is the SHA-256 of a text without its ASCII white space. Two levels of the same
index see the digests: each scan task merges its own copies first, so that a text that
makes up a third of all rows reaches the shuffle as one record per task; then each
shuffle partition merges what the tasks have sent. Memory of a task is bounded by the
distinct digests of its partition; spark.sql.shuffle.partitions sets how many those are.
"""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from srcgraph.functions.joins import keyed_join
from srcgraph.llm.common import Batches, cut, keep_rows, map_batches, record, text_key, texts, with_id

#: The white space that a comparison of texts leaves out.
WHITE_SPACE = b" \t\n\x0b\x0c\r"


class CuckooIndex:
    """Cuckoo filter over 32-byte digests, with the digests and their records in buckets beside it.

    The filter answers most lookups of new digests; a hit is verified against the full
    digests kept in the bucket of content that the digest's first bucket names. When an
    insertion has moved `kicks` fingerprints without finding room, the filter is rebuilt
    at twice the size from the stored digests.
    """

    SLOTS = 4

    def __init__(self, buckets: int = 256, kicks: int = 64):
        self.mask = buckets - 1
        self.kicks = kicks
        self.size = 0
        self.resizes = 0
        self._random = random.Random(buckets)
        self.filter: list[list[int]] = [[] for _ in range(buckets)]
        self.content: list[dict[bytes, list]] = [{} for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = 1 + int.from_bytes(digest[:2], "big") % 65535
        first = int.from_bytes(digest[2:10], "big") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x9E3779B1 >> 7)) & self.mask

    def may_have(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        return mark in self.filter[first] or mark in self.filter[second]

    def get(self, digest: bytes) -> list | None:
        """The record of a live digest."""
        mark, first, second = self._places(digest)
        if mark in self.filter[first] or mark in self.filter[second]:
            return self.content[first].get(digest)
        return None

    def insert(self, digest: bytes, value: list) -> None:
        """Add a digest that is not live."""
        self.content[int.from_bytes(digest[2:10], "big") & self.mask][digest] = value
        self.size += 1
        if not self._place(digest):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it is not live."""
        if self.get(digest) is None:
            return False
        mark, first, second = self._places(digest)
        (self.filter[first] if mark in self.filter[first] else self.filter[second]).remove(mark)
        del self.content[first][digest]
        self.size -= 1
        return True

    def items(self):
        for bucket in self.content:
            yield from bucket.items()

    def _place(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            if len(self.filter[bucket]) < self.SLOTS:
                self.filter[bucket].append(mark)
                return True
        bucket = first if self._random.random() < 0.5 else second
        for _ in range(self.kicks):
            slot = self._random.randrange(self.SLOTS)
            mark, self.filter[bucket][slot] = self.filter[bucket][slot], mark
            bucket = self._other(bucket, mark)
            if len(self.filter[bucket]) < self.SLOTS:
                self.filter[bucket].append(mark)
                return True
        return False

    def _grow(self) -> None:
        stored = list(self.items())
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self.mask = buckets - 1
            self.filter = [[] for _ in range(buckets)]
            if all(self._place(digest) for digest, _ in stored):
                break
        self.content = [{} for _ in range(buckets)]
        for digest, value in stored:
            self.content[int.from_bytes(digest[2:10], "big") & self.mask][digest] = value


def _digest_rows(batches: Batches) -> Batches:
    schema = None
    for batch in batches:
        bodies = batch.column("text").to_pylist()
        schema = schema or pa.schema([
            pa.field("id", batch.schema.field("id").type), ("digest", pa.binary()), ("n_chars", pa.int64()),
            ("key", pa.int64()),
        ])
        digests = [hashlib.sha256(b.translate(None, WHITE_SPACE)).digest() for b in bodies]
        yield record(schema, batch.column("id"), digests, batch.column("n_chars"), batch.column("key"))


def _better(mine: tuple, other: tuple) -> bool:
    """Whether the row (n_chars, id, key) stays rather than `other`: longer, then smaller id, null ids last."""
    def rank(row):
        return (-row[0], row[1] is None, row[1] if row[1] is not None else 0, row[2])

    return rank(mine) < rank(other)


def _merge(batches: Batches) -> Batches:
    """One record per digest of the partition: its count and the row that stays. Count 0 withdraws the digest."""
    index, schema, withdrawn = CuckooIndex(), None, []
    for batch in batches:
        schema = schema or batch.schema
        for digest, n, chars, id_, key in zip(*(batch.column(c).to_pylist() for c in schema.names)):
            if n == 0:
                withdrawn.append(digest)
                continue
            known = index.get(digest)
            if known is None:
                index.insert(digest, [n, chars, id_, key])
                continue
            known[0] += n
            if _better((chars, id_, key), tuple(known[1:])):
                known[1:] = chars, id_, key
    for digest in withdrawn:
        index.delete(digest)
    if schema is None:
        return
    rows = []
    for digest, value in index.items():
        rows.append((digest, *value))
        if len(rows) == 10_000:
            yield record(schema, *zip(*rows))
            rows = []
    gone = [(d, 0, None, None, None) for d in set(withdrawn)]
    if rows or gone:
        yield record(schema, *zip(*rows, *gone))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_chars, key) of every row; `key` hashes the original text."""
    rows = texts(
        docs, id_col, text_col, F.coalesce(F.length(docs[text_col]), F.lit(0)).cast("bigint").alias("n_chars"),
        text_key(docs, text_col).alias("key"),
    )
    return map_batches(rows, _digest_rows, with_id(docs, id_col, "digest binary, n_chars bigint, key bigint"))


def live_digests(rows: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """(digest, n, n_chars, id, key): per live digest its number of rows and the row that stays.

    `withdrawn` has digests to delete from the index; they come out with n = 0 and nulls.
    """
    shape = StructType.fromDDL("digest binary, n bigint, n_chars bigint")
    shape = StructType([*shape.fields, rows.schema["id"], rows.schema["key"]])
    records = rows.select("digest", F.lit(1).cast("bigint").alias("n"), "n_chars", "id", "key")
    own = map_batches(records, _merge, shape)
    if withdrawn is not None:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in shape.fields[2:]]
        own = own.unionByName(withdrawn.select("digest", F.lit(0).cast("bigint").alias("n"), *nothing))
    return map_batches(own.repartition("digest"), _merge, shape)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", withdrawn: DataFrame | None = None,
) -> DataFrame:
    """(id, key, digest, keep_id, group_size, kept): one row per row of `docs`.

    Texts are equal when they are identical without their ASCII white space. Of equal
    texts the row with most code points stays, then the smallest id (null ids last).
    Null texts are empty ones. A row given several times (same id and text) stays once.
    `withdrawn` (a column `text_col`) lists texts that no longer count: rows with an equal
    text get keep_id null, group_size 0, kept false. No rows give no rows.
    """
    rows = cut(digest_rows(docs, id_col, text_col))
    gone = None
    if withdrawn is not None:
        gone = digest_rows(withdrawn.withColumn(id_col, F.lit(None).cast("bigint")), id_col, text_col).select("digest")
    groups = live_digests(rows, gone).select(
        "digest", F.col("n").alias("group_size"), F.col("id").alias("keep_id"), F.col("key").alias("keep_key"),
    )
    found = keyed_join(rows, groups, ["digest"])
    same = F.col("id").eqNullSafe(F.col("keep_id")) & F.col("key").eqNullSafe(F.col("keep_key"))
    return found.select(
        "id", "key", "digest", "keep_id", "group_size", (same & (F.col("group_size") > 0)).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    rows = cut(digest_rows(docs, id_col, text_col))
    copies = rows.groupBy("id", "key").agg(F.count("*").alias("copies"))
    stay = live_digests(rows).select(F.col("id").alias("__id"), F.col("key").alias("__stay"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__stay"))
    return keep_rows(docs, cut(copies.join(stay, same, "left_semi")), id_col, text_col)
