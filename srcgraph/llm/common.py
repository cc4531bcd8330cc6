"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """The id and the UTF-8 bytes of each row's text; a null text is an empty one. Other columns are not read."""
    return docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"), *more,
    )


def with_id(docs: DataFrame, id_col: str, rest: str, name: str = "id") -> StructType:
    """Schema of results that start with an id of the type it has in `docs`."""
    return StructType([StructField(name, docs.schema[id_col].dataType), *StructType.fromDDL(rest).fields])


def id_hash_mod(column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers of the session, once."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="srcgraph-")) / "srcgraph-modules.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "srcgraph").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)


def map_batches(df: DataFrame, fn: Callable[[Batches], Batches], schema: StructType) -> DataFrame:
    send_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What `make` gives, made once per Python worker and kept until another key is asked for.

    Workers serve one stage after the other; so only one operator's tables stay in memory.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Drop what another operator has kept in this Python worker."""
    _kept.clear()


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and the master is local, a temporary one is set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="srcgraph-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from the files, which outlive executors.

    Spark removes the files with the frame if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_key(docs: DataFrame, text_col: str) -> Column:
    """64-bit hash that tells rows of one id apart by their original texts; null differs from empty."""
    return F.xxhash64(docs[text_col], docs[text_col].isNull())


def unused(docs: DataFrame, name: str) -> str:
    """`name`, with underscores put after it until no column of `docs` has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs`, with all their columns, whose (id, text key) is in `kept` (id, key, copies).

    A row given several times (same id, same text) stays once. `kept` has a row per (id, key).
    """
    key = unused(docs, "__key")
    rows = docs.withColumn(key, text_key(docs, text_col))
    narrow = kept.select(F.col("id").alias("__id"), F.col("key").alias("__kept_key"))
    found = rows.join(
        narrow, rows[id_col].eqNullSafe(narrow["__id"]) & (rows[key] == narrow["__kept_key"]), "left_semi",
    )
    if not kept.filter("copies > 1").isEmpty():
        found = found.dropDuplicates([id_col, key])
    return found.drop(key)
