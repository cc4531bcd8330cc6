"""Session settings the jobs assume."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "srcgraph", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, UTC and ANSI; `conf` keys use __ for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables and checkpoints.

    A cluster names it in spark.checkpoint.dir. Only where that is unset and the master
    is local (tests, a single machine) one temporary folder per process is used.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="srcgraph-")
    return _own_dir


def cut(df: DataFrame) -> DataFrame:
    """Write `df` below the shared folder and go on from the files, which outlive executors.

    Rows keep their partitions. Spark removes the files with the frame if
    spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers of the session, once."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="srcgraph-")) / "srcgraph-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "srcgraph").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)
