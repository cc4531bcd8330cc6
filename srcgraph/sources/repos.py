"""Source trees on a shared file system as a table, names starting with `_` included.

Spark's own file sources hide such names (`__init__.py`), so trees are read by a
Python data source. One partition reads one repository or several small ones, or with
`splits` > 1 one share of one: every share walks the names, but reads only its own files.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from srcgraph.schemas import SOURCE_FILES

# Directory and file names that are never read (besides dot names).
SKIPPED_NAMES = ("node_modules", "__pycache__")

#: Rows are handed over in Arrow batches of about this size.
BATCH_BYTES = 16 * 1024 * 1024


def walk(root: str) -> Iterator[str]:
    """Paths below `root` in name order."""
    stack = [iter([(root, True)])]
    while stack:
        entry = next(stack[-1], None)
        if entry is None:
            stack.pop()
            continue
        path, is_dir = entry
        if not is_dir:
            yield path
        else:
            with os.scandir(path) as found:
                inside = sorted(
                    (e.path, e.is_dir(follow_symlinks=False)) for e in found
                    if not e.name.startswith(".") and e.name not in SKIPPED_NAMES
                )
            stack.append(iter(inside))


class RepoShare(InputPartition):
    """Some repositories, or one share of a repository's files."""

    def __init__(self, roots: list[tuple[str, str]], share: int, shares: int):
        self.roots, self.share, self.shares = roots, share, shares


class RepoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base = options["path"]
        self.splits = int(options.get("splits", "1"))
        self.per_task = int(options.get("pertask", "1"))

    def partitions(self) -> list[RepoShare]:
        names = sorted(e.name for e in os.scandir(self.base) if e.is_dir() and not e.name.startswith("."))
        roots = [(name, os.path.join(self.base, name)) for name in names]
        if self.splits > 1:
            return [RepoShare([root], i, self.splits) for root in roots for i in range(self.splits)]
        return [RepoShare(roots[i:i + self.per_task], 0, 1) for i in range(0, len(roots), self.per_task)]

    def read(self, partition: RepoShare) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for repo_id, root in partition.roots:
            for place, path in enumerate(walk(root)):
                relative = path[len(root):]
                if zlib.crc32(relative.encode("utf-8", "surrogateescape")) % partition.shares != partition.share:
                    continue
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                rows.append((repo_id, place, relative, content))
                size += len(content or b"") + len(relative)
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=SOURCE_FILES.names)


class RepoSource(DataSource):
    """`spark.read.format("repos").option("splits", n).load(base)`; one sub-directory is one repository."""

    @classmethod
    def name(cls) -> str:
        return "repos"

    def schema(self):
        return SOURCE_FILES

    def reader(self, schema) -> RepoReader:
        return RepoReader(self.options)


def read_repos(spark: SparkSession, base: str, splits: int = 1, per_task: int = 1) -> DataFrame:
    """Files of all repositories below `base`.

    `splits` tasks share one repository; where that is 1, `per_task` small ones share a task.
    """
    spark.dataSource.register(RepoSource)
    return spark.read.format("repos").option("splits", str(splits)).option("pertask", str(per_task)).load(base)
