"""A Merkle manifest of a table: a digest per row, a tree per group, one root, and a proof for every row.

Rows of a group stand in the order of their ids; runs of `arity` consecutive nodes get a
parent until one is left, the group's subroot; subroots in the order of their groups
get the root in the same way. A level is a self-join: every node looks its siblings up by
their computed places (its run's other slots), which come from one shuffle by runs, and the rows of slot zero emit the
parents. Proofs go down again: a node's proof is its siblings, then its parent's proof.

Digests are kept as 32 bytes and hashed as hexadecimal text. Places come from
`functions.ranking.position`, so a group with a third of all rows lies over many tasks, and
the joins' keys (group, place) are unique. Each level is written to the shared folder;
nothing but numbers of rows reaches the driver.

Defined results: a null field counts as `-`; a null group is a group of its own, the first; null
ids come first; rows of one id stand in the order of their digests, so repeated rows have
leaves of the same digest side by side; a group of one row has no siblings below its
subroot; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions.joins import lookup_join
from srcgraph.functions.ranking import position
from srcgraph.llm.common import cut, shared_folder

ARITY = 3
HEX = 64
#: So many levels' proofs are put together in one plan.
LEVELS_A_PLAN = 4


def digest(text: Column) -> Column:
    """SHA-256 of text, as lower-case hexadecimal text."""
    return F.sha2(text.cast("binary"), 256)


def row_digest(columns: list[Column]) -> Column:
    """Digest of a row: `-` for null, else the length in bytes, `:`, and the value."""
    fields = [
        F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
        for c in columns
    ]
    return digest(F.concat(*fields))


def _hex(column: Column) -> Column:
    return F.lower(F.hex(column))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def _tables(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes small frames as tables of the shared folder.

    A checkpoint hands on what the optimizer knows about constant columns; over the levels above the groups,
    which have many, that knowledge grew until planning took minutes. A table starts afresh.
    """
    folder, numbers = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}", count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(numbers)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def _depth(n: int, arity: int) -> int:
    """Levels between `n` nodes and one."""
    depth = 0
    while n > 1:
        n, depth = -(-n // arity), depth + 1
    return depth


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Add `run`, the parent's place, and `sibs`: the digests of the run's other nodes, left to right, as one binary.

    nodes  (tree, height, place, digest), places of a tree from 0 without gaps
    """
    slot, keys = F.col("place") % arity, ["tree", "height", "run"]
    names = [f"slot{j}" for j in range(arity)]
    # Both sides of the join read this one shuffle: planned apart, a job's exchanges filled the driver's memory.
    dealt = nodes.withColumn("run", _div(F.col("place"), arity)).repartition(*keys)
    runs = dealt.groupBy(*keys).agg(*[F.max(F.when(slot == j, F.col("digest"))).alias(name) for j, name in enumerate(names)])
    none = F.lit("").cast("binary")
    sibs = F.concat(*[F.when(slot == j, none).otherwise(F.coalesce(name, none)) for j, name in enumerate(names)])
    # Merged, not broadcast: a job has dozens of these joins, and their tables would add up on the driver.
    return dealt.join(runs.hint("merge"), keys).withColumn("sibs", sibs).drop(*names)


def climb(nodes: DataFrame, highest: int, arity: int,
          keep: Callable[[DataFrame], DataFrame] = cut) -> tuple[list[DataFrame], DataFrame]:
    """All levels of the trees and their tops.

    nodes  (tree, height, place, digest), height being the levels above a tree's lowest, at most
           `highest`
    keep   writes a frame and reads it back

    Level k holds (tree, height, run, place, digest, sibs) of trees that are higher than k, tops (tree, height, top).
    """
    levels, tops, now = [], [], nodes
    for k in range(highest):
        tops.append(now.filter(F.col("height") == k).select("tree", "height", F.col("digest").alias("top")))
        level = keep(with_siblings(now.filter(F.col("height") > k), arity))
        levels.append(level)
        # Slot zero has its whole run: itself, then its siblings.
        whole = digest(_hex(F.concat("digest", "sibs")))
        now = level.filter(F.col("place") % arity == 0).select(
            "tree", "height", F.col("run").alias("place"), F.unhex(whole).alias("digest"),
        )
    tops.append(now.select("tree", "height", F.col("digest").alias("top")))
    return levels, keep(reduce(DataFrame.unionByName, tops))


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """`(tree, place, path)` of the lowest nodes: siblings level by level, then what stands above the tree.

    above  (tree, height, path): the proof of each tree's top
    """
    paths = above.filter(F.col("height") == len(levels)).select("tree", F.lit(0).cast("bigint").alias("place"), "path")
    for height in reversed(range(len(levels))):
        parents = paths.select("tree", F.col("place").alias("run"), F.col("path").alias("rest"))
        joined = levels[height].join(parents.hint("merge"), ["tree", "run"])
        alone = above.filter(F.col("height") == height).select("tree", F.lit(0).cast("bigint").alias("place"), "path")
        paths = joined.select("tree", "place", F.concat("sibs", "rest").alias("path")).unionByName(alone)
        if height and height % LEVELS_A_PLAN == 0:
            paths = cut(paths)
    return paths


def folded(start: Column, path: Column, place: Column, n: Column, steps: int, arity: int, used: Column | None = None) -> Column:
    """`(digest, used)`: the top that `start` leads to with the siblings in `path` (hexadecimal text)."""
    long = F.lit(0).cast("bigint")
    state = F.struct(
        start.alias("digest"), (long if used is None else used).alias("used"), place.cast("bigint").alias("place"),
        n.cast("bigint").alias("n"),
    )

    def step(s: Column, _: Column) -> Column:
        slot = s["place"] % F.lit(arity).cast("bigint")
        others = F.least(F.lit(arity).cast("bigint"), s["n"] - (s["place"] - slot)) - 1
        left = F.substr(path, (s["used"] * HEX + 1).cast("int"), (slot * HEX).cast("int"))
        right = F.substr(path, ((s["used"] + slot) * HEX + 1).cast("int"), ((others - slot) * HEX).cast("int"))
        up = F.struct(
            digest(F.concat(left, s["digest"], right)).alias("digest"), (s["used"] + others).alias("used"),
            _div(s["place"], arity).alias("place"), _div(s["n"] + (arity - 1), arity).alias("n"),
        )
        return F.when(s["n"] > 1, up).otherwise(s)

    if not steps:
        return state
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source",
             observed: Column | None = None, arity: int = ARITY) -> DataFrame:
    """`(id, leaf, subroot, root, proof, folded_root)` for every row of `docs`.

    columns   what a leaf is the digest of, in this order
    observed  a leaf digest as found now (hexadecimal text), to be folded up with the stored
              siblings; null or not given: the leaf itself

    `proof` holds the siblings from the row up to the root, hexadecimal digests joined without a
    separator. A row is verified where `folded_root` equals `root`.
    """
    leaf = row_digest([docs[c] for c in columns])
    seen = leaf if observed is None else F.coalesce(observed, leaf)
    group = docs[group_col].cast("string")
    rows = docs.select(
        docs[id_col].alias("id"), group.isNotNull().alias("named"), F.coalesce(group, F.lit("")).alias("group"),
        F.unhex(leaf).alias("digest"), F.unhex(seen).alias("seen"),
    )
    placed = position(rows, ["named", "group"], "id", "nth", then=("digest",))
    counts = cut(placed.groupBy("named", "group").agg(F.count("*").alias("n")))
    trees = position(counts.withColumn("one", F.lit(0)), ["one"], "named", "nth", then=("group",)).select(
        "named", "group", "n", (F.col("nth") - 1).alias("tree"),
    )
    sizes = counts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count("*").alias("groups")).first()
    largest, groups = sizes["largest"], sizes["groups"]

    highest, above_all = _depth(largest, arity), _depth(groups, arity)
    height = reduce(lambda a, b: a + b, [(F.col("n") > arity**k).cast("int") for k in range(highest)], F.lit(0))
    leaves = cut(lookup_join(placed, trees, ["named", "group"]).select(
        "id", "tree", "n", height.alias("height"), (F.col("nth") - 1).alias("place"), "digest", "seen",
    ))
    keep = _tables(docs.sparkSession)
    levels, tops = climb(leaves.select("tree", "height", "place", "digest"), highest, arity)
    over = tops.select(
        F.lit(0).cast("bigint").alias("tree"), F.lit(above_all).alias("height"), F.col("tree").alias("place"),
        F.col("top").alias("digest"),
    )
    upper, root = climb(over, above_all, arity, keep)
    none = root.select("tree", "height", F.lit("").cast("binary").alias("path"))
    tails = descend(upper, none).select(F.col("place").alias("tree"), "path")
    # The root is one row, so that its digest is a constant.
    top = root.first()
    value = F.lit(None).cast("binary") if top is None else F.lit(top["top"])
    above = keep(tops.join(tails, "tree").withColumn("root", value))
    paths = descend(levels, above.select("tree", "height", "path"))

    known = lookup_join(
        leaves.join(paths.hint("merge"), ["tree", "place"]), above.select("tree", F.col("top").alias("subroot"), "root"), ["tree"],
    ).withColumn("proof", _hex(F.col("path")))
    inner = folded(_hex(F.col("seen")), F.col("proof"), F.col("place"), F.col("n"), highest, arity)
    climbed = known.withColumn("inner", inner)
    whole = folded(
        F.col("inner")["digest"], F.col("proof"), F.col("tree"), F.lit(groups), above_all, arity,
        F.col("inner")["used"],
    )
    return climbed.select(
        "id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"), "proof", whole["digest"].alias("folded_root"),
    )
