"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 23, 23 and 18 bits, the last one filled up
with zeros. Every 23-bit word is at most 3 bits away from exactly one word of the perfect
binary Golay code, so a segment is hashed by the 12-bit indices of the codewords near it:

* two words 1 bit apart: the nearest codeword of one is at most 4 bits from the other;
* two words 2 bits apart: the nearest codeword of the word between them is at most 4
  bits from both. At most 6 codewords are that near to a word.

If two fingerprints differ in at most 4 bits, some two of their three segments hold at
most 2 of these: one each, or both in one segment with the other segment equal. Keys for
every pair of segments cover both cases; equal keys are verified bit by bit.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.joins import keyed_join
from srcgraph.llm.common import Batches, cut, keep_rows, map_batches, record, release, text_key, texts, with_id

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Generator polynomial of the (23, 12) Golay code, and the segments' first bits.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Keys shared by at most this many fingerprints are verified pair by pair, by blocks up to the next bound.
SMALL, LARGE = 8, 2048


# -- fingerprints ---------------------------------------------------------------------------------

def fingerprint(text: bytes) -> int:
    """Bits set in over half of the XXH64 of all shingles of 4 words; 0 for a text without words.

    Words are split at ASCII white space, A-Z lower-cased; fewer words than 4 are one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[min(SHINGLE, len(words)) - 1:])], np.uint64,
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at:at + (1 << 16)]
        counts += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _fingerprints(batches: Batches) -> Batches:
    release()
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(found), batch.column("key")], names=["id", "fp", "key"],
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, key): the fingerprint of every row as a signed 64-bit number, and the key of its text."""
    rows = texts(docs, id_col, text_col, text_key(docs, text_col).alias("key"))
    return map_batches(rows, _fingerprints, with_id(docs, id_col, "fp bigint, key bigint"))


# -- Golay code -----------------------------------------------------------------------------------

def _remainder(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where((words >> bit) & 1, GENERATOR << (bit - 11), 0)
    return words


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of up to 3 bits, its weight, and the 5 patterns of 4 bits (0 if it has none)."""
    nearest, weight = np.zeros(2048, np.int64), np.zeros(2048, np.int64)
    far: list[list[int]] = [[] for _ in range(2048)]
    for bits in range(1, 5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), bits)], np.int64)
        syndromes = _remainder(patterns)
        if bits < 4:
            nearest[syndromes], weight[syndromes] = patterns, bits
        else:
            for s, p in zip(syndromes.tolist(), patterns.tolist()):
                far[s].append(p)
    return nearest, weight, np.array([f or [0] * 5 for f in far], np.int64)


def nearest_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword at most 3 bits away."""
    return (words ^ _tables()[0][_remainder(words)]) >> 11


def near_indices(words: np.ndarray) -> np.ndarray:
    """Per word six indices of the codewords at most 4 bits away; -1 where there are fewer."""
    nearest, _, far = _tables()
    syndrome = _remainder(words)
    others = far[syndrome]
    return np.concatenate([
        ((words ^ nearest[syndrome]) >> 11)[:, None],
        np.where(others > 0, (words[:, None] ^ others) >> 11, -1),
    ], axis=1)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position of the fingerprint, kind) of all keys. Kinds: 0 looks up 1, 1 is looked up, 2 does both."""
    segments = [(fps >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1) for first, bits in SEGMENTS]
    near = [near_indices(s) for s in segments]
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    every = np.arange(len(fps))

    def add(family: int, key: np.ndarray, valid: np.ndarray, kind: int) -> None:
        rows = np.broadcast_to(every.reshape((-1,) + (1,) * (key.ndim - 1)), key.shape)
        out.append(((family << 40 | key)[valid], rows[valid], kind))

    for family, (a, b) in enumerate(combinations(range(3), 2)):
        both = near[a][:, :, None] << 12 | near[b][:, None, :]
        add(3 * family, both, (near[a] >= 0)[:, :, None] & (near[b] >= 0)[:, None, :], 0)
        add(3 * family, near[a][:, 0] << 12 | near[b][:, 0], np.ones(len(fps), bool), 1)
        add(3 * family + 1, segments[a][:, None] << 12 | near[b], near[b] >= 0, 2)
        add(3 * family + 2, segments[b][:, None] << 12 | near[a], near[a] >= 0, 2)
    return (
        np.concatenate([k for k, _, _ in out]), np.concatenate([r for _, r, _ in out]),
        np.concatenate([np.full(len(k), kind, np.int8) for k, _, kind in out]),
    )


# -- links ----------------------------------------------------------------------------------------

CROWDED = 3
KEYED = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("kind", pa.int8())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal sorted keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.concatenate([first, [len(keys)]]))


def _emit_keys(large: int):
    """Rows (key, fp, kind) of a partition's fingerprints.

    Of a key that already has over `large` rows in a batch, only large + 1 go to the
    shuffle, enough to show that it is crowded; its fingerprints go with kind `CROWDED`.
    """
    def run(batches: Batches) -> Batches:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            key, row, kind = keys_of(fps.view(np.uint64))
            order = np.argsort(key, kind="stable")
            key, row, kind = key[order], row[order], kind[order]
            first, length = _runs(key)
            nth = np.arange(len(key)) - np.repeat(first, length)
            crowded = np.unique(row[np.repeat(length > large, length)])
            stay = nth <= large
            parts = [(key[stay], fps[row[stay]], kind[stay])]
            if len(crowded):
                parts.append((fps[crowded], fps[crowded], np.full(len(crowded), CROWDED, np.int8)))
            for columns in parts:
                for at in range(0, len(columns[0]), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at:at + (1 << 18)]) for c in columns], schema=KEYED)
    return run


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def spanning_links(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what fingerprints at most 4 bits apart connect: each is reached once."""
    left = np.unique(fps)
    out, open_ = [], np.zeros(0, fps.dtype)
    while len(left) or len(open_):
        if not len(open_):
            open_, left = left[:1], left[1:]
        one, open_ = open_[0], open_[1:]
        near = _distance(left, one) <= DISTANCE
        if near.any():
            found = left[near]
            out.append((np.full(len(found), one), found))
            open_, left = np.concatenate([open_, found]), left[~near]
    return out


def _match(large: int):
    """Links among fingerprints that share a key, from rows sorted by key.

    Runs of up to `SMALL` rows are verified pair by pair, longer ones give spanning links.
    A run of over `large` rows is not held: its fingerprints come out as crowded (b null).
    """
    def run(batches: Batches) -> Batches:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        crowded_key: int | None = None

        def links(key: np.ndarray, fp: np.ndarray, kind: np.ndarray) -> Batches:
            marked = kind == CROWDED
            if marked.any():
                own = np.unique(fp[marked])
                yield record_links(own, None)
                key, fp, kind = key[~marked], fp[~marked], kind[~marked]
            first, length = _runs(key)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            size = np.repeat(length, length)
            short = (size > 1) & (size <= SMALL)
            k, f, t = key[short], fp[short], kind[short]
            for gap in range(1, SMALL):
                if len(k) <= gap:
                    break
                same = k[gap:] == k[:-gap]
                a, b, ka, kb = f[:-gap][same], f[gap:][same], t[:-gap][same], t[gap:][same]
                near = ((ka != 0) | (kb != 0)) & (a != b) & (_distance(a.view(np.uint64), b.view(np.uint64)) <= DISTANCE)
                found.append((a[near], b[near]))
            seen: set[bytes] = set()
            for at, n in zip(first[length > SMALL].tolist(), length[length > SMALL].tolist()):
                own = np.unique(fp[at:at + n])
                if len(own) > large:
                    yield record_links(own, None)
                elif (mark := own.tobytes()) not in seen:
                    seen.add(mark)
                    found += [(a.view(np.int64), b.view(np.int64)) for a, b in spanning_links(own.view(np.uint64))]
            if found:
                a, b = (np.concatenate(side) for side in zip(*found))
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield record_links(pairs[:, 0], pairs[:, 1])

        for batch in batches:
            now = tuple(batch.column(c).to_numpy() for c in ("key", "fp", "kind"))
            if not len(now[0]):
                continue
            if crowded_key is not None:
                end = int(np.searchsorted(now[0], crowded_key, side="right"))
                if end:
                    yield record_links(np.unique(now[1][:end]), None)
                now = tuple(c[end:] for c in now)
                if not len(now[0]):
                    continue
                crowded_key = None
            key, fp, kind = (np.concatenate(c) for c in zip(*held, now)) if held else now
            last = int(np.searchsorted(key, key[-1], side="left"))
            yield from links(key[:last], fp[:last], kind[:last])
            held = [(key[last:], fp[last:], kind[last:])]
            if len(key) - last > 4 * large + 4 and (kind[last:] != CROWDED).all():
                yield record_links(np.unique(fp[last:]), None)
                crowded_key, held = int(key[-1]), []
        if held:
            yield from links(*held[0])
    return run


def record_links(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    return record(LINK, a, b if b is not None else pa.nulls(len(a), pa.int64()))


@cache
def _ball() -> np.ndarray:
    """All patterns of up to 2 bits of 64."""
    one = [1 << b for b in range(64)]
    return np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64)


def _emit_ball(batches: Batches) -> Batches:
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(fps), 100):
            own = fps[at:at + 100]
            centre = (own[:, None] ^ _ball()).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(centre), pa.array(np.repeat(own, len(_ball())).view(np.int64))], names=["centre", "fp"],
            )


def _chain(batches: Batches) -> Batches:
    """Link each fingerprint to the next one of the same centre; rows come sorted by centre."""
    before: tuple | None = None
    for batch in batches:
        centre, fp = batch.column("centre").to_numpy(), batch.column("fp").to_numpy()
        if not len(centre):
            continue
        if before is not None:
            centre, fp = np.concatenate([[before[0]], centre]), np.concatenate([[before[1]], fp])
        same = (centre[1:] == centre[:-1]) & (fp[1:] != fp[:-1])
        if same.any():
            a, b = fp[:-1][same], fp[1:][same]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield record_links(pairs[:, 0], pairs[:, 1])
        before = centre[-1], fp[-1]


def near_links(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """(a, b), a < b: links that connect all distinct fingerprints (column fp) at most 4 bits apart.

    Not every pair is listed: within a key of many fingerprints a spanning set is, which
    connects the same. Fingerprints of keys with over `large` of them are linked another
    exact way: two are at most 4 bits apart if and only if some number is at most 2 bits
    from both, so all numbers that near are listed and neighbours under each are linked.
    """
    keyed = map_batches(fps, _emit_keys(large), "key bigint, fp bigint, kind tinyint")
    sorted_ = keyed.repartition("key").sortWithinPartitions("key")
    found = cut(map_batches(sorted_, _match(large), "a bigint, b bigint"))
    links = found.filter("b IS NOT NULL")
    crowded = found.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if not crowded.isEmpty():
        centres = map_batches(crowded, _emit_ball, "centre bigint, fp bigint")
        dealt = centres.repartition("centre").sortWithinPartitions("centre", "fp")
        links = links.unionByName(map_batches(dealt, _chain, "a bigint, b bigint"))
    return links.distinct()


# -- components -----------------------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of `links` (a, b).

    Alternating steps make every node point to the smallest of its neighbours, first for
    its larger ones, then for itself, until nothing changes. Each step is a partial
    aggregate and a join whose hot keys adaptive execution splits.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = keyed_join(both, lowest, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.filter("u != v").distinct()
        own = star.groupBy("u").agg(F.min("v").alias("m"))
        small = keyed_join(star, own, ["u"])
        edges = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
            .unionByName(own.select("u", F.col("m").alias("v"))).distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """(id, fp, key, component_id): one row per row of `docs`.

    Rows are linked when their fingerprints differ in at most 4 bits; component_id is the
    smallest id reachable over links (null ids count as larger than any). Equal texts,
    repeated rows, null texts and texts without words are rows like any other: the latter
    two have fingerprint zero. No rows give no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    # a checkpoint keeps the aggregate's few partitions; keys are many per fingerprint, so deal them out
    roots = components(near_links(fps.select("fp").repartition("fp"), large))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"),
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = keyed_join(rooted.select("fp", "root"), ids, ["root"]).select("fp", "component_id")
    return keyed_join(rows, classes, ["fp"]).select("id", "fp", "key", "component_id")


def hex_of(fp: str) -> Column:
    """16 lowercase hex digits of a signed 64-bit number."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest id, with all its columns; rows with equal ids by their text's key."""
    found = near_duplicates(docs, id_col, text_col)
    first = found.groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first"),
    ).select(F.col("first.id").alias("id"), F.col("first.key").alias("key"))
    copies = found.groupBy("id", "key").agg(F.count("*").alias("copies"))
    kept = cut(copies.join(
        first.withColumnRenamed("id", "__id").withColumnRenamed("key", "__key"),
        F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left_semi",
    ))
    return keep_rows(docs, kept, id_col, text_col)
