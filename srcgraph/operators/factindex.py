"""A written inverted index of facts: postings in blocks with bounds, searched without reading blocks that cannot matter.

Facts are tokenised once, when a batch of them is added. They are put in order of their sizes and cut into
ranges; a word's postings of one range are a block, which keeps its highest count and its smallest length.
From these follows the most that the block can add to a score, for whatever average length and document
frequency hold when a question is asked; what the blocks of a range add up to bounds all its facts.

A search scores the few ranges of the highest bounds first. The k-th score found so is a floor: ranges whose
bound stays below are left out, with the blocks of all words. Their facts cannot be among the best k, so the
answer is exactly that of scoring everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions.joins import BROADCAST_BYTES, BROADCAST_ROWS, fits_broadcast, keyed_join
from srcgraph.functions.ranking import first_n, in_order
from srcgraph.operators.search import K1, TOP_FACTS, B, context_of, matched, ranked, words
from srcgraph.session import cut, send_package

#: A range holds at most 2**RANGE_BITS facts, so a block at most as many postings.
RANGE_BITS = 9
#: Ranges that are scored to get a floor.
PROBES = 4
#: Words that a task holds before it gathers the ranges it has whole.
GATHERED = 1 << 21
#: Questions whose weights for a block go in one row, about.
PART = 1024
#: Scores are rounded to six places; ranges this close to the floor are read.
MARGIN = 1e-5


def _share(tf: Column, length: Column, avg_len: Column) -> Column:
    """What a word adds to a score for each unit of its weight; grows with `tf`, falls with `length`."""
    return tf * (K1 + 1) / (tf + K1 * (F.lit(1 - B) + F.lit(B) * length / avg_len))


def add_facts(facts: DataFrame, path: str, batch: int) -> None:
    """Add a batch of facts (group_id, uuid, fact) to the index in `path`.

    uuid is unique over all batches. A batch that is written again replaces itself, so that a job may be repeated; a
    null fact has no words and no length. The table of facts is written last, and only batches that it has are read.
    """
    # Ordered by bytes, which follow the number of words: so texts are not split while they are dealt.
    placed = in_order(facts.select("group_id", "uuid", "fact", F.octet_length("fact").alias("bytes")), ["group_id"], ["bytes", "uuid"])
    ranged = placed.select("group_id", "uuid", "fact", F.shiftright("__at", RANGE_BITS).alias("range"))
    # Texts are dealt by ranges, once; their words are counted and gathered there.
    said = ranged.repartition("range").sortWithinPartitions("range").select(
        "group_id", "uuid", "range", words(F.col("fact")).alias("words"))
    send_package(facts.sparkSession)
    kinds = dict(facts.dtypes)
    blocks = said.mapInArrow(_gather, (
        f"group_id {kinds['group_id']}, word string, range bigint, n bigint, max_tf int, min_len int, "
        f"postings array<struct<uuid: {kinds['uuid']}, tf: int, len: int>>"))
    blocks.write.mode("overwrite").parquet(f"{path}/postings/batch={batch}")
    ranged.select("group_id", "uuid", F.size(words(F.col("fact"))).alias("len"), "fact").write.mode("overwrite").parquet(
        f"{path}/facts/batch={batch}")


def _gather(batches):
    """Blocks of rows (group_id, uuid, range, words) that are sorted by range, as a function of Arrow batches."""
    import pyarrow as pa

    held, n_words = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n_words += len(batch.column(3).flatten())
        if n_words > GATHERED:
            table = pa.Table.from_batches(held)
            ranges = table.column(2).to_numpy()
            done = int(ranges.searchsorted(ranges[-1]))  # the last range may go on
            if done:
                yield from _blocks(table.slice(0, done).combine_chunks())
            held = table.slice(done).combine_chunks().to_batches()
            n_words = sum(len(b.column(3).flatten()) for b in held)
    if held:
        yield from _blocks(pa.Table.from_batches(held).combine_chunks())


def _blocks(rows):
    """Blocks of whole ranges: pairs of a fact and a word are counted, then put together by group, range and word."""
    import numpy as np
    import pyarrow as pa

    group, uuid, ranges, said = (c.combine_chunks() for c in rows.columns)
    lengths = said.value_lengths().fill_null(0).to_numpy()
    coded = said.flatten().dictionary_encode()
    n = max(1, len(coded.dictionary))
    pairs, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * n + coded.indices.to_numpy(), return_counts=True)
    if not len(pairs):
        return
    fact, word = pairs // n, pairs % n
    kinds = group.dictionary_encode()
    named = kinds.indices.fill_null(len(kinds.dictionary)).to_numpy().astype("int64")
    place = np.unique(ranges.to_numpy(), return_inverse=True)[1] * (len(kinds.dictionary) + 1) + named
    key = place[fact] * n + word
    order = np.argsort(key, kind="stable")
    fact, word, tf, key = fact[order], word[order], tf[order], key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    first = pa.array(fact[starts])
    postings = pa.ListArray.from_arrays(
        pa.array(np.append(starts, len(key)), pa.int32()),
        pa.StructArray.from_arrays(
            [uuid.take(pa.array(fact)), pa.array(tf, pa.int32()), pa.array(lengths[fact], pa.int32())], names=["uuid", "tf", "len"]))
    yield pa.RecordBatch.from_arrays([
        group.take(first), coded.dictionary.take(pa.array(word[starts])), ranges.take(first),
        pa.array(np.diff(starts, append=len(key)), pa.int64()), pa.array(np.maximum.reduceat(tf, starts), pa.int32()),
        pa.array(np.minimum.reduceat(lengths[fact], starts), pa.int32()), postings,
    ], names=["group_id", "word", "range", "n", "max_tf", "min_len", "postings"])


def indexed_facts(spark: SparkSession, path: str) -> DataFrame:
    """`(group_id, uuid, len, fact, batch)` of all batches."""
    return spark.read.parquet(f"{path}/facts")


def _weighted(spark: SparkSession, path: str, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of the words asked for, and per question and block the most it adds (`most`) and the word's `idf`."""
    asked = questions.select(
        "group_id", "question_id", F.explode(F.array_distinct(words(F.col("question")))).alias("word"))
    vocabulary = asked.select("group_id", "word").distinct()
    facts = indexed_facts(spark, path)
    sizes = facts.groupBy("group_id").agg(F.count("*").alias("n_facts"), F.avg(F.col("len").cast("double")).alias("avg_len"))
    stored = spark.read.parquet(f"{path}/postings").join(F.broadcast(facts.select("batch").distinct()), "batch", "left_semi")
    found = cut(matched(stored, vocabulary, ["group_id", "word"], fits_broadcast(asked), "left_semi"))
    df = found.groupBy("group_id", "word").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.col("n_facts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    parts = questions.count() // PART + 1
    weights = keyed_join(keyed_join(asked, df, ["group_id", "word"]), sizes, ["group_id"]).select(
        "group_id", "question_id", "word", idf.alias("idf"), "avg_len",
        F.pmod(F.xxhash64(F.col("question_id").cast("string")), F.lit(parts)).alias("part"))
    slim = found.select("group_id", "word", "batch", "range", "max_tf", "min_len")
    met = slim.join(weights, ["group_id", "word"]).withColumn(
        "most", F.col("idf") * _share(F.col("max_tf"), F.col("min_len"), F.col("avg_len"))
    )
    return found, cut(met)


_BLOCK = ["group_id", "word", "batch", "range"]
_ASKED = ["group_id", "question_id"]


def _scored(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """`(uuid, group_id, question_id, score)` over the chosen blocks.

    A block moves once for all questions that ask its word, to where its range's other blocks go: there
    a fact's score is added up without moving what its words add.
    """
    wanted = cut(chosen.groupBy(*_BLOCK, "part").agg(F.collect_list(F.struct("question_id", "idf", "avg_len")).alias("asks")))
    few = fits_broadcast(wanted.drop("asks"), max_bytes=BROADCAST_BYTES // 4) and fits_broadcast(wanted.select(F.explode("asks")))
    met = blocks.select(*_BLOCK, "postings").join(F.broadcast(wanted) if few else wanted, _BLOCK)
    place = ["group_id", "batch", "range", "part"]
    rows = met.select(*place, "asks", "postings").repartition(*place).select(*place, "postings", F.explode("asks").alias("a")).select(
        *place, F.col("a.question_id").alias("question_id"), F.col("a.idf").alias("idf"), F.col("a.avg_len").alias("avg_len"),
        F.explode("postings").alias("p"))
    score = F.col("idf") * _share(F.col("p.tf"), F.col("p.len"), F.col("avg_len"))
    sums = rows.groupBy(*place, F.col("p.uuid").alias("uuid"), "question_id").agg(F.sum(score).alias("score"))
    return sums.select("uuid", *_ASKED, "score")


def blocks_to_read(blocks: DataFrame, met: DataFrame, k: int) -> DataFrame:
    """Rows of `met` whose blocks may hold one of a question's best `k` facts."""
    place = [*_ASKED, "batch", "range"]
    bounds = met.groupBy(*place).agg(F.sum("most").alias("bound"))
    probes = first_n(bounds, _ASKED, [F.desc("bound"), F.asc("batch"), F.asc("range")], PROBES)
    found = _scored(blocks, met.join(probes.select(*place), place, "left_semi"))
    first = first_n(found, _ASKED, [F.desc("score"), F.asc("uuid")], k)
    floors = first.groupBy(*_ASKED).agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("floor"))
    wanted = bounds.join(floors, _ASKED).filter(F.col("bound") >= F.col("floor") - MARGIN).select(*place)
    return met.join(wanted, place, "left_semi")


def search_index(spark: SparkSession, path: str, questions: DataFrame, k: int = TOP_FACTS) -> DataFrame:
    """`(group_id, question_id, rank, uuid, score)`: what `search_facts` gives for all facts of the index.

    questions  (group_id, question_id, question); those without a known word get no rows
    """
    blocks, met = _weighted(spark, path, questions)
    scored = _scored(blocks, blocks_to_read(blocks, met, k))
    return ranked(scored.withColumn("score", F.round("score", 6)), k)


def index_context(spark: SparkSession, path: str, questions: DataFrame, k: int = TOP_FACTS) -> DataFrame:
    """`query_context` out of the index: texts are read for the winners only."""
    top = cut(search_index(spark, path, questions, k))
    keys = F.broadcast(top) if fits_broadcast(questions, max_rows=BROADCAST_ROWS // k) else top
    texts = indexed_facts(spark, path).join(keys, ["group_id", "uuid"])
    return context_of(texts, questions)
