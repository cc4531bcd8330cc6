"""Line dedup by a log-template tree, in DataFrame functions only.

Tokens with a digit become variable fields. The tree has a fixed depth: a line goes to
the leaf of its token count and its first tokens. A leaf is one template if most of what
follows the first tokens is the same in all its lines, the parts that differ being
variable fields too; otherwise each line is a template. Parts are single tokens, or even
stretches of them in long lines, and are compared by the smallest and largest hash of a
leaf, which partial aggregates give. Lines of templates that recur in many documents are
dropped.

`drop_recurring_passages` decides line by line instead, so that strangers in a leaf do not
end its template: each token after the first ones has its most frequent value in the leaf,
and lines that agree with at least half of those are the leaf's dominant template. Every
other line is a template of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.functions.joins import fits_broadcast, keyed_join, lookup_join
from srcgraph.llm.common import cut, text_key, unused

LEADING = 3
PARTS = 16
ALIKE = 0.5
MIN_DOCS = 20
#: For passages: documents that a template needs, and from LONG tokens on, where chance repeats are ruled out.
FEW_DOCS, LONG, LONG_DOCS = 5, 50, 3

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
#: A token with a digit: from its start, in one go, so that long tokens take one look.
VARIABLE = "(?<![^\\x20\\x09-\\x0D])[^0-9\\x20\\x09-\\x0D]*+[0-9][^\\x20\\x09-\\x0D]*+"


def masked(line: Column) -> Column:
    """The line's tokens, one space apart, those with a digit as <*>. Most lines need neither rewriting."""
    fields = F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(line)
    spaced = F.when(line.rlike("[\\x09-\\x0D]|  "), F.regexp_replace(fields, WHITE_SPACE, " ")).otherwise(fields)
    return F.trim(spaced)


def _part(tokens: Column, count: Column, part: int) -> Column:
    """Hash of the tokens after the leading ones that fall into this part."""
    rest = count - LEADING
    first = F.floor(rest * part / PARTS).cast("int")
    end = F.floor(rest * (part + 1) / PARTS).cast("int")
    # up to PARTS tokens are a part each; F.floor spreads more of them evenly
    short = F.slice(tokens, F.lit(LEADING + part + 1), F.lit(1))
    long = F.slice(tokens, LEADING + first + 1, F.greatest(end - first, F.lit(0)))
    return F.xxhash64(F.when(rest <= PARTS, short).otherwise(long))


def _count(body: str) -> Column:
    """Number of tokens of a masked line."""
    return F.length(body) - F.length(F.replace(F.col(body), F.lit(" "), F.lit(""))) + 1


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, nth, body, leaf): the lines that have tokens, masked, and the leaves they go to."""
    rows = docs.select(
        docs[id_col].alias("id"), text_key(docs, text_col).alias("key"),
        F.posexplode(F.split(F.coalesce(docs[text_col], F.lit("")), "\n", -1)).alias("nth", "line"),
    )
    seen = rows.select("id", "key", "nth", masked(F.col("line")).alias("body")).filter("body != ''")
    leading = F.substring_index("body", " ", LEADING)
    return seen.withColumn("leaf", F.md5(F.concat_ws(" ", _count("body").cast("string"), leading)))


def templates(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, alike): whether all lines of a leaf are one template, for the leaves (one column) asked for."""
    asked = lookup_join(lines.select("leaf", "body"), leaves, ["leaf"], "left_semi")
    split = asked.select("leaf", F.split("body", " ").alias("tokens")).withColumn("n", F.size("tokens"))
    parts = split.select(
        "leaf", F.least(F.greatest(F.col("n") - LEADING, F.lit(0)), F.lit(PARTS)).alias("parts"),
        *[_part(F.col("tokens"), F.col("n"), p).alias(f"p{p}") for p in range(PARTS)],
    )
    ends = [end(f"p{p}").alias(f"{name}{p}") for p in range(PARTS) for name, end in (("low", F.min), ("high", F.max))]
    same = F.lit(0)
    for p in range(PARTS):
        same = same + ((F.col(f"low{p}") == F.col(f"high{p}")) & (F.col("parts") > p)).cast("int")
    found = parts.groupBy("leaf").agg(F.first("parts").alias("parts"), *ends)
    return found.select("leaf", (same >= F.col("parts") * ALIKE).alias("alike"))


def recurring(docs: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, key, nth) of the lines whose template occurs in at least `min_docs` documents.

    Rows with equal id and text are one document. A template of that many documents has a
    leaf of at least that many lines, so only the lines of such leaves are compared.
    """
    lines = lines_of(docs, id_col, text_col)
    places = cut(lines.select("id", "key", "nth", "leaf", F.md5("body").alias("line")))
    crowded = cut(places.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("leaf"))
    alike = templates(lines, crowded)
    found = cut(lookup_join(lookup_join(places, crowded, ["leaf"], "left_semi"), cut(alike), ["leaf"]).select(
        "id", "key", "nth", F.when(F.col("alike"), F.col("leaf")).otherwise(F.col("line")).alias("template"),
    ))
    pairs = found.select("template", "id", "key").distinct()
    often = pairs.groupBy("template").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    return keyed_join(found, often.select("template"), ["template"]).select("id", "key", "nth").distinct()


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
) -> DataFrame:
    """All columns of `docs`, lines of recurring templates taken out of the text, and n_lines, n_dropped.

    Lines end at a line feed. Lines without tokens stay. A null text stays null and has no
    lines, an empty one has one. Rows keep their number; a row given several times is one
    document. A column of `docs` named n_lines or n_dropped is replaced.
    """
    gone = recurring(docs, id_col, text_col, min_docs)
    return _without(docs, cut(gone.groupBy("id", "key").agg(F.collect_set("nth").alias("__gone"))), text_col, id_col)


def _without(docs: DataFrame, lists: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    """Take the lines of `lists` ((id,) key, __gone) out of the texts; without `id_col` by text alone."""
    if fits_broadcast(lists):  # texts then stay where they are
        lists = F.broadcast(lists)
    key = unused(docs, "__key")
    rows = docs.withColumn(key, text_key(docs, text_col))
    gone = lists["__gone"]
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    on = rows[key] == lists["key"]
    if id_col is not None:
        on = rows[id_col].eqNullSafe(lists["id"]) & on
    joined = rows.join(lists, on, "left")
    lines = F.split(rows[text_col], "\n", -1)
    kept = F.filter(lines, lambda line, nth: ~F.array_contains(gone, nth))
    text = F.when(gone.isNull(), rows[text_col]).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias(c) if c == text_col else rows[c] for c in names],
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def dominant(bodies: DataFrame) -> DataFrame:
    """(leaf, line) of the lines that belong to their leaf's dominant template.

    bodies  (leaf, line, body, docs), a row per distinct line of more than LEADING tokens

    A token's value counts once per document of its lines; of equally frequent ones the last in byte order is taken.
    """
    split = bodies.select("leaf", "line", "docs", F.split("body", " ").alias("tokens"))
    rest = F.slice("tokens", F.lit(LEADING + 1), F.greatest(F.size("tokens") - LEADING, F.lit(0)))
    lines = cut(split.select("leaf", "line", "docs", rest.alias("tokens")))
    values = lines.select("leaf", "docs", F.posexplode("tokens").alias("pos", "token"))
    counts = values.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("docs"))
    most = counts.groupBy("leaf", "pos").agg(F.max(F.struct("docs", "token")).alias("most"))
    shape = most.groupBy("leaf").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("most.token").alias("token")))).alias("shape")
    )
    met = keyed_join(lines, shape, ["leaf"])
    agree = F.size(F.filter(F.zip_with("tokens", "shape", lambda a, b: a == b["token"]), lambda same: same))
    return met.filter(agree >= F.size("tokens") * ALIKE).select("leaf", "line")


def recurring_passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, nth) of the lines whose template occurs in enough documents for its length; equal texts are one document."""
    least = F.when(F.col("n") >= LONG, LONG_DOCS).otherwise(FEW_DOCS)
    lines = lines_of(docs, id_col, text_col).withColumn("n", _count("body"))
    places = cut(lines.select("key", "nth", "leaf", "n", F.md5("body").alias("line")))
    crowded = cut(places.groupBy("leaf", "n").agg(F.count("*").alias("lines")).filter(F.col("lines") >= least).select("leaf"))
    held = cut(lookup_join(places, crowded, ["leaf"], "left_semi").distinct())
    kinds = cut(held.select("leaf", "n", "line", "key").distinct().groupBy("leaf", "n", "line").agg(F.count("*").alias("docs")))
    mixed = cut(
        kinds.filter(F.col("n") > LEADING).groupBy("leaf").agg(F.count("*").alias("lines")).filter("lines > 1").select("leaf")
    )
    asked = lookup_join(lines.select("leaf", F.md5("body").alias("line"), "body"), mixed, ["leaf"], "left_semi")
    bodies = keyed_join(asked.distinct(), kinds.select("leaf", "line", "docs"), ["leaf", "line"])
    alike = cut(dominant(bodies).withColumn("alike", F.lit(True)))
    found = cut(lookup_join(held, alike, ["leaf", "line"], "left").select(
        "key", "nth", "n", F.when(F.col("alike"), F.col("leaf")).otherwise(F.concat(F.lit("line "), F.col("line"))).alias("template"),
    ))
    pairs = found.select("template", "n", "key").distinct()
    often = pairs.groupBy("template", "n").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least)
    return keyed_join(found, often.select("template"), ["template"]).select("key", "nth")


def drop_recurring_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `drop_recurring_lines`, by dominant templates in `FEW_DOCS` documents, long ones in `LONG_DOCS`."""
    gone = recurring_passages(docs, id_col, text_col)
    return _without(docs, cut(gone.groupBy("key").agg(F.collect_set("nth").alias("__gone"))), text_col)
