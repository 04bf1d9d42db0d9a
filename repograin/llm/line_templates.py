"""Line deduplication by a log-template tree of fixed depth.

A line's place in the tree is its token count and then its leading tokens, with
variable-looking tokens (any digit in them) as ``<*>``. In a leaf, a token
stays in the template only if several documents have it at its place; other
places are generalised to ``<*>``. Lines whose template keeps enough of its
tokens and recurs across documents are dropped. Leaves that lie in one document
cannot recur, so only lines of the other leaves are looked at token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.llm.exact_dedup import members, probe
from repograin.llm.store import WHITE, hinted, saved

DEPTH = 3  # leading tokens below the token count
SUPPORT = 3  # documents in which a token, and a template, must occur
SIMILARITY = 0.7  # share of a template's places that are not generalised
WILD = "<*>"
BROADCAST_ROWS = 1_000_000  # leaves, of one number
BROADCAST_TEXTS = 100_000


_WITH_DIGIT = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"  # from a token's start, without going back


def tokens(line: Column) -> Column:
    """Words of a line that has one, those with a digit as the wildcard."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, _WITH_DIGIT, WILD)).otherwise(line)
    return F.split(F.btrim(masked, F.lit(" \t\n\x0b\f\r")), WHITE)


def leaf(words: Column) -> Column:
    """The path through the tree: token count and leading tokens."""
    return F.xxhash64(F.size(words), F.slice(words, 1, DEPTH))


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no`` from 1, ``line``; a null text has no lines, an empty one has one empty line."""
    return df.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("at", "line")).select("key", (F.col("at") + 1).alias("line_no"), "line")


def line_templates(df: DataFrame, key: str = "doc_id", text: str = "text", support: int = SUPPORT, similarity: float = SIMILARITY) -> DataFrame:
    """``key, line_no, template, documents`` of every line with words that recurs across at least ``support`` documents.

    Repeats inside a document count once. Rows with a null key are one
    document, and so are rows that repeat a key. Lines without words are never
    dropped. Any number of lines may share a template.
    """
    spoken = numbered_lines(df, key, text).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    placed = spoken.withColumn("words", tokens(F.col("line"))).select("key", "line_no", leaf(F.col("words")).alias("leaf"), "words")
    # leaves that lie in several documents; the least and the largest key tell without a set of keys. With fewer lines than ``support`` no word of a leaf recurs enough
    spread = placed.groupBy("leaf").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max(F.col("key").isNull()).alias("none"), F.count("*").alias("lines"))
    shared = saved(spread.where("low < high or (none and low is not null)").where(F.col("lines") >= support).select("leaf"), "leaves")
    leaves = shared.count()
    bloom, size = members(shared.withColumnRenamed("leaf", "h"), leaves)
    near = probe(placed, F.col("leaf"), bloom, size).where("maybe").drop("maybe")  # keeps most other lines from being shuffled
    lines = saved(near.join(hinted(shared, leaves, BROADCAST_ROWS), "leaf", "left_semi"), "lines")
    # equal lines of a leaf are looked at once per document, then once altogether
    shapes = lines.select("key", "leaf", "words").distinct().groupBy("leaf", "words").agg(F.count("*").alias("n"))
    shapes = saved(shapes.withColumn("shape", F.monotonically_increasing_id()), "shapes")
    places = shapes.select("leaf", F.posexplode("words").alias("at", "word"), "n").where(F.col("word") != WILD).groupBy("leaf", "at", "word").agg(F.sum("n").alias("n"))
    kept = places.where(F.col("n") >= support).drop("n")
    spots = shapes.select("shape", "leaf", F.posexplode("words").alias("at", "word")).where(F.col("word") != WILD)
    fixed = spots.join(kept, ["leaf", "at", "word"]).groupBy("shape").agg(F.collect_list("at").alias("fixed"))  # at most the line's tokens
    general = F.transform("words", lambda w, i: F.when(F.array_contains("fixed", i), w).otherwise(WILD))
    templates = saved(
        shapes.join(fixed, "shape").where(F.size("fixed") >= similarity * F.size("words"))
        .select("leaf", "words", F.array_join(general, " ").alias("template")), "templates")
    matched = saved(lines.join(hinted(templates, templates.count(), BROADCAST_TEXTS), ["leaf", "words"]).select("key", "line_no", "template"), "matched")
    counts = matched.select("key", "template").distinct().groupBy("template").agg(F.count("*").alias("documents")).where(F.col("documents") >= support)
    counts = saved(counts, "recurring")
    return matched.join(hinted(counts, counts.count(), BROADCAST_TEXTS), "template").select(F.col("key").alias(key), "line_no", "template", "documents")


def without_recurring(df: DataFrame, key: str = "doc_id", text: str = "text", support: int = SUPPORT, similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with the recurring lines cut out of ``text``; texts without such a line are unchanged, nulls too.

    Rows are told apart by key and text here, so rows of one key and different
    texts are different documents.
    """
    marked = df.withColumn("_doc", F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("mark")))
    found = line_templates(marked, "_doc", text, support, similarity)
    cut = saved(found.groupBy("_doc").agg(F.collect_set("line_no").alias("_cut")).select(F.col("_doc.key").alias("_key"), F.col("_doc.mark").alias("_mark"), "_cut"), "cuts")  # at most a document's lines
    lines = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains("_cut", i + 1))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(F.col(text)) == F.col("_mark"))
    joined = df.join(hinted(cut, cut.count(), BROADCAST_TEXTS), same, "left")
    return joined.withColumn(text, F.when(F.col("_cut").isNotNull(), F.array_join(lines, "\n")).otherwise(F.col(text))).select(*df.columns)
