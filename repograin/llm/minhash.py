"""Document fingerprints by one-permutation MinHash.

All shingles of a text are hashed once. The leading bits of a hash name its
bin, the least hash of a bin stands for it, and an empty bin borrows from a
filled one: it tries bins in an order that depends on the empty bin alone
(optimal densification), so two texts with the same filled bins borrow alike.
Of each bin the low-order bits are kept, packed into longs. Likeness is the
share of equal bins, corrected for bins that are equal by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions.ranking import running_number
from repograin.llm.store import WHITE, saved

SHINGLE = 5  # words
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 4  # kept of each bin
PER_LONG = 64 // LOW_BITS
PROBES = 8  # bins that an empty bin tries before the order over all filled bins decides
_REST = 64 - BIN_BITS
_LAST = (1 << _REST) - 1  # the rest bits of the marker that stands for an empty bin
_MARKERS = [((b - BINS // 2) << _REST) | _LAST for b in range(BINS)]


def _bin(h: Column) -> Column:
    return F.shiftright(h, _REST)


def _filled(h: Column) -> Column:
    return h.bitwiseAND(F.lit(_LAST)) != F.lit(_LAST)


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the packed bins as ``array<bigint>``, empty for a text without words (null included).

    A text of fewer than five words is one shingle. Each step is a column of
    its own, so that no step is computed twice.
    """
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - (SHINGLE - 1), F.lit(1)))
    hashes = F.when(F.size("_words") == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, SHINGLE))))
    # with a marker at the end of every bin, the first hash of each bin is at the bin's own place
    ordered = F.sort_array(F.concat(hashes, F.lit(_MARKERS)))
    firsts = F.filter("_ordered", lambda h, i: ~_bin(h).eqNullSafe(_bin(F.get("_ordered", i - 1))))

    def tried(b: Column, t: Column) -> Column:
        return F.pmod(F.xxhash64(b, t), F.lit(BINS)).cast("int")

    def borrowed(b: Column) -> Column:
        probe = F.get(F.filter(F.lit(list(range(PROBES))), lambda t: _filled(F.get("_firsts", tried(b, t)))), F.lit(0))
        order = F.array_min(F.transform("_full", lambda h: F.xxhash64(b, _bin(h)).bitwiseAND(F.lit(-BINS)).bitwiseOR(_bin(h) + BINS // 2)))
        return F.get("_firsts", F.coalesce(F.when(probe.isNotNull(), tried(b, probe)), order.bitwiseAND(F.lit(BINS - 1)).cast("int")))

    dense = F.transform("_firsts", lambda h, b: F.when(_filled(h), h).otherwise(borrowed(b)))
    low = F.lit((1 << LOW_BITS) - 1).cast("long")
    packed = F.transform(
        F.lit(list(range(BINS // PER_LONG))),
        lambda k: F.aggregate(F.slice("_dense", k * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), lambda acc, h: F.shiftleft(acc, LOW_BITS).bitwiseOR(h.bitwiseAND(low))))
    return (
        df.withColumn("_words", words).withColumn("_ordered", ordered).drop("_words")
        .withColumn("_firsts", firsts).drop("_ordered")
        .withColumn("_full", F.filter("_firsts", _filled))
        .withColumn("_dense", F.when(F.size("_full") > 0, dense))
        .withColumn(out, F.when(F.col("_dense").isNotNull(), packed).otherwise(F.array().cast("array<bigint>")))
        .drop("_firsts", "_full", "_dense")
    )


def as_text(packed: Column) -> Column:
    """The packed bins as lowercase hex digits, one per bin; none for a text without words."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles, 0 to 1. Texts without words are like each other only."""
    lowest = int("1" * PER_LONG, 16)

    def different(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(lowest)))

    equal = 1 - F.aggregate(F.zip_with(a, b, different), F.lit(0), lambda n, d: n + d) / F.lit(float(BINS))
    chance = 1.0 / (1 << LOW_BITS)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.greatest(F.lit(0.0), (equal - chance) / (1 - chance)))
    )


def edited_neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against an edited copy and against the next document, by descending key.

    The edit replaces the last third of the code points with the first as many
    of the next document; the last document's next is the first. Rows that
    repeat key and text are one document in that order and all get its result;
    rows of one key and different texts follow each other by a hash of the
    text; a null key comes last. A null text is the empty text. The text is
    shuffled once, the replaced thirds once more.
    """
    texts = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("mark", F.xxhash64("body"))
    printed = fingerprint(texts, "body", "print").select("key", "mark", F.char_length("body").alias("n"), "print")
    known = saved(printed, "prints")
    ids = known.groupBy("key", "mark").agg(F.max("n").alias("n"))
    ranked = saved(running_number(ids, [], [F.col("key").isNotNull(), F.col("key"), F.col("mark")], "place").select("key", "mark", "n", "place"), "places")
    def on(left: DataFrame, right: DataFrame):
        return left["key"].eqNullSafe(right["key"]) & (left["mark"] == right["mark"])

    one = known.groupBy("key", "mark").agg(F.first("print").alias("print"))
    asking = ranked.select(
        F.col("key").alias("ask_key"), F.col("mark").alias("ask_mark"), F.floor(F.col("n") / 3).cast("int").alias("need"),
        F.when(F.col("place") == 1, ranked.count()).otherwise(F.col("place") - 1).alias("place"))
    asked = ranked.drop("n").join(asking, "place").drop("place")
    asked = asked.join(one, on(asked, one)).select(asked["key"], asked["mark"], "ask_key", "ask_mark", "need", F.col("print").alias("next_print"))
    asked = asked.join(one, asked["ask_key"].eqNullSafe(one["key"]) & (asked["ask_mark"] == one["mark"])).select(
        asked["key"], asked["mark"], "ask_key", "ask_mark", "need", "print", likeness(F.col("print"), F.col("next_print")).alias("near_next"))
    asked = saved(asked, "asked")
    tails = (
        texts.join(asked, on(texts, asked))
        .groupBy(F.col("ask_key").alias("key"), F.col("ask_mark").alias("mark"))
        .agg(F.first(F.expr("substring(body, 1, need)")).alias("tail"), F.first("print").alias("print"), F.first("near_next").alias("near_next"))
    )
    both = texts.join(tails, on(texts, tails)).select(texts["key"], "body", F.char_length("body").alias("n_chars"), "tail", "print", "near_next")
    edited = both.withColumn("edited", F.concat(F.expr("substring(body, 1, n_chars - cast(floor(n_chars / 3) as int))"), F.col("tail"))).drop("body", "tail")
    edited = fingerprint(edited, "edited", "edited_print")
    return edited.select(
        F.col("key").alias(key), F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), "near_next")
