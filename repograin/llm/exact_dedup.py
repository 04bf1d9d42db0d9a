"""Exact deduplication by two passes over a Bloom filter.

Pass one hashes each text and counts the hits of every Bloom cell. Cells that
were hit once cannot belong to a repeated text; the others form the filter, a
table of 64-bit words (a text's cells lie in one word, so one lookup tests it).
Pass two probes the filter: rows it rejects pass straight through, the possibly
repeated ones are shuffled by their SHA-256 and decided exactly. False hits
cost a little shuffle and change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.llm.store import WHITE, hinted, saved

CELLS = 2  # cells per text
BITS_PER_ROW = 32
FILTER_WORDS = 1 << 20  # the largest filter that is broadcast: 8 MB of bits, some 50 MB as a hash table
BROADCAST_GROUPS = 200_000


def normalized(text: Column) -> Column:
    """Runs of white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _word(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words))


def _cells(h: Column) -> list[Column]:
    mixed = F.xxhash64(h)
    return [F.shiftrightunsigned(mixed, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(CELLS)]


def _bits(h: Column) -> Column:
    out = None
    for cell in _cells(h):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), cell)
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def repeated_cells(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The filter over column ``h``: (word, mask) of the cells that several rows hit, and the number of words it is spread over."""
    words = 1 << max(6, (max(rows, 1) * BITS_PER_ROW - 1).bit_length() - 6)
    cells = hashes.select(_word(F.col("h"), words).alias("word"), F.explode(F.array_distinct(F.array(*_cells(F.col("h"))))).alias("cell"))
    hit_again = cells.groupBy("word", "cell").agg(F.count("*").alias("n")).where("n > 1")
    masks = hit_again.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, cell))").alias("mask"))
    return saved(masks, "bloom"), words


def members(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """A filter of all values of column ``h``, never larger than what is broadcast; the fuller it is, the more other values pass."""
    words = min(FILTER_WORDS, 1 << max(6, (max(rows, 1) * BITS_PER_ROW - 1).bit_length() - 6))
    masks = hashes.select(_word(F.col("h"), words).alias("word"), _bits(F.col("h")).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("mask"))
    return saved(masks, "bloom"), words


def bounded_filter(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """A filter of the values of column ``h`` that occur again, small enough for a broadcast whatever the number of rows.

    Where the filter of the cells grows over the bound, it meets the bare hashes by shuffle; those that truly
    repeat then make a filter of at most ``FILTER_WORDS`` words. The more of them, the more other rows pass it.
    """
    bloom, words = repeated_cells(hashes, rows)
    if words <= FILTER_WORDS:
        return bloom, words
    again = probe(hashes.select("h"), F.col("h"), bloom, words).where("maybe").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    again = saved(again, "repeated")
    return members(again, again.count())


def probe(df: DataFrame, h: Column, bloom: DataFrame, words: int) -> DataFrame:
    """``df`` with the column ``maybe``: true if the row's text may occur again. ``df`` has no column _w, _m or _b."""
    small = hinted(bloom.select(F.col("word").alias("_w"), F.col("mask").alias("_m")), bloom.count(), FILTER_WORDS)
    keyed = df.withColumn("_w", _word(h, words)).withColumn("_b", _bits(h))
    return keyed.join(small, "_w", "left").withColumn("maybe", F.coalesce(F.col("_m").bitwiseAND(F.col("_b")) == F.col("_b"), F.lit(False))).drop("_w", "_m", "_b")


def verdicts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key, keep_id, group_size, kept, text_sha256``.

    Of equal texts the smallest key stays, nulls counting as largest. Rows that
    repeat key and text are told apart by their place in the saved table, and
    exactly one of them stays; a null text is the empty text; an empty table
    gives no rows. Other columns are not looked at.
    """
    rows = df.select(F.col(key).alias("key"), F.unhex(F.sha2(normalized(F.col(text)), 256)).alias("sha"))
    rows = saved(rows.withColumn("h", F.xxhash64("sha")).withColumn("place", F.monotonically_increasing_id()), "hashes")
    bloom, words = bounded_filter(rows, rows.count())
    tested = probe(rows, F.col("h"), bloom, words)
    alone = tested.where(~F.col("maybe")).select("key", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = tested.where("maybe").select("key", "sha", "place")
    first = F.min(F.struct(F.col("key").isNull().alias("missing"), F.col("key"), F.col("place"))).alias("first")
    groups = saved(again.groupBy("sha").agg(first, F.count("*").alias("group_size")), "groups")  # saved, so that Spark can split a hot text in the join
    decided = again.join(hinted(groups, groups.count(), BROADCAST_GROUPS), "sha").select(
        "key", F.col("first.key").alias("keep_id"), "group_size", (F.col("place") == F.col("first.place")).alias("kept"), "sha")
    return alone.unionByName(decided).select(
        F.col("key").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; texts that the filter rejects are never shuffled, at any size.

    Equal texts with the smallest key twice are one row in the result: the one
    with the smallest original text, then the smallest hash of the other columns.
    A null text is the empty text, a null key comes last, an empty table stays
    empty. Other columns may have any names.
    """
    h = F.xxhash64(normalized(F.col(text)))
    hashes = saved(df.select(h.alias("h")), "hashes")
    bloom, words = bounded_filter(hashes, hashes.count())
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    own = F.col("row")
    order = F.struct(own[key].isNull(), own[key], own[text].isNull(), own[text], F.xxhash64(*[own[c] for c in plain]))
    tested = probe(df.select(h.alias("h"), row.alias("row")), F.col("h"), bloom, words)
    alone = tested.where(~F.col("maybe")).select("row.*")
    again = tested.where("maybe").groupBy(F.sha2(normalized(own[text]), 256)).agg(F.min_by("row", order).alias("kept")).select("kept.*")
    return alone.unionByName(again)
