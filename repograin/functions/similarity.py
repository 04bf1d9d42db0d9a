"""Exact set-similarity joins on tokens, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two token sets; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def text_similarity(a: Column, b: Column) -> Column:
    """Similarity of two texts on lower-cased words of more than two bytes."""

    def tokens(t: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: F.octet_length(w) > 2))

    x, y = tokens(a), tokens(b)
    return (
        F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0))
        .when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0))
        .otherwise(jaccard(x, y))
    )


def set_id(tokens: Column) -> Column:
    """128 bits that stand for a token set while it travels."""
    return F.unhex(F.md5(F.array_join(tokens, "\n").cast("binary")))


SAMPLE = 8  # one in so many sets is counted for the order of tokens
BUCKETS = 1 << 14  # of token hashes; the counts travel in the plan
_LOW = (1 << 40) - 1  # bits of a hash that tell tokens of equal counts apart


def _order(sets: list[DataFrame]) -> Column:
    """Counts of tokens by the bucket of their hash, over a sample of the sets: an array that has ``BUCKETS`` numbers, whatever the input."""
    counted = None
    for df in sets:
        hashes = df.where(F.pmod(F.xxhash64("sid"), F.lit(SAMPLE)) == 0).select(F.explode(F.transform("tokens", lambda t: F.xxhash64(t))).alias("h"))
        counted = hashes if counted is None else counted.unionByName(hashes)
    counts = [0] * BUCKETS
    for r in counted.groupBy(F.pmod("h", F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("n")).collect():
        counts[r.bucket] = min(r.n, (1 << 22) - 1)
    return F.split(F.lit(",".join(map(str, counts))), ",").cast("array<bigint>")


def _prefixes(sets: DataFrame, keys: list[str], order: Column, threshold: float) -> DataFrame:
    """Rarest-first prefix tokens of each set, as narrow rows: two sets above the threshold share one.

    Tokens are numbers here, made of the count of their bucket and their hash.
    Two tokens of one number only make a candidate more; the prefix is cut
    inside the row, so no other token of a set is shuffled.
    """
    number = lambda t: F.shiftleft(order[F.pmod(F.xxhash64(t), F.lit(BUCKETS))], 40).bitwiseOR(F.xxhash64(t).bitwiseAND(F.lit(_LOW)))
    n = F.size("tokens")
    keep = (n - F.ceil(n * F.lit(threshold)) + 1).cast("int")
    first = F.array_distinct(F.slice(F.sort_array(F.transform("tokens", number)), 1, keep))
    cut = sets.where(n > 0).select(*keys, "sid", n.alias("n"), first.alias("tokens"))
    return cut.select(*keys, "sid", "n", F.explode("tokens").alias("token")).withColumn("token", F.xxhash64(*keys, "token"))


def similar_ids(left: DataFrame, right: DataFrame | None, keys: list[str], threshold: float) -> DataFrame:
    """Pairs ``keys, l_sid, r_sid`` of distinct token sets with Jaccard above ``threshold``.

    Inputs hold ``keys``, ``sid`` (see ``set_id``) and a sorted, distinct ``tokens``
    array, one row per distinct set. Without ``right``, the sets of ``left`` meet
    each other, and each pair comes once, with the smaller id on the left. A
    pair must share a token of both rarest-first prefixes and have sizes within
    the threshold's ratio, so frequent tokens rarely pair sets and equal sets
    meet as one row. Any order of the tokens finds all pairs; its counts come
    from a sample of the sets, which bears on speed only. Sets travel as ids; the
    arrays come back for candidate pairs only.
    """
    order = _order([left] if right is None else [left, right])
    lp = _prefixes(left, keys, order, threshold).withColumnsRenamed({"sid": "l_sid", "n": "l_n"})
    rp = _prefixes(left if right is None else right, keys, order, threshold).withColumnsRenamed({"sid": "r_sid", "n": "r_n"})
    low, high = F.ceil(F.col("l_n") * F.lit(threshold)), F.floor(F.col("l_n") / F.lit(threshold))
    near = (F.col("r_n") >= low) & (F.col("r_n") <= high)
    if right is None:
        near = near & (F.col("l_sid") < F.col("r_sid"))
    pairs = lp.join(rp, ["token", *keys]).where(near).select(*keys, "l_sid", "r_sid").distinct()
    l_sets = left.select(*keys, F.col("sid").alias("l_sid"), F.col("tokens").alias("l_tokens"))
    r_sets = (left if right is None else right).select(*keys, F.col("sid").alias("r_sid"), F.col("tokens").alias("r_tokens"))
    shared = F.size(F.array_intersect("l_tokens", "r_tokens"))
    alike = shared / (F.size("l_tokens") + F.size("r_tokens") - shared) > threshold  # sets that share a token are not empty
    return pairs.join(l_sets, [*keys, "l_sid"]).join(r_sets, [*keys, "r_sid"]).where(alike).select(*keys, "l_sid", "r_sid")


def similar_sets(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The pairs of ``similar_ids`` with their arrays: keys, l_tokens, r_tokens; inputs need no ``sid``."""
    l_sets, r_sets = (df.select(*keys, set_id(F.col("tokens")).alias("sid"), "tokens") for df in (left, right))
    pairs = similar_ids(l_sets, r_sets, keys, threshold)
    return (
        pairs.join(l_sets.withColumnsRenamed({"sid": "l_sid", "tokens": "l_tokens"}), [*keys, "l_sid"])
        .join(r_sets.withColumnsRenamed({"sid": "r_sid", "tokens": "r_tokens"}), [*keys, "r_sid"])
        .select(*keys, "l_tokens", "r_tokens")
    )
