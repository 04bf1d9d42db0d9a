"""Which texts contain which names, inside a key, without testing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.session import saved

_SEPARATOR = r"[^\p{L}\p{N}]+"
_GRAM = 3
BROADCAST_ROWS = 300_000  # tokens, or names; beyond it Spark joins by shuffle
FEW = 256  # names of a key that are looked for in each of its texts


def tokens(text: Column) -> Column:
    """Distinct runs of letters and digits, of any script."""
    return F.filter(F.array_distinct(F.split(text, _SEPARATOR)), lambda t: t != "")


def _grams(token: Column, n: Column) -> Column:
    """Distinct pieces of ``n`` characters of a token at least that long."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) - n + 1), lambda i: F.substring(token, i, n)))


def containing(texts: DataFrame, names: DataFrame, key: str, few: int = FEW) -> DataFrame:
    """(key, id, name) where the lower-case text holds the lower-case name as a substring.

    ``texts(key, id, text)`` with unique ids, ``names(key, name)`` distinct. The
    names of a key that has at most ``few`` of them travel to its texts as one
    short list, so a text is read a bounded number of times and is not cut into
    tokens. Keys with more names go by their vocabulary.
    """
    counts = saved(names.groupBy(key).agg(F.count("*").alias("names")), "counts")
    short = counts.where(F.col("names") <= few)
    total, over = counts.agg(F.sum(F.when(F.col("names") <= few, F.col("names"))), F.count_if(F.col("names") > few)).first()
    listed = names.join(short.select(key), key, "left_semi").groupBy(key).agg(F.collect_list("name").alias("names"))
    near = F.broadcast(listed) if (total or 0) <= BROADCAST_ROWS else listed.hint("shuffle_hash")
    held = texts.join(near, key).select(key, "id", "text", F.explode("names").alias("name")).where(F.contains("text", "name")).select(key, "id", "name")
    if not over:
        return held
    many = counts.where(F.col("names") > few).select(key)
    return held.unionByName(_by_vocabulary(texts.join(many, key, "left_semi"), names.join(many, key, "left_semi"), key))


def _by_vocabulary(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``containing`` for any number of names.

    A name's longest run of letters and digits must lie inside one token of the
    text, so names meet the key's vocabulary, not its texts: they are looked up
    by three characters (or fewer, if the run is shorter), and only tokens that
    hold such a piece are compared. A name that is one run is then found; only
    names with separators meet the text again, once per candidate. Names
    without any letter or digit are tested against the key's texts.
    """
    runs = tokens(F.col("name"))
    longest = F.aggregate(runs, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    named = names.select(key, "name", longest.alias("run"))
    bare = named.where("run = ''").select(key, "name")
    named = named.where("run <> ''").withColumn("n", F.least(F.length("run"), F.lit(_GRAM)))
    pieces = named.select(key, "run", "n", F.explode(_grams(F.col("run"), F.col("n"))).alias("piece")).distinct()
    common = pieces.groupBy(key, "piece").agg(F.count("*").alias("names"))
    rarest = pieces.join(common, [key, "piece"]).groupBy(key, "run", "n").agg(F.min(F.struct("names", "piece"))["piece"].alias("piece"))
    words = texts.select(key, "id", F.explode(tokens(F.col("text"))).alias("token"))
    sizes = rarest.select(key, "n").distinct()  # three at most in a key
    vocabulary = words.select(key, "token").distinct().join(sizes, key).where(F.length("token") >= F.col("n"))
    held = vocabulary.select(key, "token", F.explode(_grams(F.col("token"), F.col("n"))).alias("piece"))
    holders = saved(held.join(rarest, [key, "piece"]).where(F.contains("token", "run")).select(key, "token", "run").distinct(), "holders")
    # tokens that hold no name in any key are not shuffled with their texts
    holding = holders.select("token").distinct()
    near = words.join(F.broadcast(holding) if holding.count() <= BROADCAST_ROWS else holding, "token", "left_semi")
    found = near.join(holders, [key, "token"]).select(key, "id", "run").distinct()
    pairs = saved(found.join(named.select(key, "name", "run"), [key, "run"]), "pairs")  # read twice, below
    whole = pairs.where("name = run").select(key, "id", "name")
    parted = pairs.where("name <> run").select(key, "id", "name").join(texts, [key, "id"]).where(F.contains("text", "name")).select(key, "id", "name")
    signs = texts.join(bare, key).where(F.contains("text", "name")).select(key, "id", "name")
    return whole.unionByName(parted).unionByName(signs)
