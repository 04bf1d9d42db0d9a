"""How filters of documents interact, whatever their order.

Each filter is a relation: a table of the ids that fail it, written once. What
an order removes at a step depends only on the set of filters before it, so a
removal is the filter's relation left-anti each relation of that set. All
removals are one table of (filter, prefix, id) that starts with empty prefixes;
for each filter in turn, its rows left-anti that filter's ids are added with the
prefix longer by it, so a few joins hold all prefixes. Labels that go with an id
come by left-semi joins. Only counts by part, filter and prefix leave the ids: a
part's 5 * 16 removals hold all of its 120 orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from repograin.llm.store import WHITE, new_folder, saved

MIN_WORDS = 200
MIN_DISTINCT = 50  # in 100 words
MAX_CAPITALS = 3  # in 100 code points
SIGNS = r"[#$%&*|]"
COPIES = "E"


def row_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that look at one text; ``words`` is made once by :func:`measured`."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    words, distinct = F.col("words"), F.col("distinct_words")
    return {
        "A": words < MIN_WORDS,
        "B": distinct * 100 < words * MIN_DISTINCT,
        "C": capitals * 100 > F.length(text) * MAX_CAPITALS,
        "D": text.rlike(SIGNS),
    }


def measured(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """One narrow row per document: ``row, key, part, sha`` and whether it fails each of the row filters; saved."""
    base = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", WHITE), "")
    counted = base.withColumn("list", words).select("key", "part", "text", F.size("list").alias("words"), F.size(F.array_distinct("list")).alias("distinct_words"))
    tested = counted.select("key", "part", F.unhex(F.sha2("text", 256)).alias("sha"), *[c.alias(n) for n, c in row_filters(F.col("text")).items()])
    return saved(tested.withColumn("row", F.monotonically_increasing_id()), "measured")


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows whose text a smaller key has; null keys are neither smaller nor larger."""
    keyed = rows.where(F.col("key").isNotNull())
    firsts = keyed.groupBy("sha").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("sha", "first")
    return keyed.join(saved(firsts, "firsts"), "sha").where(F.col("key") > F.col("first"))  # saved, so that Spark can split a hot text


def labelled(rows: DataFrame, labels: DataFrame, key: str, test: Column) -> DataFrame:
    """Ids of the rows that any label calls so."""
    said = labels.where(test).select(F.col(f"`{key}`").alias("key"))
    return rows.select("row", "key").join(said, "key", "left_semi").select("row")


def relations(rows: DataFrame, good: DataFrame, toxic: DataFrame) -> DataFrame:
    """``row, part, good, toxic, filter``: the rows that fail each filter, in one folder by filter."""
    ids = later_copies(rows).select("row", "part", F.lit(COPIES).alias("filter"))
    for name in "ABCD":
        ids = ids.unionByName(rows.where(name).select("row", "part", F.lit(name).alias("filter")))
    marked = ids.join(good.withColumn("good", F.lit(1)), "row", "left").join(toxic.withColumn("toxic", F.lit(1)), "row", "left")
    marked = marked.select("row", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "filter")
    path = new_folder(rows.sparkSession, "fails")
    marked.write.partitionBy("filter").parquet(path)
    return rows.sparkSession.read.schema(marked.schema).parquet(path)


def removals(failing: DataFrame, names: str) -> DataFrame:
    """``part, filter, prefix`` (sorted, as ``AD``) and the rows, good rows and toxic rows removed there; saved."""
    gone = failing.withColumn("prefix", F.lit(""))
    for place, name in enumerate(names, 1):
        ids = failing.where(F.col("filter") == name).select("row")
        survived = gone.where(F.col("filter") != name).join(ids, "row", "left_anti")
        gone = gone.unionByName(survived.withColumn("prefix", F.concat("prefix", F.lit(name))))
        if place % 2 == 0:
            gone = saved(gone, "removed")  # each step reads the rows twice
    return saved(gone.groupBy("part", "filter", "prefix").agg(F.count("*").alias("removed"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")), "removals")


def orders(totals: DataFrame, removed: DataFrame, names: str) -> DataFrame:
    """Every part, order and step with its counts; a part holds at most 80 removals, so they travel as one map."""
    maps = removed.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "filter", "prefix"), F.struct("removed", "good", "toxic")))).alias("at"))
    order = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(names)])).alias("filter_order")
    steps = totals.join(maps, "part", "left").select("part", "total", "at", order).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    own = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.array_join(F.array_sort(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), "")), "")
    rest = F.array_join(F.array_sort(F.split(F.replace(F.col("filter_order"), own, F.lit("")), "")), "")

    def at(step: Column, field: str) -> Column:
        return F.coalesce(F.col("at")[step][field], F.lit(0)).cast("long")

    here = F.concat(own, F.lit(":"), before)
    alone = F.concat(own, F.lit(":"))
    steps = steps.select(
        "part", "total", "filter_order", "step", own.alias("own"), at(here, "removed").alias("removed"),
        (at(alone, "removed") - at(here, "removed")).alias("redundant"), at(F.concat(alone, rest), "removed").alias("unique_fails"),
        at(here, "good").alias("good_lost"), at(here, "toxic").alias("toxic_lost"))
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")  # five rows
    same_filter = Window.partitionBy("part", "own")  # 120 rows
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", F.sum("removed").over(same_filter).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", good: str = "quality = 1", toxic: str = "toxic = 1") -> DataFrame:
    """``part, filter_order, step`` and the counts of all 120 orders of the filters A to E.

    Each row of ``docs`` counts as a document, repeated ones too; a null text is
    empty, and a null part the empty string. A copy fails E if a smaller key has
    its text; a null key is no copy, makes none, and has no label. A document is
    good, or toxic, if any row of ``labels`` says so; null labels say nothing.
    An empty table gives no rows. Other columns are not read.
    """
    rows = measured(docs, key, text, part)
    names = "ABCD" + COPIES
    failing = relations(rows, labelled(rows, labels, key, F.expr(good)), labelled(rows, labels, key, F.expr(toxic)))
    return orders(saved(rows.groupBy("part").agg(F.count("*").alias("total")), "totals"), removals(failing, names), names)
