"""Claims that documentation makes, with confidence and priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions.facets import facet_counts
from repograin.functions.scores import r6
from repograin.functions.similarity import set_id, similar_ids
from repograin.functions.text import bare, first_label, hit_lines_with_context, lookup, rx, words
from repograin.registry import operator
from repograin.rules import documents as D
from repograin.session import saved

RULES = [(t, i, p) for t, ps in D.CLAIMS for i, p in enumerate(ps)]


ANY_CLAIM = "(?iU)(?:" + "|".join(bare(p) for _, _, p in RULES) + ")"
_PUNCT = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"


def keywords(text: Column) -> Column:
    """Words of the weight table, in text order, with repeats."""
    bare = F.transform(words(text), lambda w: F.regexp_replace(F.lower(w), f"^{_PUNCT}|{_PUNCT}$", ""))
    return F.filter(bare, lambda w: w.isin(list(D.KEYWORD_BONUS)))


def points(claim_type: Column, text: Column, keys: Column) -> Column:
    """Confidence in hundredths."""
    bonus = F.aggregate(F.transform(keys, lambda k: lookup(k, D.KEYWORD_BONUS, 0)), F.lit(0), lambda a, x: a + x)
    size = F.octet_length(text)
    score = (
        F.lit(D.CLAIM_BASE) + lookup(claim_type, D.CLAIM_TYPE_BONUS, D.CLAIM_OTHER_BONUS) + bonus
        - F.when(size < 10, 20).when(size > 200, 10).otherwise(0)
    )
    return F.least(F.greatest(score, F.lit(0)), F.lit(100))


def priority(claim_type: Column, context: Column) -> Column:
    low = F.lower(context)
    out = F
    for t, cases in D.CLAIM_PRIORITY_WORDS.items():
        out = out.when(claim_type == t, first_label(low, cases, D.CLAIM_PRIORITY[t]))
    return out.otherwise(lookup(claim_type, D.CLAIM_PRIORITY))


@operator("claims.extract")
def extract(docs: DataFrame) -> DataFrame:
    """One row per (line, pattern) hit; the description is the pattern's first group."""
    hit = F.explode(hit_lines_with_context(F.col("content"), ANY_CLAIM, 3, 3, own=True))
    line = F.col("line")
    found = F.array_compact(F.array(*[
        F.when(
            line.rlike(rx(p)),
            F.struct(F.lit(t).alias("claim_type"), F.lit(i).alias("pattern_no"), F.trim(F.regexp_extract(line, rx(p), 1)).alias("description")),
        )
        for t, i, p in RULES
    ]))
    out = (
        docs.select("repo", "path", hit.alias("h"))
        .select("repo", "path", "h.line_no", "h.line", F.trim(F.array_join("h.context", " ")).alias("context"))
        .select("repo", "path", "line_no", "context", F.explode(found).alias("c"))
        .select("repo", "path", "line_no", "context", "c.*")
        .withColumn("keywords", keywords(F.col("description")))
    )
    return out.select(
        "*",
        points(F.col("claim_type"), F.col("description"), F.col("keywords")).alias("points"),
        priority(F.col("claim_type"), F.col("context")).alias("priority"),
    )


@operator("claims.dedup")
def dedup(claims: DataFrame) -> DataFrame:
    """Drop a claim when a better one of its file and type is more than 0.8 alike.

    Equal word sets fall together in a map-side minimum; only distinct sets of
    one file meet in the similarity join.
    """
    keys = ["repo", "path", "claim_type"]
    order = F.struct((-F.col("points")).alias("neg"), "line_no", "pattern_no")
    sets = claims.withColumn("tokens", F.array_sort(F.array_distinct(words(F.col("description")))))
    best = saved(sets.withColumn("sid", set_id(F.col("tokens"))).groupBy(*keys, "sid").agg(  # equal ids, equal sets
        F.min(F.struct(order.alias("o"), *[F.col(c) for c in claims.columns if c not in keys])).alias("m"), F.first("tokens").alias("tokens")
    ))
    heads = best.select(*keys, "sid", F.col("m.o").alias("o"))
    l_heads, r_heads = (heads.withColumnsRenamed({"sid": f"{side}_sid", "o": f"{side}_o"}) for side in ("l", "r"))
    worse = (
        similar_ids(best.select(*keys, "sid", "tokens"), None, keys, 0.8)
        .join(l_heads, [*keys, "l_sid"]).join(r_heads, [*keys, "r_sid"])
        .select(*keys, F.when(F.col("r_o") < F.col("l_o"), F.col("l_sid")).otherwise(F.col("r_sid")).alias("sid"))
        .distinct()
    )
    return best.join(worse, [*keys, "sid"], "left_anti").select(*keys, "m.*").drop("o")


def claim_id() -> Column:
    """Identity of a claim inside its repository, stable under repartitioning."""
    return F.concat_ws(":", "path", F.lpad(F.col("line_no").cast("string"), 7, "0"), "claim_type", "pattern_no")


@operator("claims.final")
def final(docs: DataFrame) -> DataFrame:
    """Distinct claims that reach the confidence threshold, with identities."""
    return dedup(extract(docs)).where(F.col("points") >= D.CLAIM_THRESHOLD).withColumn("claim_id", claim_id())


@operator("claims.summary")
def summary(claims: DataFrame) -> DataFrame:
    facets = facet_counts(claims, "repo", {"type": "claim_type", "priority": "priority"})
    totals = claims.groupBy("repo").agg(
        F.count("*").alias("total_claims"),
        F.count_if(F.col("points") > 80).alias("high_confidence_claims"),
        F.count_if(F.col("claim_type").isin(D.VERIFIED_TYPES)).alias("verification_needed"),
        r6(F.sum("points") / F.count("*") / 100.0).alias("mean_confidence"),
    )
    return facets.join(totals, "repo")
