"""Batch scoring of segments with a pluggable scorer, and reply parsing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from repograin.functions.ranking import running_total
from repograin.functions.scores import r6
from repograin.functions.text import first_label, lookup
from repograin.registry import operator

# Window sizes, limits, keyword fallback, field defaults.
WINDOW, TEMPLATE_TOKENS, REPLY_TOKENS = 4096, 500, 1000
BUDGET = WINDOW - TEMPLATE_TOKENS - REPLY_TOKENS  # tokens of a batch's items
TOKEN_CHARS = 4
ITEM_TOKENS = 8  # what an item's label takes
PARTS = [("endpoint", "API endpoints"), ("dependency", "Dependencies"), ("file", "Files"), ("segment", "Segments")]
DOMAIN_KEYWORDS = [
    ("Authentication", ["authentication"]),
    ("Authentication", ["auth"]),
    ("User Management", ["user"]),
    ("Notification", ["notification"]),
    ("Payment", ["payment"]),
    ("Analytics", ["analytics"]),
    ("E-commerce", ["e-commerce"]),
    ("E-commerce", ["ecommerce"]),
]
FALLBACK_CONFIDENCE = 0.5
DEFAULTS = {"project_type_confidence": 0.5, "domain_confidence": 0.5, "overall_confidence": 0.5, "context_coverage": 0.8, "classification_certainty": 0.6, "analysis_completeness": 0.7}
TEMPLATE = "Analyse the following segments.\n{segments}\nReply with JSON."

_DOMAINS = "map<string,struct<segment_ids:array<string>,confidence:double,evidence:array<string>>>"
REPLY_SCHEMA = (
    f"functional_requirements struct<domains:{_DOMAINS}>, non_functional_requirements struct<domains:{_DOMAINS}>, "
    "segments array<struct<primary_domain:string,confidence:double,evidence:array<string>>>"
)
PROJECT_SCHEMA = (
    "project_classification struct<inferred_project_type:string,project_type_confidence:double>, "
    "business_domain_analysis struct<primary_domain:string,domain_confidence:double,feature_analysis:array<struct<feature_name:string,implementation_status:string,confidence:double>>>, "
    "confidence_metrics struct<overall_confidence:double,context_coverage:double,classification_certainty:double,analysis_completeness:double>"
)


def part_chars(budget: int) -> int:
    """Characters of an item's part: with its label it fills at most a quarter of a batch."""
    return (budget // 4 - ITEM_TOKENS) * TOKEN_CHARS


@operator("scoring.batches")
def batches(items: DataFrame, key: str, order: list[str], budget: int = BUDGET) -> DataFrame:
    """Add ``part, tokens, batch, slot``: items in their order, no batch over the token budget.

    Longer texts are cut into parts, each a row of its own, so none is shortened.
    A batch takes the parts that start within three quarters of the budget; the
    last of them adds a quarter at most. Tokens are summed over ranges, so a key
    of any size spreads over many tasks. ``order`` must be unique within a key.
    """
    chars = part_chars(budget)
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.ceil(F.length(text) / chars), F.lit(1)).cast("int")
    cut = items.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("text", F.substring(text, F.col("part") * chars + 1, F.lit(chars)))
    sized = cut.withColumn("tokens", F.ceil(F.length("text") / TOKEN_CHARS) + ITEM_TOKENS)
    placed = running_total(sized, [key], [*order, "part"], "tokens", "before").withColumn("batch", F.floor(F.col("before") / (budget - budget // 4)))
    in_batch = Window.partitionBy(key, "batch").orderBy("before")  # no more than the budget holds
    return placed.withColumn("slot", F.row_number().over(in_batch).cast("long") - 1).drop("before")


@operator("scoring.project_items")
def project_items(items: DataFrame, segments: DataFrame) -> DataFrame:
    """``repo, place, kind, text``: endpoints, dependencies, files and segments of a repository, each once, in prompt order."""
    own = items.select("repo", "kind", F.col("item").alias("text")).unionByName(segments.select("repo", F.lit("segment").alias("kind"), F.concat_ws(" ", "segment_type", "name").alias("text")))
    place = F.array_position(F.array(*[F.lit(k) for k, _ in PARTS]), F.col("kind"))
    return own.where("text IS NOT NULL AND text <> ''").distinct().select("repo", place.cast("int").alias("place"), "kind", "text", F.col("text").alias("name"))


@operator("scoring.project_prompts")
def project_prompts(batched: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One prompt per repository and batch, its items under their kinds' headings."""
    heading = {k: h for k, h in PARTS}
    rows = F.array_sort(F.collect_list(F.struct("slot", "kind", "text")))
    line = F.transform(rows, lambda r, i: F.concat(
        F.when((i > 0) & (F.get(rows, i - 1)["kind"] == r["kind"]), "").otherwise(F.concat(lookup(r["kind"], heading), F.lit(":\n"))), F.lit("- "), r["text"]))
    return batched.groupBy("repo", "batch").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.array_join(line, "\n").alias("body")).select(
        "repo", "batch", "items", "tokens", F.replace(F.lit(template), F.lit("{segments}"), F.col("body")).alias("prompt"))


@operator("scoring.prompts")
def prompts(batched: DataFrame, key: str, template: str = TEMPLATE) -> DataFrame:
    """One prompt per batch, of the batch's parts in order."""
    parts = F.array_sort(F.collect_list(F.struct("slot", "text")))
    body = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("Segment "), (p["slot"] + 1).cast("string"), F.lit(": "), p["text"])), "\n")
    return batched.groupBy(key, "batch").agg(F.count("*").alias("segments"), body.alias("body")).select(
        key, "batch", "segments", F.replace(F.lit(template), F.lit("{segments}"), F.col("body")).alias("prompt")
    )


def keyword_scorer(texts: list[str]) -> list[str]:
    """Offline scorer: a JSON reply naming the first keyword's domain."""
    out = []
    for text in texts:
        low = text.lower()
        domain = next((d for d, ws in DOMAIN_KEYWORDS if any(w in low for w in ws)), None)
        out.append(json.dumps({"segments": [{"primary_domain": domain, "confidence": 0.7 if domain else 0.0, "evidence": []}]}, separators=(",", ":")))
    return out


@operator("scoring.score")
def score(prompt: DataFrame, key: str, scorer: Callable[[list[str]], list[str]] = keyword_scorer, retries: int = 2) -> DataFrame:
    """One reply per batch, and the error's text for a batch that keeps failing; the rest go on.

    A chunk's prompts go to the scorer in one call. If the call fails, each
    prompt is tried alone, ``retries`` times more than once.
    """

    def alone(text: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(retries + 1):
            try:
                return scorer([text])[0], None
            except Exception as failed:  # the service's errors are its own; the last one is reported
                error = f"{type(failed).__name__}: {failed}"
        return None, error

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks:
            texts = list(pdf["prompt"])
            try:
                found = [(reply, None) for reply in scorer(texts)]
                if len(found) != len(texts):
                    raise ValueError("not one reply per prompt")
            except Exception:  # tried again one by one
                found = [alone(text) for text in texts]
            yield pd.DataFrame({key: pdf[key], "batch": pdf["batch"], "reply": [r for r, _ in found], "error": [e for _, e in found]})

    kind = dict(prompt.dtypes)[key]
    return prompt.select(key, "batch", "prompt").mapInPandas(run, schema=f"{key} {kind}, batch bigint, reply string, error string")


def json_part(reply: Column) -> Column:
    """The reply if it is JSON, else its outermost braces if they mention the expected keys."""
    text = F.trim(reply)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    expected = inner.contains('"project_analysis"') | inner.contains('"segments"')
    whole = F.get_json_object(text, "$").isNotNull() & text.startswith("{") & text.endswith("}")
    return F.when(whole, text).when(expected, inner)


@operator("scoring.parse")
def parse(replies: DataFrame) -> DataFrame:
    """First segment's domain from JSON, embedded JSON, or the keyword fallback."""
    body = json_part(F.col("reply"))
    first = F.try_element_at(F.from_json(body, REPLY_SCHEMA)["segments"], F.lit(1))
    return replies.select(
        "*", F.when(body.isNotNull(), "json").otherwise("text").alias("form"),
        F.when(body.isNotNull(), first["primary_domain"]).otherwise(keyword_domain(F.col("reply"))).alias("domain"),
        F.when(body.isNotNull(), F.coalesce(first["confidence"], F.lit(0.0))).otherwise(FALLBACK_CONFIDENCE).alias("confidence"),
        F.when(body.isNull(), F.col("reply")).alias("evidence"),
    )


def keyword_domain(text: Column) -> Column:
    return first_label(F.lower(text), DOMAIN_KEYWORDS, None)


@operator("scoring.requirements")
def requirements(replies: DataFrame) -> DataFrame:
    """One row per segment id of each functional and non-functional domain."""
    d = F.from_json("reply", REPLY_SCHEMA)
    out = None
    for field, label in (("functional_requirements", "Functional"), ("non_functional_requirements", "Non-Functional")):
        rows = replies.select("id", F.explode(d[field]["domains"]).alias("name", "data")).select(
            "id", F.explode("data.segment_ids").alias("segment_id"), F.concat(F.col("name"), F.lit(f" ({label})")).alias("domain"), F.coalesce("data.confidence", F.lit(0.0)).alias("confidence"))
        out = rows if out is None else out.unionByName(rows)
    return out


@operator("scoring.summary")
def summary(parsed: DataFrame, key: str) -> DataFrame:
    c = F.col("confidence")
    return parsed.groupBy(key).agg(
        F.count("*").alias("segments"), F.count("domain").alias("with_domain"), r6(F.coalesce(F.sum(F.when(c > 0, c)) / F.count_if(c > 0), F.lit(0.0))).alias("mean_confidence")
    )


@operator("scoring.project_reply")
def project_reply(replies: DataFrame) -> DataFrame:
    """Typed project reply with per-field defaults; one row per feature, or one without."""
    d = F.from_json(json_any(F.col("reply")), PROJECT_SCHEMA)
    bd, pc, cm = d["business_domain_analysis"], d["project_classification"], d["confidence_metrics"]
    default = lambda x, k: F.coalesce(x, F.lit(DEFAULTS[k]))
    return replies.select(
        "id", F.coalesce(F.lower(F.replace(pc["inferred_project_type"], F.lit(" "), F.lit("_"))), F.lit("unknown")).alias("project_type"), default(pc["project_type_confidence"], "project_type_confidence").alias("type_confidence"),
        F.coalesce(bd["primary_domain"], F.lit("Unknown")).alias("domain"), default(bd["domain_confidence"], "domain_confidence").alias("domain_confidence"), default(cm["context_coverage"], "context_coverage").alias("coverage"),
        default(cm["classification_certainty"], "classification_certainty").alias("certainty"), default(cm["analysis_completeness"], "analysis_completeness").alias("analysis"),
        F.explode_outer(bd["feature_analysis"]).alias("f"),
    ).select("*", "f.feature_name", "f.implementation_status").drop("f")


def json_any(reply: Column) -> Column:
    return F.regexp_extract(reply, r"(?s)(\{.*\})", 1)


@operator("scoring.context_domain")
def context_domain(replies: DataFrame) -> DataFrame:
    """First project domain the reply names, else the first hint, else the keyword fallback."""
    low = F.lower("reply")
    named = F.try_element_at(F.filter("domains", lambda d: F.contains(low, F.lower(d))), F.lit(1))
    return replies.select("id", F.coalesce(named, F.try_element_at("hints", F.lit(1)), keyword_domain(F.col("reply"))).alias("domain"))
