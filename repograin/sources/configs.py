"""Rule configuration: JSON rule sets as rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PATTERN = "array<struct<type:string,patterns:array<string>,confidence_weight:double>>"
RULE_SCHEMA = f"id string, name string, description string, keywords array<string>, indicators {_PATTERN}, patterns {_PATTERN}"


def rule_rows(documents: DataFrame) -> DataFrame:
    """(id, name, kind, pattern, weight) of JSON rule documents in a ``value`` column."""
    d = F.from_json("value", RULE_SCHEMA)
    both = F.concat(F.coalesce(d["indicators"], F.array().cast(_PATTERN)), F.coalesce(d["patterns"], F.array().cast(_PATTERN)))
    return (
        documents.select(d["id"].alias("id"), d["name"].alias("name"), F.explode(both).alias("p"))
        .select("id", "name", F.col("p.type").alias("kind"), F.col("p.confidence_weight").alias("weight"), F.explode("p.patterns").alias("pattern"))
    )


def load_rules(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Rule rows of a configuration file whose ``root`` field lists the rule sets."""
    text = spark.read.option("wholetext", "true").text(path)
    items = F.from_json("value", f"struct<{root}:array<{'struct<' + ','.join(x.strip().replace(' ', ':', 1) for x in _split(RULE_SCHEMA)) + '>'}>>")
    return rule_rows(text.select(F.explode(items[root]).alias("x")).select(F.to_json("x").alias("value")))


def _split(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(schema[start:i])
            start = i + 1
    return out + [schema[start:]]
