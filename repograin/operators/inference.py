"""Completeness inference: entities, their CRUD operations, analyzer scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions import offsets
from repograin.functions.containment import containing
from repograin.functions.needles import folded, quick_match
from repograin.functions.offsets import match_lengths
from repograin.functions.scores import r6
from repograin.functions.text import contains_any, file_name, let, rx
from repograin.registry import operator
from repograin.rules import reality as R

NEAR = 200  # characters on both sides of an operation
BIN = 512


def _visible(path: Column) -> Column:
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in R.CRUD_SKIPPED]))


def source_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext").isin(R.CRUD_EXTENSIONS) & _visible(F.col("path")))


def entity_files(files: DataFrame) -> DataFrame:
    named = contains_any(F.lower(file_name(F.col("path"))), R.ENTITY_NAMES)
    placed = contains_any(F.concat(F.lit("/"), "path"), R.ENTITY_DIRECTORIES)
    return source_files(files).where(named | placed)


@operator("inference.entities")
def entities(files: DataFrame) -> DataFrame:
    """One row per entity-pattern match, with the fields of its class or interface body."""
    content = F.col("content")

    def of_pattern(k: int, p: str) -> Column:
        found = F.regexp_extract_all(content, F.lit(rx(p)), F.lit(1))
        return F.transform(found, lambda n, i: F.struct(F.lit(k).alias("pattern_no"), i.alias("seq"), n.alias("name")))

    found = F.flatten(F.array(*[of_pattern(k, p) for k, p in enumerate(R.ENTITY_PATTERNS)]))
    fields = [
        F.regexp_extract_all(
            F.call_function("regexp_extract", content, F.concat(F.lit(rf"(?i){kw}\s+"), "name", F.lit(r"\s*\{([^}]+)\}")), F.lit(1)),
            F.lit(r"(?U)(\w+)\s*:\s*\w+"), F.lit(1),
        )
        for kw in ("class", "interface")
    ]
    return (
        entity_files(files).select("repo", "path", "content", F.explode(found).alias("e")).select("repo", "path", "content", "e.*")
        .select("repo", "path", "pattern_no", "seq", "name", F.concat(*fields).alias("fields"), F.lit(0.8).alias("confidence"))
    )


@operator("inference.surroundings")
def surroundings(files: DataFrame) -> DataFrame:
    """Per source file with an operation: its matches by pattern and the words near them; texts stay in the scan."""
    content = F.col("content")

    def measured(low: Column) -> Column:
        hits = [
            F.when(quick_match(content, low, p), F.struct(F.lit(op).alias("operation"), F.lit(i).alias("pattern_no"), match_lengths(content, rx(p)).alias("lengths")))
            for op, patterns in R.CRUD
            for i, p in enumerate(patterns)
        ]
        return F.filter(F.array_compact(F.array(*hits)), lambda h: F.size(h["lengths"]["sizes"]) > 0)

    return offsets.surroundings(source_files(files), F.lower("content"), let(folded(content), measured), NEAR)


@operator("inference.operation_matches")
def operation_matches(around: DataFrame) -> DataFrame:
    """Every match of every operation pattern: ``repo, path, operation, pattern_no, seq, start, size``."""
    each = around.select("repo", "path", F.explode(F.arrays_zip("hits", "starts")).alias("h"))
    placed = F.posexplode(F.arrays_zip(F.col("h.starts").alias("start"), F.col("h.hits.lengths.sizes").alias("size"))).alias("seq", "m")
    return each.select("repo", "path", "h.hits.operation", "h.hits.pattern_no", placed).select("repo", "path", "operation", "pattern_no", "seq", "m.start", "m.size")


def layer(path: Column) -> Column:
    out = None
    for name, ws in R.LAYERS:
        out = F.when(contains_any(path, ws), name) if out is None else out.when(contains_any(path, ws), name)
    return out


@operator("inference.occurrences")
def occurrences(around: DataFrame, names: DataFrame) -> DataFrame:
    """``repo, path, name, first, last``: where the names (lower case, of word characters) stand near operations.

    Words meet the names as a vocabulary, each distinct word of a repository
    once; a name lies inside one word.
    """
    words = around.select("repo", "path", F.explode("words").alias("w")).select("repo", "path", "w.word", "w.start")
    vocabulary = words.select("repo", F.col("word").alias("id"), F.col("word").alias("text")).distinct()
    holders = containing(vocabulary, names, "repo").select("repo", F.col("id").alias("word"), "name")
    inside = F.filter(F.sequence(F.lit(1), F.length("word") - F.length("name") + 1), lambda i: F.substring(F.col("word"), i, F.length("name")) == F.col("name"))
    placed = holders.select("repo", "word", "name", F.explode(inside).alias("at"))
    first = F.col("start") + F.col("at") - 1
    return words.join(placed, ["repo", "word"]).select("repo", "path", "name", first.alias("first"), (first + F.length("name") - 1).alias("last"))


@operator("inference.crud_hits")
def crud_hits(ents: DataFrame, around: DataFrame) -> DataFrame:
    """Matches with an entity's name within ``NEAR`` characters: (repo, name, operation, hits, layers).

    An interval join: each match opens an interval that covers two or three
    bins, each occurrence of a name falls into one, and both meet by file and
    bin, so a file with very many matches spreads over tasks.
    """
    names = ents.select("repo", F.lower("name").alias("name")).distinct()
    bin_of = lambda place: F.floor(place / BIN)
    low, high = F.greatest(F.col("start") - NEAR, F.lit(1)), F.col("start") + F.col("size") + NEAR - 1
    matches = operation_matches(around).select("repo", "path", "operation", "pattern_no", "seq", low.alias("low"), high.alias("high"))
    opened = matches.withColumn("bin", F.explode(F.sequence(bin_of(F.col("low")), bin_of(F.col("high")))))
    standing = occurrences(around, names).withColumn("bin", bin_of(F.col("first")))
    met = opened.join(standing, ["repo", "path", "bin"]).where("first >= low AND last <= high")
    found = met.select("repo", "name", "operation", "path", "pattern_no", "seq").distinct()
    return found.groupBy("repo", "name", "operation").agg(
        F.count("*").alias("hits"), F.array_sort(F.collect_set(layer(F.col("path")))).alias("layers")
    ).withColumn("confidence", F.least(F.col("hits") * 20, F.lit(100)) / 100.0)


@operator("inference.crud_completeness")
def crud_completeness(ents: DataFrame, hits: DataFrame) -> DataFrame:
    """Operations found and missing per entity; complete only with all four."""
    ops = [op for op, _ in R.CRUD]
    done = hits.groupBy("repo", "name").agg(*[F.bool_or(F.col("operation") == op).alias(op) for op in ops])
    have = F.array_compact(F.array(*[F.when(F.col(op), F.lit(op)) for op in ops]))
    lack = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(op), F.lit(False)), F.lit(op)) for op in ops]))
    return (
        ents.withColumn("key", F.lower("name")).join(done.withColumnRenamed("name", "key"), ["repo", "key"], "left")
        .select("repo", "path", "pattern_no", "seq", "name", "confidence", have.alias("implemented"), lack.alias("missing"))
        .withColumn("completeness", F.size("implemented") / 4)
        .withColumn("verdict", F.when(F.size("missing") == 0, "complete").when(F.col("completeness") < 0.5, "missing").otherwise("partial"))
    )


@operator("inference.contributions")
def contributions(repos: DataFrame, ents: DataFrame, todo_confidence: DataFrame) -> DataFrame:
    """Weighted analyzer confidences per repository and the mean with the marker confidence."""
    crud = ents.select("repo").distinct().withColumn("has_entities", F.lit(True))
    parts = [F.when(F.col("has_entities"), F.lit(80 * R.ANALYZER_WEIGHTS["CRUD Analyzer"]))]
    parts += [F.lit(50 * w) for n, w in R.ANALYZER_WEIGHTS.items() if n != "CRUD Analyzer"]
    scores = F.array_compact(F.array(*parts))
    overall = F.aggregate(scores, F.lit(0), lambda a, x: a + x) / F.size(scores) / 10000.0
    return repos.join(crud, "repo", "left").withColumn("inference_confidence", overall).join(todo_confidence.select("repo", "confidence"), "repo", "left").select(
        "repo", F.size(scores).alias("analyzers"), r6(F.col("inference_confidence")).alias("inference_confidence"),
        r6((F.col("confidence") + F.col("inference_confidence")) / 2).alias("total_confidence"),
    )


