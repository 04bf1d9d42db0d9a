"""Cross-reference graph of modules and the quality of segment contexts.

A node is a module: a file stem inside a repository. Edges between modules
replace edges between all segments of the files, so a much-mentioned file adds
one edge per mentioning module, not one per pair of segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.functions.containment import containing
from repograin.functions.scores import r6
from repograin.functions.text import file_stem, first_label
from repograin.registry import operator
from repograin.rules import context as X


@operator("graph.mentions")
def mentions(segments: DataFrame) -> DataFrame:
    """(repo, segment_id, module, target): modules whose stem a segment's text holds."""
    texts = segments.select("repo", F.col("segment_id").alias("id"), F.lower("content").alias("text"))
    own = segments.select("repo", F.col("segment_id").alias("id"), F.lower(file_stem(F.col("path"))).alias("module"))
    names = own.select("repo", F.col("module").alias("name")).where("name <> ''").distinct()
    return (
        containing(texts, names, "repo").join(own, ["repo", "id"]).where("name <> module")
        .select("repo", F.col("id").alias("segment_id"), "module", F.col("name").alias("target"))
    )


@operator("graph.edges")
def edges(found: DataFrame, resolved: DataFrame, segments: DataFrame) -> DataFrame:
    """(repo, src, dst, ref_type, strength, refs): typed, directed module edges.

    An import's strength is the matched share of what it names, a mention's the
    share of the module's segments that mention the other; ``refs`` counts the
    import specifications, or the mentioning segments.
    """
    size = segments.groupBy("repo", F.lower(file_stem(F.col("path"))).alias("src")).agg(F.count("*").alias("n"))
    mentioned = found.groupBy("repo", F.col("module").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("refs")).join(size, ["repo", "src"])
    stem = lambda path: F.lower(file_stem(F.col(path)))
    ends = resolved.where("target IS NOT NULL").select("repo", stem("path").alias("src"), stem("target").alias("dst"), (F.col("path") == F.col("target")).alias("own"), "strength")
    imported = ends.where((F.col("src") != F.col("dst")) | F.col("own")).groupBy("repo", "src", "dst").agg(F.max("strength").alias("strength"), F.count("*").alias("refs"))
    return imported.select("repo", "src", "dst", F.lit("import").alias("ref_type"), "strength", "refs").unionByName(
        mentioned.select("repo", "src", "dst", F.lit("mention").alias("ref_type"), r6(F.col("refs") / F.col("n")).alias("strength"), "refs"))


@operator("graph.related")
def related(edge: DataFrame) -> DataFrame:
    """Neighbours in either direction, as rows."""
    back = edge.select("repo", F.col("dst").alias("module"), F.col("src").alias("related"))
    return edge.select("repo", F.col("src").alias("module"), F.col("dst").alias("related")).unionByName(back).distinct()


@operator("graph.imports")
def import_edges(components: DataFrame) -> DataFrame:
    """Functional edges: a module and the last part of each import."""
    last = F.lower(F.element_at(F.split("i", r"[/.]"), -1))
    return (
        components.select("repo", F.lower("name").alias("src"), F.explode("imports").alias("i")).select("repo", "src", last.alias("dst")).where("dst <> ''").distinct()
    )


@operator("graph.missing")
def missing(resolved: DataFrame) -> DataFrame:
    """Imports that lead to no file of the repository: (repo, src, spec)."""
    return resolved.where("target IS NULL").select("repo", F.lower(file_stem(F.col("path"))).alias("src"), "spec").distinct()


@operator("graph.orphans")
def orphans(segments: DataFrame, found: DataFrame, resolved: DataFrame) -> DataFrame:
    """Segments that mention no other module and whose file imports none of its repository."""
    importing = resolved.where("target IS NOT NULL").select("repo", "path").distinct()
    quiet = segments.select("repo", "path", "segment_id").join(found.select("repo", "segment_id").distinct(), ["repo", "segment_id"], "left_anti")
    return quiet.join(importing, ["repo", "path"], "left_anti").select("repo", "segment_id")


@operator("graph.short_cycles")
def short_cycles(edge: DataFrame) -> DataFrame:
    """Mutual pairs and directed triangles, each once from its smallest name.

    A triangle is found at its corner of lowest degree, so a hub is never the
    centre of a join and the paths looked at stay within E·√E.
    """
    e = edge.select("repo", "src", "dst")
    ends = e.select("repo", F.col("src").alias("v")).unionByName(e.select("repo", F.col("dst").alias("v")))
    degree = ends.groupBy("repo", "v").agg(F.count("*").alias("d"))
    rank = lambda name: degree.select("repo", F.col("v").alias(name), F.struct("d", "v").alias(f"{name}_r"))
    ranked = e.join(rank("src"), ["repo", "src"]).join(rank("dst"), ["repo", "dst"])
    pairs = e.join(e.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst")), ["repo", "src", "dst"]).where("src < dst")
    two = pairs.select("repo", F.lit(2).alias("length"), F.concat_ws(">", "src", "dst").alias("cycle"))
    out = ranked.where("src_r < dst_r").select("repo", F.col("src").alias("v"), F.col("dst").alias("y"))
    into = ranked.where("dst_r < src_r").select("repo", F.col("dst").alias("v"), F.col("src").alias("x"))
    wedge = out.join(into, ["repo", "v"]).where("x <> y")
    three = wedge.join(e.select("repo", F.col("src").alias("y"), F.col("dst").alias("x")), ["repo", "y", "x"])
    rotate = F.when((F.col("v") < F.col("y")) & (F.col("v") < F.col("x")), F.concat_ws(">", "v", "y", "x")).when(
        (F.col("y") < F.col("v")) & (F.col("y") < F.col("x")), F.concat_ws(">", "y", "x", "v")).otherwise(F.concat_ws(">", "x", "v", "y"))
    return two.unionByName(three.select("repo", F.lit(3).alias("length"), rotate.alias("cycle")))


@operator("graph.consistency")
def consistency(repos: DataFrame, functional: DataFrame, components: DataFrame) -> DataFrame:
    known = components.select("repo", F.lower("name").alias("dst")).distinct().withColumn("ok", F.lit(1))
    agg = functional.join(known, ["repo", "dst"], "left").groupBy("repo").agg(F.count("*").alias("total"), F.count("ok").alias("valid"))
    return repos.join(agg, "repo", "left").select(
        "repo", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("valid", F.lit(0)).alias("valid"),
        r6(F.coalesce(F.col("valid") / F.col("total"), F.lit(1.0))).alias("consistency"),
    )


@operator("graph.contexts")
def contexts(segments: DataFrame, found: DataFrame) -> DataFrame:
    """Per segment: outgoing and incoming module counts, purpose, confidence in hundredths."""
    out = found.groupBy("repo", "segment_id").agg(F.count("*").alias("deps"))
    inc = found.select("repo", F.col("target").alias("module"), F.col("module").alias("by")).distinct().groupBy("repo", "module").agg(F.count("*").alias("dependents"))
    base = segments.withColumn("module", F.lower(file_stem(F.col("path")))).withColumn("purpose", first_label(F.lower("content"), X.PURPOSES, None))
    return base.drop("content", "header", "pattern_hits").join(out, ["repo", "segment_id"], "left").join(inc, ["repo", "module"], "left").fillna(0, ["deps", "dependents"]).withColumn(
        "points", F.lit(X.SEGMENT_CONFIDENCE)
    )


def depth(deps, dependents, purpose):
    return deps + dependents + F.when(purpose.isNotNull(), 1).otherwise(0)


@operator("graph.recalibrate")
def recalibrate(ctx: DataFrame) -> DataFrame:
    """+.1 with a purpose, +.05 per reference up to .2; kept only if it moves by more than .1."""
    new = F.least(F.col("points") + F.when(F.col("purpose").isNotNull(), 10).otherwise(0) + F.least((F.col("deps") + F.col("dependents")) * 5, F.lit(20)), F.lit(100))
    return ctx.withColumn("adjusted", F.when(F.abs(new - F.col("points")) > 10, new).otherwise(F.col("points")))


@operator("graph.coverage")
def coverage(repos: DataFrame, ctx: DataFrame, files: DataFrame) -> DataFrame:
    n = ctx.groupBy("repo").agg(F.count("*").alias("segments"), F.count_distinct("path").alias("paths"))
    return repos.join(n, "repo", "left").fillna(0).select(
        "repo", "segments", "paths", r6(F.when(F.col("paths") == 0, 0.0).otherwise(F.least(F.col("segments") / F.col("paths") / 5, F.lit(1.0)))).alias("coverage")
    )


@operator("graph.distribution")
def distribution(ctx: DataFrame, column: str = "points") -> DataFrame:
    p = F.col(column)
    return ctx.groupBy("repo").agg(
        F.count_if(p > 80).alias("high"), F.count_if((p >= 50) & (p <= 80)).alias("medium"), F.count_if(p < 50).alias("low"), r6(F.sum(p) / F.count("*") / 100.0).alias("mean_confidence")
    )


@operator("graph.depth")
def depth_metrics(ctx: DataFrame) -> DataFrame:
    d = depth(F.col("deps"), F.col("dependents"), F.col("purpose"))
    return ctx.groupBy("repo").agg(F.count_if(d <= 1).alias("shallow"), F.count_if((d > 1) & (d <= 3)).alias("medium"), F.count_if(d > 3).alias("deep"), r6(F.sum(d) / F.count("*")).alias("mean_depth"))


@operator("graph.edge_cases")
def edge_cases(repos: DataFrame, files: DataFrame, large: int = X.LARGE_PROJECT) -> DataFrame:
    """Empty, single-file and very large projects, with what to do."""
    n = files.where(F.col("lang").isNotNull()).groupBy("repo").agg(F.count("*").alias("n"))
    k = F.coalesce("n", F.lit(0))
    kind = F.when(k == 0, "EmptyProject").when(k == 1, "SingleFileProject").when(k > large, "LargeProject").otherwise("Regular")
    advice = F.when(k == 0, "Analysis will be limited to project structure only").when(k == 1, "Cross-reference analysis will be simplified").when(
        k > large, "Batch processing and memory optimization will be applied").otherwise("None")
    return repos.join(n, "repo", "left").select("repo", k.alias("source_files"), kind.alias("kind"), advice.alias("recommendation"))


@operator("graph.quality")
def quality(ctx: DataFrame) -> DataFrame:
    """Completeness and mean confidence before and after purposes and recalibration."""
    after = recalibrate(ctx)
    rows = after.groupBy("repo").agg(
        F.count("*").alias("segments"), F.lit(0).cast("bigint").alias("purpose_before"), F.count("purpose").alias("purpose_after"), F.sum("points").alias("before"), F.sum("adjusted").alias("after")
    )
    stage = lambda name, p, pts: F.struct(F.lit(name).alias("stage"), r6(F.col(p) / F.col("segments")).alias("completeness"), r6(F.col(pts) / F.col("segments") / 100.0).alias("mean_confidence"))
    return rows.select("repo", F.explode(F.array(stage("before", "purpose_before", "before"), stage("after", "purpose_after", "after"))).alias("s")).select("repo", "s.*")
