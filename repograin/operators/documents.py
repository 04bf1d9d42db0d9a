"""Documentation: sections, technologies, commands, coverage, several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions.needles import folded, quick_match
from repograin.functions.scores import r6
from repograin.functions.text import bare as bare_pattern, contains_any, first_label, let, lines, lookup, squeeze
from repograin.registry import operator
from repograin.rules import documents as D


def number_lines(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", F.posexplode(lines(F.col("content"))).alias("pos", "line")).select(
        "repo", "path", (F.col("pos") + 1).alias("line_no"), "line"
    )


@operator("documents.sections")
def sections(docs: DataFrame) -> DataFrame:
    """Recognised sections with their bodies, numbered by file.

    A body ends before the next recognised header, or with the first other
    header line, which it still includes. Everything happens in the file's row,
    in time linear in its lines: header lines know the next one by its place,
    and only section rows leave, so no line is shuffled and a file may have any
    size.
    """

    def heading(line: Column) -> Column:
        head = None
        for name, pattern in D.SECTIONS:
            test = line.rlike(pattern)
            head = F.when(test, name) if head is None else head.when(test, name)
        return head

    def of_lines(ls: Column) -> Column:
        seen = F.transform(ls, lambda l, i: F.struct((i + 1).alias("line_no"), heading(l).alias("section"), l.startswith("#").alias("sharp")))
        return let(F.filter(seen, lambda s: s["section"].isNotNull() | s["sharp"]), lambda hs: cut(ls, hs))

    def cut(ls: Column, hs: Column) -> Column:
        spans = F.transform(hs, lambda h, i: F.struct(h["section"].alias("section"), h["line_no"].alias("line_no"), F.get(hs, i + 1).alias("next")))

        def body(s: Column, i: Column) -> Column:
            end = F.when(s["next"].isNull(), F.size(ls)).when(s["next"]["section"].isNotNull(), s["next"]["line_no"] - 1).otherwise(s["next"]["line_no"])
            text = F.array_join(F.slice(ls, s["line_no"] + 1, end - s["line_no"]), "\n")
            return F.struct((i + 1).cast("long").alias("ord"), s["section"].alias("section"), F.regexp_replace(text, r"^\s+|\s+\z", "").alias("body"))

        return F.transform(F.filter(spans, lambda s: s["section"].isNotNull()), body)

    found = docs.select("repo", "path", F.explode(let(lines(F.col("content")), of_lines)).alias("s")).select("repo", "path", "s.*")
    return found.where(F.col("body") != "")


@operator("documents.routing")
def routing(secs: DataFrame) -> DataFrame:
    """Sections that are kept: the first description, all of the other kinds."""
    rest = secs.where(F.col("section").isin(D.KEPT_SECTIONS[1:])).select("repo", "section", "path", "ord", "body")
    first = (
        secs.where(F.col("section") == "Description")
        .groupBy("repo", "section")
        .agg(F.min(F.struct("path", "ord", "body")).alias("m"))
        .select("repo", "section", "m.*")
    )
    return first.unionByName(rest)


def match_context(content: Column, pattern: str) -> Column:
    """Non-overlapping windows of up to 100 characters around each match."""
    windows = F.regexp_extract_all(content, F.lit(f"(?isU).{{0,100}}(?:{bare_pattern(pattern)}).{{0,100}}"), F.lit(0))
    return F.array_join(windows, " | ")


def context_confidence(context: Column) -> Column:
    points = (
        F.lit(50)
        + F.when(F.lower(context).contains("install"), 20).otherwise(0)
        + F.when(context.contains("version") | context.contains("v"), 10).otherwise(0)
        + F.when(contains_any(context, ["dependencies", "requirements"]), 15).otherwise(0)
    )
    return F.least(points, F.lit(100)) / F.lit(100.0)


def version_in(context: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(context, p, 1), F.lit("")) for p in D.VERSION_PATTERNS])


def purpose(name: Column, context: Column) -> Column:
    return lookup(name, D.PURPOSES, first_label(F.lower(context), D.PURPOSE_WORDS, D.DEFAULT_PURPOSE))


def install_method(context: Column) -> Column:
    out = None
    for method, pattern in D.INSTALL_METHODS:
        out = F.when(context.rlike(pattern), method) if out is None else out.when(context.rlike(pattern), method)
    return out


def config_notes(context: Column) -> Column:
    sentences = F.transform(F.split(context, r"\."), lambda s: F.trim(s))
    return F.filter(sentences, lambda s: contains_any(F.lower(s), D.CONFIG_WORDS) & (F.octet_length(s) > 10))


@operator("documents.technologies")
def technologies(docs: DataFrame) -> DataFrame:
    """One row per technology and repository, from the first file that names it."""
    content = F.col("content")


    def named(low: Column) -> Column:
        rows = [
            F.when(quick_match(content, low, p), F.struct(F.lit(n).alias("name"), match_context(content, p).alias("context"))) for n, p in D.TECHNOLOGIES
        ]
        return F.array_compact(F.array(*rows))

    context = F.col("context")
    return (
        docs.select("repo", "path", F.explode(let(folded(content), named)).alias("t"))
        .groupBy("repo", F.col("t.name").alias("name"))
        .agg(F.min(F.struct("path", "t.context")).alias("m"))
        .select("repo", "name", "m.path", F.col("m.context").alias("context"))
        .select(
            "repo", "name", "path", "context",
            version_in(context).alias("version"), purpose(F.col("name"), context).alias("purpose"),
            install_method(context).alias("installation_method"), config_notes(context).alias("configuration_notes"),
            context_confidence(context).alias("confidence"),
        )
    )


@operator("documents.setup_commands")
def setup_commands(docs: DataFrame) -> DataFrame:
    """Distinct setup commands with the place of their first mention."""
    trimmed = lambda l: F.regexp_replace(l, r"^\s+|\s+\z", "")
    any_command = "(?iU)(?:" + "|".join(bare_pattern(p) for p in D.SETUP_COMMANDS) + ")"
    found = F.filter(
        F.transform(lines(F.col("content")), lambda l, i: F.struct((i + 1).alias("line_no"), trimmed(l).alias("line"))),
        lambda x: x["line"].rlike(any_command) & ~x["line"].startswith("```") & ~x["line"].startswith("#"),
    )
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("h.line", "^`+", ""), r"`+\z", ""), r"^(\$ )+", "")
    return (
        docs.select("repo", "path", F.explode(found).alias("h"))
        .select("repo", "path", "h.line_no", trimmed(bare).alias("command"))
        .groupBy("repo", "command")
        .agg(F.min(F.struct("path", "line_no")).alias("m"))
        .select("repo", "command", "m.path", "m.line_no")
    )


@operator("documents.coverage")
def coverage(repos: DataFrame, secs: DataFrame, commands: DataFrame) -> DataFrame:
    """Found and missing sections, completeness, indicators and suggestions."""
    found = secs.groupBy("repo").agg(F.array_sort(F.collect_set("section")).alias("found"))
    has_cmd = commands.groupBy("repo").agg(F.lit(True).alias("has_commands"))
    base = repos.join(found, "repo", "left").join(has_cmd, "repo", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    expected = F.array(*[F.lit(s) for s in D.EXPECTED_SECTIONS])
    missing = F.array_except(expected, F.col("found"))
    has = lambda s: F.array_contains("found", s)
    cmds = F.coalesce("has_commands", F.lit(False))
    return base.select(
        "repo", "found", missing.alias("missing"),
        (F.size("found") / (F.size("found") + F.size(missing))).alias("completeness"),
        F.array_compact(F.array(
            F.when(has("Description"), "Has project description"), F.when(has("Installation"), "Has installation instructions"),
            F.when(has("Usage"), "Has usage examples"), F.when(cmds, "Has setup commands"),
        )).alias("indicators"),
        F.array_compact(F.array(
            F.when(~has("Description"), "Add project description"), F.when(~has("Installation"), "Add installation instructions"),
            F.when(~has("Usage"), "Add usage examples"),
        )).alias("suggestions"),
        (has("Description") | has("Installation") | has("Usage")).alias("substantial"),
    )


@operator("documents.confidence")
def confidence(cover: DataFrame, techs: DataFrame) -> DataFrame:
    """Mean of coverage, mean technology confidence, and a low mark for thin content."""
    points = techs.groupBy("repo").agg(
        (F.sum(F.round(F.col("confidence") * 100).cast("bigint")) / F.count("*") / 100.0).alias("tech_confidence")
    )
    parts = F.array_compact(F.array(F.col("completeness"), F.col("tech_confidence"), F.when(~F.col("substantial"), F.lit(0.3))))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)
    return cover.join(points, "repo", "left").select("repo", "completeness", "tech_confidence", r6(mean).alias("confidence"))


@operator("documents.merge_texts")
def merge_texts(items: DataFrame) -> DataFrame:
    """Distinct texts of several sources: the first source's wording wins.

    ``items(repo, source_rank, kind_rank, ord, body)``. The first copy is a
    minimum, which combines on the map side; copies of one text, however many,
    never meet in a task.
    """
    key = F.sha2(squeeze(F.col("body")), 256)
    return (
        items.withColumn("text_key", key)
        .groupBy("repo", "text_key")
        .agg(F.min(F.struct("source_rank", "kind_rank", "ord", "body")).alias("m"), F.count("*").alias("copies"))
        .select("repo", "m.*", "copies")
    )


@operator("documents.rule_conflicts")
def rule_conflicts(techs: DataFrame, secs: DataFrame) -> DataFrame:
    """React is documented but no installation text mentions npm."""
    npm = secs.where((F.col("section") == "Installation") & F.col("body").contains("npm")).select("repo").distinct()
    return techs.where(F.col("name") == "React").select("repo").distinct().join(npm, "repo", "left_anti").select(
        "repo", F.lit("MissingDependency").alias("conflict_type"), F.lit("Uses React").alias("documentation_claim"),
        F.lit("No npm installation instructions found").alias("code_reality"), F.lit("Medium").alias("severity"),
        F.lit("Add npm install instructions for React dependencies").alias("recommendation"),
    )


@operator("documents.profile")
def profile(repos: DataFrame, secs: DataFrame, techs: DataFrame, commands: DataFrame) -> DataFrame:
    """One row per repository: counts by section, technologies, commands, scores."""
    kinds = secs.groupBy("repo").agg(
        *[F.count_if(F.col("section") == s).alias(f"n_{s.lower()}") for s in D.KEPT_SECTIONS],
    )
    first = routing(secs).where(F.col("section") == "Description").select("repo", F.col("body").alias("description"))
    cover = coverage(repos, secs, commands)
    return (
        cover.select("repo", "completeness", "substantial")
        .join(confidence(cover, techs).select("repo", "confidence"), "repo")
        .join(kinds, "repo", "left")
        .join(first, "repo", "left")
        .join(techs.groupBy("repo").agg(F.count("*").alias("n_technologies")), "repo", "left")
        .join(commands.groupBy("repo").agg(F.count("*").alias("n_commands")), "repo", "left")
        .fillna(0)
    )
