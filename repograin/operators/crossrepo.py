"""Links between repositories found in their documentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions.scores import r6
from repograin.functions.text import contains_any, matches
from repograin.registry import operator
from repograin.rules import context as X


def camel(name: Column) -> Column:
    parts = F.split(name, "[-_]")
    head = F.lower(parts[0])
    tail = F.transform(F.filter(F.slice(parts, 2, F.size(parts)), lambda p: p != ""), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p)))))
    return F.concat(head, F.array_join(tail, ""))


@operator("crossrepo.identifiers")
def identifiers(repos: DataFrame, meta: DataFrame) -> DataFrame:
    """Names a repository goes by: directory name, its spellings, manifest names."""
    r = F.col("repo")
    own = repos.select("repo", F.explode(F.array_distinct(F.array(r, F.replace(r, F.lit("-"), F.lit("_")), F.replace(r, F.lit("_"), F.lit("-")), camel(r), F.lower(F.replace(r, F.lit("_"), F.lit("-")))))).alias("identifier"))
    named = meta.where(F.col("manifest").isin("package.json", "Cargo.toml")).select("repo", F.col("name").alias("identifier"))
    return own.unionByName(named).distinct()


def _words(text: Column) -> Column:
    """Distinct lower-case words: letters, digits and underscores of any script."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+")), lambda w: w != "")


@operator("crossrepo.mentions")
def mentions(sections: DataFrame, idents: DataFrame) -> DataFrame:
    """(source, section identity, target, identifier, exact, related, component).

    Sections of one repository that name another as a bounded name, whatever
    signs the name has. Sections meet identifiers by the identifier's rarest
    word; the body comes back once for each section and identifier so found,
    for the exact test. Identifiers without a letter or digit name nothing.
    """
    place = ["source", "path", "ord"]
    doc = sections.where(F.col("section").isin("Description", "Architecture", "Api")).withColumnRenamed("repo", "source").select(*place, "section", "body")
    parts = idents.select(F.col("repo").alias("target"), "identifier", F.explode(_words(F.col("identifier"))).alias("word"))
    words = doc.select(*place, F.explode(_words(F.col("body"))).alias("word"))
    common = words.join(parts.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    keys = parts.join(common, "word", "left").groupBy("target", "identifier").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))["word"].alias("word"))
    pairs = words.join(keys, "word").where("source <> target").select(*place, "target", "identifier")
    name = F.regexp_replace("identifier", r"([^\p{L}\p{N}_])", r"\\$1")
    before, after = F.lit(r"(?<![\p{L}\p{N}_])"), F.lit(r"(?![\p{L}\p{N}_])")
    bounded = F.concat(before, name, after)
    related = F.concat(F.lit("(?i)"), before, name, F.lit(r"-[\p{L}\p{N}_]|[\p{L}\p{N}_]-"), name, after)
    component = F.concat(F.lit(r"(?i)(?:component|service|module|project).*"), bounded, F.lit("|"), bounded, F.lit(r".*(?:component|service|module)"))
    return (
        pairs.join(doc, place).where(F.contains(F.lower("body"), F.lower("identifier")) & F.rlike("body", F.concat(F.lit("(?i)"), bounded)))
        .withColumn("related", F.rlike("body", related)).withColumn("component", F.rlike("body", component))
    )


@operator("crossrepo.relations")
def relations(found: DataFrame) -> DataFrame:
    """Relations of a project (target) to the source that names it, from overview and architecture texts."""
    base = found.where(F.col("section").isin("Description", "Architecture"))
    parent = base.where(matches(F.col("body"), X.PARENT_PATTERN)).select("target", "source", F.lit("ParentProject").alias("relation"), F.col("source").alias("name"), F.lit(0.8).alias("confidence"))
    exact = base.select("target", "source", F.lit("SharedContext").alias("relation"), F.col("identifier").alias("name"), F.lit(0.9).alias("confidence"))
    near = base.where("related").select("target", "source", F.lit("SiblingProject").alias("relation"), F.col("identifier").alias("name"), F.lit(0.7).alias("confidence"))
    return parent.unionByName(exact).unionByName(near).distinct()


@operator("crossrepo.relevance")
def relevance(found: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Mean pattern weight per (section, target), for architecture and API texts."""
    agg = found.where(F.col("section").isin("Architecture", "Api")).groupBy("source", "path", "ord", "section", "target").agg(
        F.count("*").alias("exact"), F.count_if("related").alias("related"), F.count_if("component").alias("component"), F.min("body").alias("body"), F.array_sort(F.collect_set("identifier")).alias("references")
    )
    parent, overview = matches(F.col("body"), X.PARENT_PATTERN).cast("int"), matches(F.col("body"), X.OVERVIEW_PATTERN).cast("int")
    n = F.col("exact") + F.col("related") + F.col("component") + parent + overview
    score = (F.col("exact") * 4 + F.col("related") * 3 + F.col("component") * 2 + parent + overview) / n / 10.0
    return agg.withColumn("relevance", r6(score)).where(F.col("relevance") >= threshold)


@operator("crossrepo.parents")
def parents(rel: DataFrame) -> DataFrame:
    """Best parent and the siblings of each project."""
    best = rel.where("relation = 'ParentProject'").groupBy("target").agg(F.min(F.struct((-F.col("confidence")).alias("neg"), "name")).alias("m"))
    sib = rel.where("relation = 'SiblingProject'").select("target", "name").distinct().groupBy("target").agg(F.count("*").alias("siblings"), F.min("name").alias("first_sibling"))
    return best.join(sib, "target", "left").select("target", F.col("m.name").alias("parent"), (-F.col("m.neg")).alias("confidence"), F.coalesce("siblings", F.lit(0)).alias("siblings"), "first_sibling")


@operator("crossrepo.roles")
def roles(docs: DataFrame) -> DataFrame:
    """Role by the keyword group most documents show; ties by name."""
    low = F.lower("body")
    n = docs.groupBy("target").agg(*[F.count_if(contains_any(low, ws)).alias(f"n{i}") for i, (_, ws) in enumerate(X.ROLES)])
    options = F.array_compact(F.array(*[F.when(F.col(f"n{i}") > 0, F.struct((-F.col(f"n{i}")).alias("neg"), F.lit(role).alias("role"))) for i, (role, _) in enumerate(X.ROLES)]))
    return n.select("target", F.coalesce(F.array_min(options)["role"], F.lit(X.DEFAULT_ROLE)).alias("role"))


@operator("crossrepo.infrastructure")
def infrastructure(docs: DataFrame) -> DataFrame:
    low = F.lower("body")
    n = docs.groupBy("target").agg(*[F.bool_or(contains_any(low, ws)).alias(f"b{i}") for i, (_, ws) in enumerate(X.INFRASTRUCTURE)])
    return n.select("target", F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"b{i}"), F.lit(t)) for i, (t, _) in enumerate(X.INFRASTRUCTURE)]))).alias("shared"))
