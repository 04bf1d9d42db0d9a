"""Business domains: evidence, scores, candidates, fusion and adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from repograin.functions.automaton import Rule, hits
from repograin.functions.scores import r6
from repograin.functions.text import contains_any, file_stem, first_label, lookup
from repograin.registry import operator
from repograin.rules import domains as B


@operator("domains.evidence")
def evidence(files: DataFrame) -> DataFrame:
    """(repo, pack, domain, points, rows): all rules of all packs in one pass."""
    path, ext, content = F.col("path"), F.col("ext"), F.col("content")

    def row(pack, domain, weight):
        return F.struct(F.lit(pack).alias("pack"), F.lit(domain).alias("domain"), F.lit(weight).alias("points"))

    def scope(extension, words):
        return (ext == extension) & contains_any(path, words) if words else ext == extension

    tests = []
    for pack, domain, w, extension, where, words, paths in B.ANY_OF:
        hit = contains_any(content, words) if words else None
        if paths:
            hit = contains_any(path, paths) if hit is None else hit | contains_any(path, paths)
        tests.append(F.when(scope(extension, where) & hit, row(pack, domain, w)))
    for pack, domain, w, extension, where, words in B.EACH_OF:
        tests += [F.when(scope(extension, where) & content.contains(x), row(pack, domain, w)) for x in words]
    tests.append(F.when(scope("ts", ["usecase"]) & path.contains("notification") & contains_any(path, B.NOTIFICATION_USECASES), row(B.NEST, "Notification", 30)))
    entity = scope("ts", ["entity", "entities"]) & content.contains("@Entity()")
    pick = None
    for domain, w, words in B.NEST_ENTITIES:
        test = contains_any(file_stem(path), words)
        pick = F.when(test, row(B.NEST, domain, w)) if pick is None else pick.when(test, row(B.NEST, domain, w))
    tests.append(F.when(entity, pick))
    by_file = files.where(ext.isin("py", "ts")).select("repo", F.explode(F.array_compact(F.array(*tests))).alias("e")).select("repo", "e.*")
    summed = by_file.groupBy("repo", "pack", "domain").agg(F.sum("points").alias("points"), F.count("*").alias("rows"))

    def any_dir(ds):
        out = path.startswith(ds[0] + "/")
        for d in ds[1:]:
            out = out | path.startswith(d + "/")
        return out

    dirs = files.groupBy("repo").agg(*[F.bool_or(any_dir(ds)).alias(f"d{i}") for i, (_, _, _, ds) in enumerate(B.DIRECTORIES)])
    rows = F.array_compact(F.array(*[F.when(F.col(f"d{i}"), row(p, d, w)) for i, (p, d, w, _) in enumerate(B.DIRECTORIES)]))
    by_dir = dirs.select("repo", F.explode(rows).alias("e")).select("repo", "e.pack", "e.domain", F.col("e.points").cast("bigint").alias("points"), F.lit(1).cast("bigint").alias("rows"))
    return summed.unionByName(by_dir)


@operator("domains.scores")
def scores(ev: DataFrame, detected: DataFrame) -> DataFrame:
    """Sums per domain, each pack once per detected framework it serves."""
    pairs = [(p, f) for p, fs in B.PACK_FRAMEWORKS.items() for f in fs]
    packs = F.array_compact(F.array(*[F.when(F.col("framework") == f, F.lit(p)) for p, f in pairs]))
    runs = detected.select("repo", F.explode(packs).alias("pack"))
    total = ev.join(runs, ["repo", "pack"]).groupBy("repo", "domain").agg(F.sum("points").alias("points"), F.sum("rows").alias("evidence"))
    return total.where(F.col("points") >= B.KEEP)


def strategy(points: Column) -> Column:
    out = None
    for bound, name in B.STRATEGIES:
        out = F.when(points >= bound, name) if out is None else out.when(points >= bound, name)
    return out.otherwise("Minimal")


@operator("domains.split")
def split(scored: DataFrame) -> DataFrame:
    return scored.withColumn("role", F.when(F.col("points") >= B.PRIMARY, "primary").otherwise("secondary")).withColumn("strategy", strategy(F.col("points")))


@operator("domains.candidates")
def candidates(profile: DataFrame, detected: DataFrame) -> DataFrame:
    """Business type by name and description words, then frameworks; first three candidates."""
    known = detected.groupBy("repo").agg(F.collect_set("framework").alias("known"))
    name, text = F.lower("name"), F.lower(F.coalesce("description", F.lit("")))
    kind = None
    for label, names, words in B.BUSINESS_TYPES:
        test = contains_any(name, names) | contains_any(text, words)
        kind = F.when(test, label) if kind is None else kind.when(test, label)
    has = lambda fs: F.arrays_overlap(F.coalesce("known", F.array().cast("array<string>")), F.array(*[F.lit(f) for f in fs]))
    kind = kind.when(has(B.WEB_FRAMEWORKS), "Web Application").when(has(B.API_FRAMEWORKS), "API Service").otherwise("Application")
    base = None
    for label, names in B.CANDIDATES.items():
        value = F.array(*[F.lit(n) for n in names])
        base = F.when(F.col("business_type") == label, value) if base is None else base.when(F.col("business_type") == label, value)
    hinted = lambda w, d: F.when(F.exists("domain_hints", lambda h: F.lower(h).contains(w)), F.lit(d))
    extra = F.array_compact(F.array(hinted("notification", "Notification"), hinted("file", "FileManagement")))
    return profile.join(known, "repo", "left").withColumn("business_type", kind).select("repo", "business_type", F.array_distinct(F.concat(base, extra)).alias("candidates"))


@operator("domains.capabilities")
def capabilities(profile: DataFrame, entries: DataFrame) -> DataFrame:
    """Capability labels from entry points (a fixed list of paths) and hints."""
    p = F.lower("path")
    per = F.array_compact(F.array(
        F.when(contains_any(p, ["main", "app"]), "Core Application Logic"), F.when(contains_any(p, ["server", "api"]), "API Services"), F.when(contains_any(p, ["cli", "command"]), "Command Line Interface"),
    ))
    found = entries.select("repo", F.posexplode(per).alias("pos", "label"), "path").groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("path", "pos", "label"))).alias("ls"))
    labels = F.transform(F.coalesce("ls", F.array().cast("array<struct<path:string,pos:int,label:string>>")), lambda x: x["label"])
    both = F.concat(labels, F.transform("domain_hints", lambda h: F.concat(F.lit("Business Logic: "), h)))
    return profile.join(found, "repo", "left").select("repo", F.when(F.size(both) == 0, F.array(F.lit("General Application Functions"))).otherwise(both).alias("capabilities"))


@operator("domains.semantics")
def semantics(segments: DataFrame, cands: DataFrame) -> DataFrame:
    """(repo, candidate, pattern, points, segments) of keyword groups of the candidates.

    Words are tested in the segment's row and counted before the join with the
    repository's candidates.
    """
    c = F.col("content")
    hits = F.array_compact(F.array(*[F.when(contains_any(c, ws), F.lit(i)) for i, (_, _, ws, _) in enumerate(B.SEMANTICS)]))
    n = segments.select("repo", F.explode(hits).alias("rule")).groupBy("repo", "rule").agg(F.count("*").alias("n"))
    attr = lambda k: lookup(F.col("rule"), {i: r[k] for i, r in enumerate(B.SEMANTICS)})
    rows = n.select("repo", attr(0).alias("candidate"), attr(3).alias("pattern"), attr(1).alias("points"), "n")
    wanted = cands.select("repo", F.explode("candidates").alias("candidate"))
    return rows.join(wanted, ["repo", "candidate"])


@operator("domains.align")
def align(sem: DataFrame, primary: DataFrame) -> DataFrame:
    """Evidence of a primary domain counts 1.3 times; points become thousandths."""
    domain = first_label(F.lower("pattern"), B.PATTERN_DOMAINS, "Unknown")
    marked = sem.withColumn("domain", domain).join(primary.select("repo", "domain").distinct().withColumn("primary", F.lit(True)), ["repo", "domain"], "left")
    return marked.select("repo", "candidate", "pattern", "domain", "n", (F.col("points") * F.when(F.col("primary"), 13).otherwise(10)).alias("milli"))


@operator("domains.validate")
def validate(cands: DataFrame, aligned: DataFrame) -> DataFrame:
    """Candidate share plus summed evidence, by rank, if at least 0.3."""
    base = cands.select("repo", F.explode("candidates").alias("domain"), F.lit(3000).cast("bigint").alias("p"))
    more = aligned.select("repo", "domain", (F.col("milli") * 6 * F.col("n")).cast("bigint").alias("p"))
    total = base.unionByName(more).groupBy("repo", "domain").agg(F.sum("p").alias("p"))
    w = Window.partitionBy("repo").orderBy(F.desc("p"), "domain")
    top = total.withColumn("rank", F.row_number().over(w)).where(F.col("p") >= 3000)
    return top.select("repo", "domain", "rank", (F.col("p") / 10000.0).alias("confidence"))


@operator("domains.overall")
def overall(validated: DataFrame) -> DataFrame:
    w = lookup(F.col("rank"), B.RANK_WEIGHTS)
    return validated.groupBy("repo").agg(r6(F.sum(F.col("confidence") * w) / F.sum(w)).alias("overall_confidence"), F.min_by("domain", "rank").alias("primary_domain"))


def label_domain(text: Column) -> Column:
    return first_label(F.lower(text), B.LABELS, "Unknown")


@operator("domains.merge")
def merge(scored: DataFrame, validated: DataFrame) -> DataFrame:
    """.6 of the rule score + .4 of the model score where both exist."""
    a = scored.select("repo", "domain", (F.col("points") / 100.0).alias("a"))
    b = validated.select("repo", label_domain(F.col("domain")).alias("domain"), "confidence").groupBy("repo", "domain").agg(F.max("confidence").alias("b"))
    out = a.join(b, ["repo", "domain"], "full").withColumn(
        "confidence", r6(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a") * 0.6 + F.col("b") * 0.4).otherwise(F.coalesce("a", "b")))
    )
    role = F.when(F.col("a").isNotNull(), F.when(F.col("a") >= 0.6, "primary").otherwise("secondary")).otherwise(F.when(F.col("b") >= 0.8, "primary").otherwise("secondary"))
    return out.select("repo", "domain", "confidence", role.alias("role"))


@operator("domains.adjust")
def adjust(merged: DataFrame, types: DataFrame) -> DataFrame:
    """Raise or lower domains by project type; only the lowering types drop weak ones."""
    up, down, drops = F.lit(False), F.lit(False), F.lit(False)
    for t, (raised, lowered) in B.ADJUSTMENTS.items():
        on = F.col("project_type") == t
        up = up | (on & F.col("domain").isin(raised))
        if lowered:
            down, drops = down | (on & F.col("domain").isin(lowered)), drops | on
    value = F.when(up, F.least(F.col("confidence") + 0.15, F.lit(1.0))).when(down, F.greatest(F.col("confidence") - 0.2, F.lit(0.0))).otherwise(F.col("confidence"))
    joined = merged.join(types.select("repo", "project_type"), "repo", "left")
    return joined.withColumn("dropped", drops).withColumn("confidence", r6(value)).where(~F.coalesce("dropped", F.lit(False)) | (F.col("confidence") >= 0.4)).drop("dropped")


@operator("domains.items")
def items(components: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo, kind, item): endpoints, dependencies and file names of a repository."""
    e = components.select("repo", F.lit("endpoint").alias("kind"), F.explode("api_calls").alias("a")).select("repo", "kind", F.col("a.endpoint").alias("item"))
    d = deps.select("repo", F.lit("dependency").alias("kind"), F.col("name").alias("item"))
    f = components.select("repo", F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("item"))
    return e.unionByName(d).unionByName(f)


CONFIG_RULES = [Rule(d, tuple(B.ITEM_KINDS[t]), tuple(x.lower() for x in ws), w) for d, (_, _, _, ps) in B.CONFIG.items() for t, ws, w in ps]


@operator("domains.config_scores")
def config_scores(rows: DataFrame, rules: Sequence[Rule] = CONFIG_RULES) -> DataFrame:
    """Per configured domain the number of items hit × weight; rules may be loaded at run time."""
    numbered = rows.select("repo", F.col("kind").alias("scope"), F.lower("item").alias("text")).groupBy("repo", "scope", "text").agg(F.count("*").alias("items"))
    found = hits(numbered, rules, ["repo", "scope", "text", "items"]).select("repo", "scope", "text", "items", "rule").distinct()
    weights = [(n, r.subject, r.weight) for n, r in enumerate(rules)]
    table = rows.sparkSession.createDataFrame(weights, "rule int, domain string, weight int" if all(isinstance(r.weight, int) for r in rules) else "rule int, domain string, weight double")
    return found.join(table, "rule").groupBy("repo", "domain").agg(F.sum(F.col("items") * F.col("weight")).alias("points")).select("repo", "domain", "points")


@operator("domains.best")
def best(repos: DataFrame, config: DataFrame) -> DataFrame:
    top = config.groupBy("repo").agg(F.min(F.struct((-F.col("points")).alias("neg"), "domain")).alias("m"))
    return repos.join(top, "repo", "left").select("repo", F.coalesce("m.domain", F.lit(B.GENERAL[0])).alias("domain"), (F.coalesce(-F.col("m.neg"), F.lit(0)) / 100.0).alias("score"))


@operator("domains.purpose")
def purpose(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """Domain name and description, and how many endpoints and dependencies are evidence; :func:`purpose_evidence` has them all."""
    names = {k: v[0] for k, v in B.CONFIG.items()} | {B.GENERAL[0]: B.GENERAL[1]}
    texts = {k: v[1] for k, v in B.CONFIG.items()} | {B.GENERAL[0]: B.GENERAL[2]}
    n = purpose_evidence(rows).groupBy("repo").agg(F.count_if(F.col("kind") == "endpoint").alias("endpoints"), F.count_if(F.col("kind") == "dependency").alias("dependencies"))
    return chosen.join(n, "repo", "left").fillna(0, ["endpoints", "dependencies"]).select(
        "repo", "domain", lookup(F.col("domain"), names).alias("name"), lookup(F.col("domain"), texts).alias("description"), "endpoints", "dependencies")


@operator("domains.purpose_evidence")
def purpose_evidence(rows: DataFrame) -> DataFrame:
    """(repo, kind, item): every distinct endpoint and dependency, as rows, so that no repository is gathered."""
    return rows.where(F.col("kind").isin("endpoint", "dependency") & F.col("item").isNotNull()).select("repo", "kind", "item").distinct()
