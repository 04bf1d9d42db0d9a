"""Framework detection: one scan for all probes, then formulas per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions.scores import bucket, r6
from repograin.functions.text import contains_any, lookup
from repograin.registry import operator
from repograin.rules import frameworks as W
from repograin.sources.corpus import not_ignored

_LEAF = {"words", "pruned", "in", "file", "dir", "ext", "suffix", "depth"}


def leaves(formula) -> list:
    if formula[0] in _LEAF:
        return [formula]
    return [leaf for part in formula[1:] for leaf in leaves(part)]


def _all_formulas() -> list:
    out = [t for _, _, _, _, parts in W.BASIC for _, t in parts]
    out += [t for _, _, t in W.ENHANCED] + [t for _, t in W.RUST] + [t for _, t in W.NAMED] + [t for *_, t in W.LISTED]
    out += list(W.COMPOSITES.values()) + [t for _, t in W.CROSS.values()] + [W.API_PATTERNS] + [t for _, _, t in W.DANET_DETAIL]
    out += [W.file("deno.json"), W.file("tsconfig.json"), W.file("manage.py", "settings.py"), W.file("manage.py"), W.file("app.py"), W.file("app.py", "wsgi.py"),
            W.inside("requirements.txt", "django", "flask"), W.inside("package.json", '"react"'), W.inside("pom.xml", "spring-boot"),
            W.inside("build.gradle", "spring-boot"), W.file("pom.xml")]
    return out


PROBES = list(dict.fromkeys(leaf for f in _all_formulas() for leaf in leaves(f)))


def probe_column(probe) -> Column:
    """Does this file satisfy the probe?"""
    kind, path, ext, content = probe[0], F.col("path"), F.col("ext"), F.col("content")
    if kind == "words":
        return F.lower(ext).isin(list(probe[1])) & contains_any(content, probe[2])
    if kind == "pruned":
        return ext.isin(list(probe[1])) & not_ignored(path) & contains_any(content, probe[2])
    if kind == "in":
        return (path == probe[1]) & contains_any(content, probe[2])
    if kind == "file":
        return path.isin(list(probe[1]))
    if kind == "dir":
        test = path.startswith(probe[1][0] + "/")
        for d in probe[1][1:]:
            test = test | path.startswith(d + "/")
        return test
    if kind == "ext":
        return ext.isin(list(probe[1]))
    if kind == "suffix":
        return path.endswith(probe[1]) & contains_any(content, probe[2])
    _, depth, exts, ws = probe
    near = (F.size(F.split(path, "/")) <= depth) & ext.isin(list(exts))
    return near & contains_any(content, ws) if ws else near & ~path.contains("node_modules")


def formula_column(formula, flags: Column) -> Column:
    """Formula over the probe numbers a repository satisfies."""
    kind = formula[0]
    if kind in _LEAF:
        return F.array_contains(flags, F.lit(PROBES.index(formula)))
    parts = [formula_column(f, flags) for f in formula[1:]]
    if kind == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = (out | p) if kind == "any" else (out & p)
    return out


@operator("frameworks.flags")
def flags(repos: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, flags): numbers of the probes some file satisfies.

    The set per repository is bounded by the number of probes and combines on
    the map side, so a repository of any size shuffles a few numbers per task.
    """
    hit = F.array_compact(F.array(*[F.when(probe_column(p), F.lit(i)) for i, p in enumerate(PROBES)]))
    found = files.select("repo", F.explode(hit).alias("probe")).groupBy("repo").agg(F.array_sort(F.collect_set("probe")).alias("flags"))
    return repos.join(found, "repo", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<int>")))


@operator("frameworks.ecosystem")
def ecosystem(repos: DataFrame, files: DataFrame, flagged: DataFrame, enhanced: bool = False) -> DataFrame:
    """Highest file score per language, ties by name; Mixed without any."""
    n = lambda *exts: F.count_if(F.col("ext").isin(*exts))
    base = files.where(not_ignored(F.col("path"))).groupBy("repo").agg(
        n("py").alias("py"), n("ts", "tsx").alias("ts"), n("js").alias("js"), n("js", "jsx").alias("jsx"), n("java").alias("java"), n("rs").alias("rs")
    )
    joined = repos.join(base, "repo", "left").join(flagged, "repo", "left")
    fl = F.col("flags")
    deno = formula_column(("any", W.file("deno.json"), W.URL_IMPORTS), fl)

    def entry(name, points, test=F.lit(True)):
        return F.when(test & (points > 0), F.struct((-points).alias("neg"), (F.lit(name) if isinstance(name, str) else name).alias("name")))

    if enhanced:
        options = [entry("Python", F.col("py") * 10), entry("TypeScript", F.col("ts") * 10), entry("JavaScript", F.col("jsx") * 8),
                   entry("Java", F.col("java") * 10), entry("Rust", F.col("rs") * 10)]
    else:
        options = [entry("Python", F.col("py") * 10), entry(F.when(deno, "Deno").otherwise("TypeScript"), F.col("ts") * 10),
                   entry("JavaScript", F.col("js") * 10, ~formula_column(W.file("tsconfig.json"), fl)), entry("Java", F.col("java") * 10)]
    best = F.array_min(F.array_compact(F.array(*options)))
    return joined.select("repo", F.coalesce(best["name"], F.lit("Mixed")).alias("ecosystem"), F.coalesce(-best["neg"], F.lit(0)).alias("score"))


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


@operator("frameworks.evidence")
def evidence(flagged: DataFrame) -> DataFrame:
    """(repo, framework, rule, evidence_type, source, pattern, points) of the basic packs."""
    rows = []
    for i, (fw, kind, source, pattern, parts) in enumerate(W.BASIC):
        points = _sum([F.when(formula_column(t, F.col("flags")), w).otherwise(0) for w, t in parts])
        gate = formula_column(W.GATES[fw], F.col("flags")) if fw in W.GATES else F.lit(True)
        rows.append(F.when(
            gate & (points > 0),
            F.struct(F.lit(fw).alias("framework"), F.lit(i).alias("rule"), F.lit(kind).cast("string").alias("evidence_type"), F.lit(source).alias("source"),
                     F.lit(pattern).alias("pattern"), points.alias("points")),
        ))
    return flagged.select("repo", F.explode(F.array_compact(F.array(*rows))).alias("e")).select("repo", "e.*")


@operator("frameworks.raw")
def raw_scores(ev: DataFrame) -> DataFrame:
    """Points, quality-weighted mean and number of evidence types per framework."""
    shown = F.col("evidence_type").isNotNull()
    quality = lookup(F.col("evidence_type"), W.QUALITY, 0)
    return ev.groupBy("repo", "framework").agg(
        F.sum("points").alias("points"),
        F.count_if(shown).alias("n_evidence"),
        F.sum(F.when(shown, F.col("points") * quality).otherwise(0)).alias("quality_points"),
        F.count_distinct("evidence_type").alias("n_types"),
    )


def detected(raw: DataFrame) -> DataFrame:
    keep = None
    for fw, (bound, inclusive) in W.THRESHOLDS.items():
        test = (F.col("framework") == fw) & ((F.col("points") >= bound) if inclusive else (F.col("points") > bound))
        keep = test if keep is None else keep | test
    return raw.where(keep)


def weighted_confidence(quality_points: Column, n: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(F.least(quality_points / (n * 1000.0), F.lit(1.0)))


def cross_factor(framework: Column, n_types: Column, flags_col: Column) -> Column:
    adjust = F.lit(1.0)
    for fw, (factor, test) in W.CROSS.items():
        adjust = F.when((framework == fw) & formula_column(test, flags_col), F.lit(factor)).otherwise(adjust)
    return adjust * lookup(n_types, W.DIVERSITY, W.DIVERSITY_NONE)


@operator("frameworks.confidence")
def confidence(raw: DataFrame, flagged: DataFrame) -> DataFrame:
    """Detected frameworks with confidence and usage extent."""
    fw = F.col("framework")
    base = detected(raw).join(flagged, "repo")
    weighted = weighted_confidence(F.col("quality_points"), F.col("n_evidence"))
    factor = cross_factor(fw, F.col("n_types"), F.col("flags"))
    conf = F.when(fw.isin(W.WEIGHTED), F.least(weighted * factor, F.lit(1.0))).otherwise(F.least(F.col("points"), F.lit(100)) / 100.0)
    return base.select(
        "repo", "framework", "points", "n_evidence", "n_types", r6(weighted).alias("weighted"), r6(factor).alias("factor"), r6(conf).alias("confidence")
    ).withColumn("extent", bucket(F.col("confidence"), W.EXTENT_BASIC, W.LOWEST_EXTENT))


@operator("frameworks.dispatch")
def dispatch(conf: DataFrame, eco: DataFrame) -> DataFrame:
    """Keep the packs of the primary ecosystem; the pack table is fixed and tiny."""
    packs = [(e, f) for e, fs in W.PACKS.items() for f in fs]
    keep = None
    for e, f in packs:
        test = (F.col("ecosystem") == e) & (F.col("framework") == f)
        keep = test if keep is None else keep | test
    return conf.join(eco.select("repo", "ecosystem"), "repo").where(keep)


def _wide(conf: DataFrame) -> DataFrame:
    return conf.groupBy("repo").agg(*[F.max(F.when(F.col("framework") == f, F.col("confidence"))).alias(f) for f in W.FRAMEWORKS])


def _long(wide: DataFrame) -> DataFrame:
    return wide.unpivot("repo", W.FRAMEWORKS, "framework", "confidence").where(F.col("confidence").isNotNull())


def boost_stacks(wide: DataFrame) -> DataFrame:
    """×1.1 for full-stack pairs and Next.js, in the fixed order, capped each time."""
    cols = {f: F.col(f) for f in W.FRAMEWORKS}
    has = {f: F.col(f).isNotNull() for f in W.FRAMEWORKS}
    up = lambda c: F.when(c.isNotNull(), F.least(c * 1.1, F.lit(1.0)))  # least() skips nulls
    for a, b in W.FULLSTACK_PAIRS:
        if a in cols and b in cols:
            both = has[a] & has[b]
            cols[a], cols[b] = F.when(both, up(cols[a])).otherwise(cols[a]), F.when(both, up(cols[b])).otherwise(cols[b])
    cols["NextJS"] = up(cols["NextJS"])
    return wide.select("repo", *[c.alias(f) for f, c in cols.items()], *[c for c in wide.columns if c not in ("repo", *W.FRAMEWORKS)])


def boost_servers(wide: DataFrame) -> DataFrame:
    """×1.05 for server frameworks where some file shows API traffic."""
    seen = formula_column(W.API_PATTERNS, F.col("flags"))
    return wide.select(
        "repo", "flags",
        *[(F.when(seen & F.col(f).isNotNull(), F.least(F.col(f) * 1.05, F.lit(1.0))).otherwise(F.col(f)) if f in W.SERVER_FRAMEWORKS else F.col(f)).alias(f) for f in W.FRAMEWORKS],
    )


def settle_conflicts(wide: DataFrame) -> DataFrame:
    """×0.7 for the weaker of a conflicting pair; a tie costs the second."""
    cols = {f: F.col(f) for f in W.FRAMEWORKS}
    for a, b in W.CONFLICTING:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        first = F.col(a) < F.col(b)
        cols[a] = F.when(both & first, F.col(a) * 0.7).otherwise(cols[a])
        cols[b] = F.when(both & ~first, F.col(b) * 0.7).otherwise(cols[b])
    return wide.select("repo", *[cols[f].alias(f) for f in W.FRAMEWORKS])


@operator("frameworks.cross_adjust")
def cross_adjust(conf: DataFrame, flagged: DataFrame) -> DataFrame:
    """API boost, conflict pairs, then full-stack boosts over all packs of a repository."""
    wide = _wide(conf).join(flagged, "repo")
    return _long(boost_stacks(settle_conflicts(boost_servers(wide)))).withColumn("confidence", r6(F.col("confidence")))


@operator("frameworks.conflicts")
def conflicts(conf: DataFrame) -> DataFrame:
    wide = _wide(conf)
    return _long(settle_conflicts(wide)).withColumn("confidence", r6(F.col("confidence")))


@operator("frameworks.stacks")
def stacks(conf: DataFrame) -> DataFrame:
    return _long(boost_stacks(_wide(conf))).withColumn("confidence", r6(F.col("confidence")))


@operator("frameworks.enhanced")
def enhanced(flagged: DataFrame) -> DataFrame:
    """Second packs: rule count decides the cap; Rust frameworks at a fixed score."""
    by_fw: dict[str, list] = {}
    for fw, w, t in W.ENHANCED:
        by_fw.setdefault(fw, []).append((w, t))
    fl = F.col("flags")
    rows = []
    for fw, parts in by_fw.items():
        points = _sum([F.when(formula_column(t, fl), w).otherwise(0) for w, t in parts])
        hits = _sum([F.when(formula_column(t, fl), 1).otherwise(0) for _, t in parts])
        capped = F.when(hits >= 3, F.least(points, F.lit(95))).when(hits == 2, F.least(points, F.lit(80))).otherwise(points)
        rows.append(F.struct(F.lit(fw).alias("framework"), capped.alias("points"), hits.alias("rules")))
    for fw, t in W.RUST:
        rows.append(F.struct(F.lit(fw).alias("framework"), F.when(formula_column(t, fl), W.RUST_POINTS).otherwise(0).alias("points"), F.when(formula_column(t, fl), 1).otherwise(0).alias("rules")))
    out = flagged.select("repo", F.explode(F.array(*rows)).alias("e")).select("repo", "e.*").where(F.col("points") > 30)
    return out.withColumn("confidence", F.col("points") / 100.0).withColumn("extent", bucket(F.col("confidence"), W.EXTENT_ENHANCED, W.LOWEST_EXTENT))


@operator("frameworks.listed_evidence")
def listed_evidence(flagged: DataFrame) -> DataFrame:
    rows = [
        F.when(formula_column(t, F.col("flags")), F.struct(F.lit(fw).alias("framework"), F.lit(kind).alias("evidence_type"), F.lit(src).alias("source"), F.lit(pat).alias("pattern"), F.lit(w / 100).alias("weight")))
        for fw, kind, src, pat, w, t in W.LISTED
    ]
    return flagged.select("repo", F.explode(F.array_compact(F.array(*rows))).alias("e")).select("repo", "e.*")


@operator("frameworks.composites")
def composites(flagged: DataFrame) -> DataFrame:
    return flagged.select("repo", *[formula_column(t, F.col("flags")).alias(n) for n, t in W.COMPOSITES.items()])


@operator("frameworks.architecture")
def architecture(flagged: DataFrame) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(formula_column(t, F.col("flags")), F.lit(n)) for n, t in W.NAMED]))
    pick = None
    for n, label in W.ARCHITECTURES:
        test = F.array_contains("names", n)
        pick = F.when(test, label) if pick is None else pick.when(test, label)
    return flagged.select("repo", names.alias("names")).withColumn("architecture", pick.otherwise(W.DEFAULT_ARCHITECTURE))


@operator("frameworks.danet_detail")
def danet_detail(flagged: DataFrame, files: DataFrame) -> DataFrame:
    """Signed points for Deno projects, plus a count of direct URL imports."""
    urls = files.where(
        (F.size(F.split("path", "/")) <= W.SHALLOW) & F.col("ext").isin("ts", "js") & F.col("content").contains(W.URL_IMPORT_WORD)
    ).groupBy("repo").agg(F.count("*").alias("urls"))
    points = _sum([F.when(formula_column(t, F.col("flags")), w).otherwise(0) for _, w, t in W.DANET_DETAIL])
    rules = _sum([F.when(formula_column(t, F.col("flags")), 1).otherwise(0) for _, _, t in W.DANET_DETAIL])
    n = F.coalesce("urls", F.lit(0))
    return flagged.join(urls, "repo", "left").select(
        "repo", (points + n * W.URL_IMPORT_POINTS).alias("points"), (rules + n).alias("evidence")
    ).withColumn("is_danet_project", F.col("points") > W.DANET_PROJECT_POINTS)


@operator("frameworks.versions")
def versions(files: DataFrame) -> DataFrame:
    """Framework versions from manifests and imports, by priority of the source."""
    c, path = F.col("content"), F.col("path")
    ex = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))

    def req(name):
        line = F.regexp_extract(c, rf"(?m)^[^\n]*{name}[^\n]*(?:==|>=)[^\n]*$", 0)
        exact, least = F.regexp_extract(line, "==(.*?)(?:==|$)", 1), F.regexp_extract(line, ">=(.*?)(?:>=|$)", 1)
        return F.when(line.contains("=="), F.trim(exact)).when(line.contains(">="), F.concat(F.lit(">="), F.trim(least)))

    def pkg(name):
        return ex(rf'"{name}":\s*"([^"]+)"')

    rows = [
        ("Flask", 1, path == "requirements.txt", req("Flask")), ("FastAPI", 1, path == "requirements.txt", req("fastapi")),
        ("React", 1, path == "package.json", pkg("react")), ("NestJS", 1, path == "package.json", pkg("@nestjs/core")), ("NextJS", 1, path == "package.json", pkg("next")),
        ("SpringBoot", 1, path == "pom.xml", ex(r"<groupId>org\.springframework\.boot</groupId>\s*<artifactId>[^<]*</artifactId>\s*<version>([^<]+)</version>")),
        ("SpringBoot", 2, path == "build.gradle", ex(r"""['"]org\.springframework\.boot[^'"]+'([^'"]+)['"]""")),
        ("Danet", 1, F.col("ext") == "ts", ex(r"jsr:@danet/core@(\d+\.\d+\.\d+)")), ("Danet", 2, path == "deno.json", ex(r"jsr:@danet/core@(\d+\.\d+\.\d+)")),
    ]
    found = F.array_compact(F.array(*[
        F.when(scope & v.isNotNull(), F.struct(F.lit(fw).alias("framework"), F.lit(rank).alias("rank"), F.trim(v).alias("version"))) for fw, rank, scope, v in rows
    ]))
    in_scope = path.isin("requirements.txt", "package.json", "pom.xml", "build.gradle", "deno.json") | (F.col("ext") == "ts")
    return (
        files.where(in_scope).select("repo", "path", F.explode(found).alias("v"))
        .groupBy("repo", "v.framework").agg(F.min(F.struct("v.rank", "path", "v.version")).alias("m")).select("repo", "framework", "m.version")
    )


@operator("frameworks.evaluate")
def evaluate(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision, recall (1 when undefined) and F1 per label from (key, label) pairs."""
    e = expected.select("key", "label").distinct().withColumn("e", F.lit(True))
    p = predicted.select("key", "label").distinct().withColumn("p", F.lit(True))
    n = F.count_if
    out = e.join(p, ["key", "label"], "full").groupBy("label").agg(
        n(F.col("e") & F.col("p")).alias("tp"), n(F.col("e").isNull()).alias("fp"), n(F.col("p").isNull()).alias("fn")
    )
    tp = F.col("tp")
    return out.select(
        "label", "tp", "fp", "fn",
        F.when(tp + F.col("fp") == 0, 1.0).otherwise(tp / (tp + F.col("fp"))).alias("precision"),
        F.when(tp + F.col("fn") == 0, 1.0).otherwise(tp / (tp + F.col("fn"))).alias("recall"),
    ).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


@operator("frameworks.confidence_map")
def confidence_map(conf: DataFrame) -> DataFrame:
    """One map per repository; frameworks are a fixed list, so the map is small."""
    pairs = F.array_sort(F.collect_list(F.struct("framework", "confidence")))
    return conf.groupBy("repo").agg(F.map_from_entries(pairs).alias("confidences"))


@operator("frameworks.route_analyzer")
def route_analyzer(flagged: DataFrame, entity_repos: DataFrame) -> DataFrame:
    """Analyzer that would take the project, in order, and the server's project type."""
    f = lambda t: formula_column(t, F.col("flags"))
    react, pom = f(W.inside("package.json", '"react"')), f(W.inside("pom.xml", "spring-boot"))
    gradle, has_pom = f(W.inside("build.gradle", "spring-boot")), f(W.file("pom.xml"))
    java = F.when(has_pom, pom).otherwise(gradle)
    python = f(W.file("manage.py")) | f(W.file("app.py")) | f(W.inside("requirements.txt", "django", "flask"))
    kind = (
        F.when(react, "React").when(pom | gradle, "SpringBoot").when(f(W.file("manage.py", "settings.py")), "Django")
        .when(f(W.file("app.py", "wsgi.py")), "Flask").otherwise("React")
    )
    crud = entity_repos.select("repo").distinct().withColumn("crud", F.lit(True))
    return flagged.join(crud, "repo", "left").select(
        "repo", F.when(react, "TypeScript").when(java, "Java").when(python, "Python").otherwise("TypeScript").alias("analyzer"), kind.alias("project_type"),
        F.coalesce("crud", F.lit(False)).alias("crud"),
    )
