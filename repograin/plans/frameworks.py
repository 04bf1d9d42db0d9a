"""Queries on frameworks and analyzer routing."""

from pyspark.sql import functions as F

from repograin.functions.scores import r6
from repograin.operators import frameworks as fw_ops
from repograin.operators.frameworks import _LEAF, PROBES
from repograin.plans import status as status_plan  # noqa: F401
from repograin.plans.base import case_map, cte, frame, has_any, hit_list, q, query, rnd
from repograin.plans.corpus_ctes import IGNORED
from repograin.rules import frameworks as W
from repograin.session import cut_lineage
from repograin.sources.code_corpus import REPO_NO_SQL, REPO_SQL


@frame("flags")
def _(c):
    return cut_lineage(fw_ops.flags(c.repos, c.files))


@frame("ecosystem")
def _(c):
    return fw_ops.ecosystem(c.repos, c.files, c.flags)


@frame("fw_evidence")
def _(c):
    return fw_ops.evidence(c.flags)


@frame("fw_confidence")
def _(c):
    return fw_ops.confidence(fw_ops.raw_scores(c.fw_evidence), c.flags)


def _probe_sql(p) -> str:
    kind = p[0]
    ins = lambda xs: ", ".join(q(x) for x in xs)
    if kind == "words":
        return f"lower(ext) IN ({ins(p[1])}) AND {has_any('content', p[2])}"
    if kind == "pruned":
        return f"ext IN ({ins(p[1])}) AND NOT list_has_any(string_split(path, '/')[1:-2], {IGNORED}) AND {has_any('content', p[2])}"
    if kind == "in":
        return f"path = {q(p[1])} AND {has_any('content', p[2])}"
    if kind == "file":
        return f"path IN ({ins(p[1])})"
    if kind == "dir":
        return "(" + " OR ".join(f"starts_with(path, {q(d + '/')})" for d in p[1]) + ")"
    if kind == "ext":
        return f"ext IN ({ins(p[1])})"
    if kind == "suffix":
        return f"ends_with(path, {q(p[1])}) AND {has_any('content', p[2])}"
    near = f"len(string_split(path, '/')) <= {p[1]} AND ext IN ({ins(p[2])})"
    return f"{near} AND {has_any('content', p[3])}" if p[3] else f"{near} AND NOT contains(path, 'node_modules')"


def formula_sql(f) -> str:
    if f[0] in _LEAF:
        return f"list_contains(flags, {PROBES.index(f)})"
    parts = [formula_sql(x) for x in f[1:]]
    return f"(NOT {parts[0]})" if f[0] == "not" else "(" + (" OR " if f[0] == "any" else " AND ").join(parts) + ")"


def _sum_sql(parts) -> str:
    return "(" + " + ".join(f"CASE WHEN {formula_sql(t)} THEN {w} ELSE 0 END" for w, t in parts) + ")"


cte(
    "flags",
    f"SELECT repo, coalesce(f, []) AS flags FROM repos LEFT JOIN (SELECT repo, list(DISTINCT p) AS f FROM (SELECT repo, unnest({hit_list([_probe_sql(p) for p in PROBES])}) AS p FROM files) GROUP BY repo) USING (repo)",
)
_N = lambda *exts: f"count(*) FILTER (ext IN ({', '.join(q(e) for e in exts)}))"
cte("ext_counts", f"SELECT repo, {_N('py')} AS py, {_N('ts', 'tsx')} AS ts, {_N('js')} AS js, {_N('js', 'jsx')} AS jsx, {_N('java')} AS java, {_N('rs')} AS rs FROM pruned_files GROUP BY repo")


def _eco_sql(options):
    union = " UNION ALL ".join(f"SELECT repo, {name} AS name, {pts} AS pts FROM ext_counts JOIN flags USING (repo) WHERE {pts} > 0 AND {cond}" for name, pts, cond in options)
    return f"SELECT repo, coalesce(name, 'Mixed') AS ecosystem, coalesce(pts, 0) AS score FROM repos LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY pts DESC, name) AS k FROM ({union})) USING (repo) WHERE coalesce(k, 1) = 1"


_DENO = formula_sql(("any", W.file("deno.json"), W.URL_IMPORTS))
cte("ecosystem", _eco_sql([("'Python'", "py * 10", "TRUE"), (f"CASE WHEN {_DENO} THEN 'Deno' ELSE 'TypeScript' END", "ts * 10", "TRUE"), ("'JavaScript'", "js * 10", "NOT " + formula_sql(W.file("tsconfig.json"))), ("'Java'", "java * 10", "TRUE")]))


@query("f1_language_ecosystem", "SELECT repo, ecosystem, score FROM ecosystem")
def _(c):
    return c.ecosystem


@query("f1_language_ecosystem_enhanced", _eco_sql([("'Python'", "py * 10", "TRUE"), ("'TypeScript'", "ts * 10", "TRUE"), ("'JavaScript'", "jsx * 8", "TRUE"), ("'Java'", "java * 10", "TRUE"), ("'Rust'", "rs * 10", "TRUE")]))
def _(c):
    return fw_ops.ecosystem(c.repos, c.files, c.flags, enhanced=True)


cte(
    "fw_evidence",
    " UNION ALL ".join(
        f"SELECT repo, {q(fw)} AS framework, {i} AS rule, {'NULL' if kind is None else q(kind)} AS evidence_type, {q(src)} AS source, {q(pat)} AS pattern, {_sum_sql(parts)} AS points FROM flags"
        + f" WHERE {_sum_sql(parts)} > 0" + (f" AND {formula_sql(W.GATES[fw])}" if fw in W.GATES else "")
        for i, (fw, kind, src, pat, parts) in enumerate(W.BASIC)
    ),
)
_Q = case_map("evidence_type", W.QUALITY, "0")
cte(
    "fw_raw",
    f"""SELECT repo, framework, CAST(sum(points) AS BIGINT) AS points, count(evidence_type) AS n_evidence, CAST(sum(CASE WHEN evidence_type IS NULL THEN 0 ELSE points * {_Q} END) AS BIGINT) AS quality_points,
        count(DISTINCT evidence_type) AS n_types FROM fw_evidence GROUP BY repo, framework""",
)
_KEEP = " OR ".join(f"(framework = '{f}' AND points {'>=' if inc else '>'} {b})" for f, (b, inc) in W.THRESHOLDS.items())
_ADJ = "CASE " + " ".join(f"WHEN framework = '{f}' AND {formula_sql(t)} THEN {v!r}::DOUBLE" for f, (v, t) in W.CROSS.items()) + " ELSE 1e0 END"
_DIV = case_map("n_types", W.DIVERSITY, str(W.DIVERSITY_NONE)) + "::DOUBLE"
_EXT = lambda steps: "CASE " + " ".join(f"WHEN confidence >= {b}::DOUBLE THEN '{n}'" for b, n in steps) + f" ELSE '{W.LOWEST_EXTENT}' END"
cte(
    "fw_confidence",
    f"""SELECT *, {_EXT(W.EXTENT_BASIC)} AS extent FROM (SELECT repo, framework, points, n_evidence, n_types, {rnd("weighted")} AS weighted, {rnd("factor")} AS factor,
        {rnd(f"CASE WHEN framework IN ({', '.join(q(x) for x in W.WEIGHTED)}) THEN least(weighted * factor, 1e0) ELSE least(points, 100) / 100e0 END")} AS confidence FROM
        (SELECT *, CASE WHEN n_evidence = 0 THEN 0e0 ELSE least(quality_points / (n_evidence * 1000e0), 1e0) END AS weighted, {_ADJ} * {_DIV} AS factor FROM fw_raw JOIN flags USING (repo) WHERE {_KEEP}))""",
)


@query("f2_framework_evidence", "SELECT repo, framework, rule, evidence_type, source, pattern, points FROM fw_evidence")
def _(c):
    return c.fw_evidence


@query("f4_detection_threshold", f"SELECT repo, framework, points FROM fw_raw WHERE {_KEEP}")
def _(c):
    return fw_ops.detected(fw_ops.raw_scores(c.fw_evidence)).select("repo", "framework", "points")


@query("f5_quality_weighted_confidence", "SELECT repo, framework, n_evidence, weighted FROM fw_confidence")
def _(c):
    return c.fw_confidence.select("repo", "framework", "n_evidence", "weighted")


@query("f6_cross_validation_factor", "SELECT repo, framework, n_types, factor FROM fw_confidence")
def _(c):
    return c.fw_confidence.select("repo", "framework", "n_types", "factor")


@query("p5_score_buckets", "SELECT framework, extent, count(*) AS n FROM fw_confidence GROUP BY ALL")
def _(c):
    return c.fw_confidence.groupBy("framework", "extent").agg(F.count("*").alias("n"))


_PACK = " OR ".join(f"(ecosystem = '{e}' AND framework = '{f}')" for e, fs in W.PACKS.items() for f in fs)
cte("dispatched", f"SELECT repo, framework, confidence, extent, ecosystem FROM fw_confidence JOIN ecosystem USING (repo) WHERE {_PACK}")


@frame("dispatched")
def _(c):
    return cut_lineage(fw_ops.dispatch(c.fw_confidence, c.ecosystem).select("repo", "framework", "confidence", "extent", "ecosystem"))


@query("f14_ecosystem_dispatch", "SELECT * FROM dispatched")
def _(c):
    return c.dispatched


_F = W.FRAMEWORKS
_WIDE = "SELECT repo, " + ", ".join(f"max(confidence) FILTER (framework = '{f}') AS {f}" for f in _F) + " FROM fw_confidence GROUP BY repo"
cte("fw_wide", _WIDE)
cte(
    "fw_served",
    "SELECT repo, " + ", ".join(f"CASE WHEN {formula_sql(W.API_PATTERNS)} THEN least({f} * 1.05::DOUBLE, 1e0) ELSE {f} END AS {f}" if f in W.SERVER_FRAMEWORKS else f for f in _F) + " FROM fw_wide JOIN flags USING (repo)",
)


def _settle(src):
    cols = {f: f for f in _F}
    for a, b in W.CONFLICTING:
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        cols[a] = f"CASE WHEN {both} AND {a} < {b} THEN {a} * 0.7::DOUBLE ELSE {a} END"
        cols[b] = f"CASE WHEN {both} AND NOT ({a} < {b}) THEN {b} * 0.7::DOUBLE ELSE {b} END"
    return "SELECT repo, " + ", ".join(f"{x} AS {f}" for f, x in cols.items()) + f" FROM {src}"


def _stack(src):
    cols = {f: f for f in _F}
    up = lambda x: f"least(({x}) * 1.1::DOUBLE, 1e0)"
    for a, b in W.FULLSTACK_PAIRS:
        if a in cols and b in cols:
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            cols[a], cols[b] = f"CASE WHEN {both} THEN {up(cols[a])} ELSE {cols[a]} END", f"CASE WHEN {both} THEN {up(cols[b])} ELSE {cols[b]} END"
    # DuckDB's least() skips nulls, so an absent framework stays absent by a guard.
    return "SELECT repo, " + ", ".join(f"CASE WHEN {f} IS NULL THEN NULL ELSE {up(x) if f == 'NextJS' else x} END AS {f}" for f, x in cols.items()) + f" FROM {src}"


def _unpivot(src):
    return " UNION ALL ".join(f"SELECT repo, '{f}' AS framework, {rnd(f)} AS confidence FROM {src} WHERE {f} IS NOT NULL" for f in _F)


cte("fw_served_ok", "SELECT repo, " + ", ".join(f"CASE WHEN w.{f} IS NULL THEN NULL ELSE s.{f} END AS {f}" for f in _F) + " FROM fw_served AS s JOIN fw_wide AS w USING (repo)")
cte("fw_settled", _settle("fw_served_ok"))
cte("fw_adjusted", _stack("fw_settled"))
cte("fw_only_settled", _settle("fw_wide"))
cte("fw_only_stacked", _stack("fw_wide"))


@query("f7_conflict_pairs", _unpivot("fw_only_settled"))
def _(c):
    return fw_ops.conflicts(c.fw_confidence)


@query("f8_stack_boosts", _unpivot("fw_only_stacked"))
def _(c):
    return fw_ops.stacks(c.fw_confidence)


@query("f8_mixed_adjustment", _unpivot("fw_adjusted"))
def _(c):
    return fw_ops.cross_adjust(c.fw_confidence, c.flags)


_BY = {}
for _fw, _w, _t in W.ENHANCED:
    _BY.setdefault(_fw, []).append((_w, _t))
cte(
    "fw_enhanced",
    f"SELECT repo, framework, points, rules, points / 100e0 AS confidence, {_EXT(W.EXTENT_ENHANCED).replace('confidence', '(points / 100e0)')} AS extent FROM ("
    + " UNION ALL ".join(
        f"SELECT repo, '{f}' AS framework, CASE WHEN r >= 3 THEN least(p, 95) WHEN r = 2 THEN least(p, 80) ELSE p END AS points, r AS rules FROM (SELECT repo, {_sum_sql(ps)} AS p, {_sum_sql([(1, t) for _, t in ps])} AS r FROM flags)"
        for f, ps in _BY.items()
    )
    + "".join(f" UNION ALL SELECT repo, '{f}', {W.RUST_POINTS}, 1 FROM flags WHERE {formula_sql(t)}" for f, t in W.RUST)
    + ") WHERE points > 30",
)


@frame("fw_enhanced")
def _(c):
    return fw_ops.enhanced(c.flags)


@query("f3_enhanced_rule_packs", "SELECT * FROM fw_enhanced")
def _(c):
    return c.fw_enhanced


_LINE = lambda name: f"regexp_extract(content, '(?m)^[^\\n]*{name}[^\\n]*(?:==|>=)[^\\n]*$')"
_REQ = lambda name: f"CASE WHEN contains({_LINE(name)}, '==') THEN trim(split_part({_LINE(name)}, '==', 2)) WHEN contains({_LINE(name)}, '>=') THEN concat('>=', trim(split_part({_LINE(name)}, '>=', 2))) END"
_PKG = lambda name: f"nullif(regexp_extract(content, '\"{name}\":\\s*\"([^\"]+)\"', 1), '')"
_JSR = "nullif(regexp_extract(content, 'jsr:@danet/core@(\\d+\\.\\d+\\.\\d+)', 1), '')"
_VROWS = [
    ("Flask", 1, "path = 'requirements.txt'", _REQ("Flask")), ("FastAPI", 1, "path = 'requirements.txt'", _REQ("fastapi")), ("React", 1, "path = 'package.json'", _PKG("react")),
    ("NestJS", 1, "path = 'package.json'", _PKG("@nestjs/core")), ("NextJS", 1, "path = 'package.json'", _PKG("next")),
    ("SpringBoot", 1, "path = 'pom.xml'", "nullif(regexp_extract(content, '<groupId>org\\.springframework\\.boot</groupId>\\s*<artifactId>[^<]*</artifactId>\\s*<version>([^<]+)</version>', 1), '')"),
    ("Danet", 1, "ext = 'ts'", _JSR), ("Danet", 2, "path = 'deno.json'", _JSR),
]


@query(
    "f9_framework_version",
    "SELECT repo, framework, version FROM (SELECT *, row_number() OVER (PARTITION BY repo, framework ORDER BY rank, path) AS k FROM ("
    + " UNION ALL ".join(f"SELECT repo, path, '{f}' AS framework, {r} AS rank, trim({v}) AS version FROM files WHERE {s}" for f, r, s, v in _VROWS) + ") WHERE version IS NOT NULL) WHERE k = 1",
)
def _(c):
    return fw_ops.versions(c.files)


@query(
    "f11_danet_detail",
    f"""SELECT repo, p + 10 * n AS points, r + n AS evidence, p + 10 * n > {W.DANET_PROJECT_POINTS} AS is_danet_project FROM (SELECT repo, {_sum_sql([(w, t) for _, w, t in W.DANET_DETAIL])} AS p, {_sum_sql([(1, t) for _, w, t in W.DANET_DETAIL])} AS r,
        (SELECT count(*) FROM files AS f WHERE f.repo = g.repo AND len(string_split(path, '/')) <= 3 AND ext IN ('ts', 'js') AND contains(content, {q(W.URL_IMPORT_WORD)})) AS n FROM flags AS g)""",
)
def _(c):
    return fw_ops.danet_detail(c.flags, c.files)


_NAMES = "[" + ", ".join(f"CASE WHEN {formula_sql(t)} THEN {q(n)} END" for n, t in W.NAMED) + "]"


@query(
    "f12_architecture_pattern",
    f"SELECT repo, array_to_string(names, ',') AS names, CASE {' '.join(f'WHEN list_contains(names, {q(n)}) THEN {q(a)}' for n, a in W.ARCHITECTURES)} ELSE {q(W.DEFAULT_ARCHITECTURE)} END AS architecture FROM (SELECT repo, list_filter({_NAMES}, lambda x: x IS NOT NULL) AS names FROM flags)",
)
def _(c):
    return fw_ops.architecture(c.flags).withColumn("names", F.array_join("names", ","))


_EXPECTED = f"SELECT DISTINCT {REPO_SQL} AS key, CASE {REPO_NO_SQL} % 6 WHEN 0 THEN 'Flask' WHEN 1 THEN 'React' WHEN 2 THEN 'SpringBoot' WHEN 4 THEN 'Danet' ELSE 'FastAPI' END AS label FROM documents"
_EVAL = """SELECT label, tp, fp, fn, precision, recall, CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (SELECT label, tp, fp, fn,
    CASE WHEN tp + fp = 0 THEN 1e0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn = 0 THEN 1e0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall FROM
    (SELECT coalesce(e.label, p.label) AS label, count(*) FILTER (e.key IS NOT NULL AND p.key IS NOT NULL) AS tp, count(*) FILTER (e.key IS NULL) AS fp, count(*) FILTER (p.key IS NULL) AS fn
     FROM ({e}) AS e FULL JOIN ({p}) AS p ON e.key = p.key AND e.label = p.label GROUP BY 1))"""
_ROUND = "SELECT label, tp, fp, fn, " + ", ".join(f"{rnd(x)} AS {x}" for x in ("precision", "recall", "f1")) + " FROM ({})"


def _rounded(df):
    return df.select("label", "tp", "fp", "fn", *[r6(F.col(x)).alias(x) for x in ("precision", "recall", "f1")])


@query("f13_detection_evaluation", _ROUND.format(_EVAL.replace("{e}", _EXPECTED).replace("{p}", "SELECT repo AS key, framework AS label FROM fw_confidence")))
def _(c):
    eco = F.expr(f"{REPO_NO_SQL} % 6")
    label = F.when(eco == 0, "Flask").when(eco == 1, "React").when(eco == 2, "SpringBoot").when(eco == 4, "Danet").otherwise("FastAPI")
    expected = c.table("documents").select(F.expr(REPO_SQL).alias("key"), label.alias("label")).distinct()
    return _rounded(fw_ops.evaluate(expected, c.fw_confidence.select(F.col("repo").alias("key"), F.col("framework").alias("label"))))


@query(
    "f13_label_evaluation",
    _ROUND.format(_EVAL.replace("{e}", "SELECT doc_id AS key, 'quality' AS label FROM labels WHERE quality = 1").replace("{p}", "SELECT doc_id AS key, 'quality' AS label FROM documents JOIN labels USING (doc_id) WHERE len(list_distinct(string_split(text, ' '))) >= 40")),
)
def _(c):
    labels = c.table("labels")
    expected = labels.where("quality = 1").select(F.col("doc_id").alias("key"), F.lit("quality").alias("label"))
    varied = F.size(F.array_distinct(F.split("text", " "))) >= 40  # a guess from the text: many different words
    guess = c.table("documents").where(varied).select("doc_id").join(labels.select("doc_id"), "doc_id", "left_semi")
    return _rounded(fw_ops.evaluate(expected, guess.select(F.col("doc_id").alias("key"), F.lit("quality").alias("label"))))


@query("f15_composite_predicates", "SELECT repo, " + ", ".join(f"{formula_sql(t)} AS {n}" for n, t in W.COMPOSITES.items()) + " FROM flags")
def _(c):
    return fw_ops.composites(c.flags)


@query("f16_evidence_listing", " UNION ALL ".join(f"SELECT repo, {q(f)} AS framework, {q(k)} AS evidence_type, {q(s)} AS source, {q(p)} AS pattern, {w / 100!r}::DOUBLE AS weight FROM flags WHERE {formula_sql(t)}" for f, k, s, p, w, t in W.LISTED))
def _(c):
    return fw_ops.listed_evidence(c.flags)


@query("f18_confidence_map", "SELECT repo, string_agg(concat(framework, '=', CAST(CAST(round(confidence * 1000000) AS BIGINT) AS VARCHAR)), ',' ORDER BY framework) AS confidences FROM fw_confidence GROUP BY repo")
def _(c):
    m = F.map_entries("confidences")
    text = F.transform(m, lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 1000000).cast("bigint").cast("string")))
    return fw_ops.confidence_map(c.fw_confidence).select("repo", F.array_join(F.array_sort(text), ",").alias("confidences"))


_f = formula_sql


@query(
    "g7_analyzer_routing",
    f"""SELECT repo, CASE WHEN {_f(W.inside("package.json", '"react"'))} THEN 'TypeScript' WHEN CASE WHEN {_f(W.file("pom.xml"))} THEN {_f(W.inside("pom.xml", "spring-boot"))} ELSE {_f(W.inside("build.gradle", "spring-boot"))} END THEN 'Java'
        WHEN {_f(W.file("manage.py"))} OR {_f(W.file("app.py"))} OR {_f(W.inside("requirements.txt", "django", "flask"))} THEN 'Python' ELSE 'TypeScript' END AS analyzer,
        CASE WHEN {_f(W.inside("package.json", '"react"'))} THEN 'React' WHEN {_f(W.inside("pom.xml", "spring-boot"))} OR {_f(W.inside("build.gradle", "spring-boot"))} THEN 'SpringBoot' WHEN {_f(W.file("manage.py", "settings.py"))} THEN 'Django'
        WHEN {_f(W.file("app.py", "wsgi.py"))} THEN 'Flask' ELSE 'React' END AS project_type, repo IN (SELECT repo FROM entities) AS crud FROM flags""",
)
def _(c):
    return fw_ops.route_analyzer(c.flags, c.entities)
