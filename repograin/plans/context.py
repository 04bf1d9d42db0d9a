"""Queries on the module graph, fusion and grounding."""

from pyspark.sql import functions as F

from repograin.functions.scores import r6
from repograin.operators import cycles, fusion, graph, grounding, imports
from repograin.plans import domains as domains_plan  # noqa: F401
from repograin.plans.base import case_any, case_map, cte, frame, has_any, q, query, rnd, values
from repograin.rules import code as K
from repograin.rules import context as X
from repograin.session import cut_lineage


@frame("mentions")
def _(c):
    return cut_lineage(graph.mentions(c.segments))


@frame("resolved")
def _(c):
    return cut_lineage(imports.resolve(c.files, imports.specs(c.files)))


@frame("edges")
def _(c):
    return cut_lineage(graph.edges(c.mentions, c.resolved, c.segments))


@frame("functional")
def _(c):
    return graph.import_edges(c.components)


@frame("contexts")
def _(c):
    return cut_lineage(graph.contexts(c.segments, c.mentions))


@frame("projects")
def _(c):
    n = c.adjusted_domains.groupBy("repo").agg(F.count("*").alias("n_domains"))
    return cut_lineage(c.profile.select("repo", F.col("confidence").alias("project_confidence"), "entry_points", "n_deps").join(n, "repo", "left"))


@frame("fused")
def _(c):
    return cut_lineage(fusion.fuse_segments(c.contexts, c.projects))


@frame("tier1")
def _(c):
    return fusion.tier1(c.repos, c.detected)


@frame("detected")
def _(c):
    return cut_lineage(c.dispatched.join(c.fw_confidence.select("repo", "framework", "n_evidence"), ["repo", "framework"]))


@frame("kw")
def _(c):
    return cut_lineage(grounding.evidence(c.segments))


@frame("names")
def _(c):
    return cut_lineage(grounding.grounded_names(c.adjusted_domains))


@frame("totals")
def _(c):
    return cut_lineage(grounding.totals(c.repos, c.kw, c.contexts))


@frame("terms")
def _(c):
    return grounding.term_hits(c.names, c.totals)


@frame("insights")
def _(c):
    return grounding.insights(c.names, c.totals, c.kw, c.terms)


@frame("relations")
def _(c):
    return grounding.relations(c.insights, c.terms)


@frame("grounded")
def _(c):
    return cut_lineage(grounding.grounded(c.insights, grounding.validate(c.insights), c.totals))


@frame("tier3")
def _(c):
    return grounding.validate(c.insights).groupBy("repo").agg(r6(F.sum("validation") / F.count("*")).alias("tier3_confidence"))


_MOD = "lower(regexp_replace(string_split(path, '/')[-1], '^(.+)[.][^.]*$', '\\1'))"
cte("seg_mod", f"SELECT *, {_MOD} AS module FROM segments")
cte("mentions", "SELECT s.repo, s.segment_id, s.module, n.module AS target FROM seg_mod AS s JOIN (SELECT DISTINCT repo, module FROM seg_mod WHERE module <> '') AS n ON n.repo = s.repo AND n.module <> s.module AND contains(s.low, n.module)")
_FOUND = f"""CASE language WHEN 'typescript' THEN regexp_extract_all(content, {q(K.TS_IMPORT)}, 1) WHEN 'python' THEN list_transform(list_zip(regexp_extract_all(content, {q(K.PY_IMPORT)}, 1), regexp_extract_all(content, {q(K.PY_IMPORT)}, 2)),
    lambda p: CASE WHEN p[1] <> '' THEN p[1] ELSE p[2] END) ELSE regexp_extract_all(content, {q(K.JAVA_IMPORT)}, 1) END"""
_NO_EXT = lambda x: f"regexp_replace({x}, '[.](py|js|jsx|ts|tsx|java)$', '')"
_DOTTED = "list_filter(string_split(ltrim(spec, '.'), '.'), lambda p: p <> '')"
cte(  # steps of a relative import: a number of folders up, and names that hold no further dots
    "import_specs",
    f"""SELECT repo, path, spec, relative, CASE WHEN relative THEN list_concat(dir[1:greatest(len(dir) - up, 0)], names) ELSE names END AS parts FROM (
        SELECT *, string_split(path, '/')[1:-2] AS dir, CASE WHEN NOT relative THEN 0 WHEN language = 'typescript' THEN len(list_filter(string_split(spec, '/'), lambda p: p = '..')) ELSE length(spec) - length(ltrim(spec, '.')) - 1 END AS up,
          CASE WHEN language = 'typescript' THEN list_filter(string_split({_NO_EXT("spec")}, '/'), lambda p: p NOT IN ('', '.', '..')) ELSE {_DOTTED} END AS names
        FROM (SELECT repo, path, language, spec, starts_with(spec, '.') AS relative FROM (SELECT DISTINCT repo, path, language, unnest({_FOUND}) AS spec FROM seg_files)))
        WHERE len(parts) > 0""",
)
cte(
    "path_parts",
    f"""SELECT repo, path, CASE WHEN len(p) > 1 AND p[-1] IN ('index', '__init__') THEN p[1:-2] ELSE p END AS parts FROM (SELECT repo, path, string_split({_NO_EXT("path")}, '/') AS p FROM seg_files)""",
)
cte(
    "resolved",
    """SELECT i.repo, i.path, i.spec, arg_max(f.path, {'n': coalesce(x.n, 0), 'd': -len(f.parts)}) AS target, nullif(max(x.n), 0) / CAST(max(len(i.parts)) AS DOUBLE) AS strength FROM import_specs AS i
       LEFT JOIN path_parts AS f ON f.repo = i.repo AND f.parts[-1] = i.parts[-1] AND (NOT i.relative OR f.parts = i.parts)
         AND 2 * list_max(list_transform(range(1, least(len(f.parts), len(i.parts)) + 1), lambda k: CASE WHEN f.parts[-k:] = i.parts[-k:] THEN k ELSE 0 END)) >= len(i.parts)
       LEFT JOIN LATERAL (SELECT list_max(list_transform(range(1, least(len(f.parts), len(i.parts)) + 1), lambda k: CASE WHEN f.parts[-k:] = i.parts[-k:] THEN k ELSE 0 END)) AS n) AS x ON TRUE
       GROUP BY i.repo, i.path, i.spec""",
)
_STEM = lambda x: f"lower(regexp_replace(string_split({x}, '/')[-1], '^(.+)[.][^.]*$', '\\1'))"
cte(
    "edges",
    f"""SELECT repo, src, dst, 'import' AS ref_type, {rnd("max(strength)")} AS strength, count(*) AS refs FROM (SELECT repo, {_STEM("path")} AS src, {_STEM("target")} AS dst, path = target AS own, strength FROM resolved WHERE target IS NOT NULL)
        WHERE src <> dst OR own GROUP BY repo, src, dst
        UNION ALL SELECT repo, module, target, 'mention', {rnd("count(*) / CAST(any_value(n) AS DOUBLE)")}, count(*) FROM mentions JOIN (SELECT repo, module, count(*) AS n FROM seg_mod GROUP BY ALL) USING (repo, module) GROUP BY repo, module, target""",
)
cte("functional", "SELECT DISTINCT repo, src, dst FROM (SELECT repo, lower(name) AS src, lower(string_split_regex(i, '[/.]')[-1]) AS dst FROM (SELECT repo, name, unnest(imports) AS i FROM components)) WHERE dst <> ''")


@query("h1_edge_inference", "SELECT repo, src, dst, ref_type, strength, refs FROM edges")
def _(c):
    return c.edges


@query("h1_resolved_imports", f"SELECT repo, path, spec, target, {rnd('strength')} AS strength FROM resolved")
def _(c):
    return c.resolved


@query("h2_related_modules", "SELECT repo, src AS module, dst AS related FROM edges UNION SELECT repo, dst, src FROM edges")
def _(c):
    return graph.related(c.edges)


@query("h3_missing_references", f"SELECT DISTINCT repo, {_STEM('path')} AS src, spec FROM resolved WHERE target IS NULL")
def _(c):
    return graph.missing(c.resolved)


@query("h4_orphans", """SELECT repo, segment_id FROM segments AS s WHERE NOT EXISTS (SELECT 1 FROM mentions AS m WHERE m.repo = s.repo AND m.segment_id = s.segment_id)
    AND NOT EXISTS (SELECT 1 FROM resolved AS r WHERE r.repo = s.repo AND r.path = s.path AND r.target IS NOT NULL)""")
def _(c):
    return graph.orphans(c.contexts, c.mentions, c.resolved)


cte("module_links", "SELECT DISTINCT repo, src, dst FROM edges")
cte("reach", "SELECT repo, src, dst FROM module_links UNION SELECT r.repo, r.src, l.dst FROM reach AS r JOIN module_links AS l ON l.repo = r.repo AND l.src = r.dst")
cte("in_cycles", "SELECT a.repo, a.src AS node, min(a.dst) AS component FROM reach AS a JOIN reach AS b ON b.repo = a.repo AND b.src = a.dst AND b.dst = a.src GROUP BY a.repo, a.src")
cte("rings", "SELECT repo, component, count(*) AS modules FROM in_cycles GROUP BY ALL HAVING count(*) > 1")
cte("ring_links", "SELECT l.repo, a.component, l.src, l.dst FROM module_links AS l JOIN in_cycles AS a ON a.repo = l.repo AND a.node = l.src JOIN in_cycles AS b ON b.repo = l.repo AND b.node = l.dst AND b.component = a.component WHERE l.src <> l.dst")
cte("ring_ways", "SELECT repo, component, component AS node, 0 AS level FROM rings UNION SELECT w.repo, w.component, l.dst, w.level + 1 FROM ring_ways AS w JOIN ring_links AS l ON l.repo = w.repo AND l.component = w.component AND l.src = w.node JOIN rings AS r ON r.repo = w.repo AND r.component = w.component WHERE w.level + 1 < r.modules")
cte("ring_levels", "SELECT repo, component, node, min(level) AS level FROM ring_ways GROUP BY ALL")
cte("ring_ends", "SELECT v.repo, v.component, min({'level': v.level, 'node': v.node}) AS last FROM ring_levels AS v JOIN ring_links AS l ON l.repo = v.repo AND l.component = v.component AND l.src = v.node AND l.dst = v.component GROUP BY ALL")
cte("ring_parents", "SELECT v.repo, v.component, v.node, v.level, min(p.node) AS parent FROM ring_levels AS v JOIN ring_links AS l ON l.repo = v.repo AND l.component = v.component AND l.dst = v.node JOIN ring_levels AS p ON p.repo = v.repo AND p.component = v.component AND p.node = l.src AND p.level = v.level - 1 GROUP BY ALL")
cte("ring_walks", "SELECT repo, component, last.node AS node, last.level AS level, last.level + 1 AS length, last.node AS cycle FROM ring_ends UNION ALL SELECT w.repo, w.component, p.parent, p.level - 1, w.length, concat(p.parent, '>', w.cycle) FROM ring_walks AS w JOIN ring_parents AS p ON p.repo = w.repo AND p.component = w.component AND p.node = w.node")


@query("h5_cycles", "SELECT repo, component, modules, length, cycle FROM ring_walks JOIN rings USING (repo, component) WHERE level = 0 UNION ALL SELECT repo, src, 1, 1, src FROM module_links WHERE src = dst")
def _(c):
    return cycles.witnesses(c.edges.select("repo", "src", "dst").distinct(), ["repo"])


@query(
    "h5_short_cycles",
    """SELECT a.repo, 2 AS length, concat_ws('>', a.src, a.dst) AS cycle FROM module_links AS a JOIN module_links AS b ON b.repo = a.repo AND b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
       UNION ALL SELECT a.repo, 3, concat_ws('>', a.src, a.dst, b.dst) FROM module_links AS a JOIN module_links AS b ON b.repo = a.repo AND b.src = a.dst JOIN module_links AS d ON d.repo = a.repo AND d.src = b.dst AND d.dst = a.src WHERE a.src < a.dst AND a.src < b.dst""",
)
def _(c):
    return graph.short_cycles(c.edges.select("repo", "src", "dst").distinct())


@query(
    "h6_reference_consistency",
    f"""SELECT repo, coalesce(t, 0) AS total, coalesce(v, 0) AS valid, {rnd("coalesce(v / CAST(t AS DOUBLE), 1e0)")} AS consistency FROM repos LEFT JOIN
        (SELECT f.repo, count(*) AS t, count(k.n) AS v FROM functional AS f LEFT JOIN (SELECT DISTINCT repo, lower(name) AS n FROM components) AS k ON k.repo = f.repo AND k.n = f.dst GROUP BY f.repo) USING (repo)""",
)
def _(c):
    return graph.consistency(c.repos, c.functional, c.components)


cte(
    "contexts",
    f"""SELECT s.repo, s.segment_id, s.path, s.module, s.segment_type, s.framework, s.hints, {case_any("low", X.PURPOSES, None)} AS purpose, {X.SEGMENT_CONFIDENCE} AS points, coalesce(o.deps, 0) AS deps, coalesce(i.dependents, 0) AS dependents FROM seg_mod AS s
        LEFT JOIN (SELECT repo, segment_id, count(*) AS deps FROM mentions GROUP BY ALL) AS o ON o.repo = s.repo AND o.segment_id = s.segment_id LEFT JOIN (SELECT repo, target, count(DISTINCT module) AS dependents FROM mentions GROUP BY ALL) AS i ON i.repo = s.repo AND i.target = s.module""",
)
_NEW = "least(points + CASE WHEN purpose IS NOT NULL THEN 10 ELSE 0 END + least((deps + dependents) * 5, 20), 100)"
cte("recalibrated", f"SELECT *, CASE WHEN abs({_NEW} - points) > 10 THEN {_NEW} ELSE points END AS adjusted FROM contexts")


@query("h7_context_coverage", f"SELECT r.repo, count(segment_id) AS segments, count(DISTINCT path) AS paths, {rnd('CASE WHEN count(DISTINCT path) = 0 THEN 0e0 ELSE least(count(segment_id) / CAST(count(DISTINCT path) AS DOUBLE) / 5, 1e0) END')} AS coverage FROM repos AS r LEFT JOIN contexts AS c ON c.repo = r.repo GROUP BY r.repo")
def _(c):
    return graph.coverage(c.repos, c.contexts, c.files)


@query("h8_confidence_distribution", f"SELECT repo, count(*) FILTER (adjusted > 80) AS high, count(*) FILTER (adjusted BETWEEN 50 AND 80) AS medium, count(*) FILTER (adjusted < 50) AS low, {rnd('sum(adjusted) / CAST(count(*) AS DOUBLE) / 100e0')} AS mean_confidence FROM recalibrated GROUP BY repo")
def _(c):
    return graph.distribution(graph.recalibrate(c.contexts), "adjusted")


_D = "(deps + dependents + CASE WHEN purpose IS NOT NULL THEN 1 ELSE 0 END)"


@query("h9_context_depth", f"SELECT repo, count(*) FILTER ({_D} <= 1) AS shallow, count(*) FILTER ({_D} > 1 AND {_D} <= 3) AS medium, count(*) FILTER ({_D} > 3) AS deep, {rnd(f'sum({_D}) / CAST(count(*) AS DOUBLE)')} AS mean_depth FROM contexts GROUP BY repo")
def _(c):
    return graph.depth_metrics(c.contexts)


@query("h10_recalibration", "SELECT repo, segment_id, points, adjusted FROM recalibrated")
def _(c):
    return graph.recalibrate(c.contexts).select("repo", "segment_id", "points", "adjusted")


@query("h11_purpose_fill", "SELECT repo, purpose, count(*) AS n FROM contexts GROUP BY ALL")
def _(c):
    return c.contexts.groupBy("repo", "purpose").agg(F.count("*").alias("n"))


@query("p6_ordered_keyword_case", "SELECT purpose, count(*) AS n FROM contexts GROUP BY ALL")
def _(c):
    return c.contexts.groupBy("purpose").agg(F.count("*").alias("n"))


@query(
    "h12_corpus_edge_cases",
    f"""SELECT repo, n AS source_files, CASE WHEN n = 0 THEN 'EmptyProject' WHEN n = 1 THEN 'SingleFileProject' WHEN n > {X.LARGE_PROJECT} THEN 'LargeProject' ELSE 'Regular' END AS kind, CASE WHEN n = 0 THEN 'Analysis will be limited to project structure only'
        WHEN n = 1 THEN 'Cross-reference analysis will be simplified' WHEN n > {X.LARGE_PROJECT} THEN 'Batch processing and memory optimization will be applied' ELSE 'None' END AS recommendation
        FROM (SELECT r.repo, count(f.path) AS n FROM repos AS r LEFT JOIN files AS f ON f.repo = r.repo AND f.lang IS NOT NULL GROUP BY r.repo)""",
)
def _(c):
    return graph.edge_cases(c.repos, c.files)


@query(
    "h13_quality_before_after",
    f"""SELECT repo, 'before' AS stage, 0e0 AS completeness, {rnd("sum(points) / CAST(count(*) AS DOUBLE) / 100e0")} AS mean_confidence FROM recalibrated GROUP BY repo
        UNION ALL SELECT repo, 'after', {rnd("count(purpose) / CAST(count(*) AS DOUBLE)")}, {rnd("sum(adjusted) / CAST(count(*) AS DOUBLE) / 100e0")} FROM recalibrated GROUP BY repo""",
)
def _(c):
    return graph.quality(c.contexts)


# --- fusion ------------------------------------------------------------------------

_B = lambda cond, v=1: f"CASE WHEN {cond} THEN {v} ELSE 0 END"
cte(
    "projects",
    "SELECT repo, confidence AS pc, entry_points, n_deps, (SELECT count(*) FROM adjusted_domains AS a WHERE a.repo = p.repo) AS n_domains FROM profile AS p",
)
cte(
    "fused_parts",
    f"""SELECT c.*, CASE WHEN segment_type = 'Database' THEN 'Data' WHEN {has_any("lower(path)", X.PRESENTATION_WORDS)} THEN 'Presentation' ELSE 'Business' END AS layer,
        CASE WHEN pc > 7e-1 THEN 40 WHEN pc > 5e-1 THEN 30 WHEN pc > 3e-1 THEN 20 ELSE 0 END + {_B("n_domains > 0", 30)} + {_B("entry_points > 0", 20)} + {_B("n_deps > 0", 10)} AS project,
        points * 6 // 10 + {_B("purpose IS NOT NULL", 20)} + {_B("deps > 0", 10)} + {_B("dependents > 0", 10)} AS structure, least(len(hints) * 20, 100) AS business,
        {_B("n_domains > 0", 3)} + {_B("len(hints) > 0", 3)} + {_B("dependents > 0", 2)} + {_B("deps > 0", 2)} AS awareness FROM contexts AS c LEFT JOIN projects AS p USING (repo)""",
)
cte(
    "fused",
    f"""SELECT *, {rnd(f"least(fused * 7 + {_B('deps > 0', 10000)} + {_B('dependents > 0', 10000)}, 100000) / 100000e0")} AS quality FROM (SELECT *, project * 40 + least(structure, 100) * 20 + business * 30 + architecture * 10 AS fused FROM
        (SELECT *, least({case_map("layer", X.LAYER_SCORE)} + {_B("framework IS NOT NULL", 30)} + {_B("purpose IS NOT NULL", 20)}, 100) AS architecture FROM fused_parts))""",
)


@query("z1_segment_fusion", "SELECT repo, segment_id, layer, project, structure, business, architecture, fused, quality FROM fused")
def _(c):
    return c.fused.select("repo", "segment_id", "layer", "project", "structure", "business", "architecture", "fused", "quality")


cte(
    "breakdown",
    f"""SELECT repo, count(*) FILTER (fused > 7000) AS high, count(*) FILTER (fused > 4000 AND fused <= 7000) AS medium, count(*) FILTER (fused <= 4000) AS low, count(*) AS segments,
        {rnd("(count(*) FILTER (fused > 7000) * 85 + count(*) FILTER (fused > 4000 AND fused <= 7000) * 55 + count(*) FILTER (fused <= 4000) * 25) / CAST(count(*) AS DOUBLE) / 100e0")} AS tier2_confidence, {rnd("sum(awareness) / CAST(count(*) AS DOUBLE) / 10e0")} AS awareness FROM fused GROUP BY repo""",
)


@query("z2_fused_breakdown", "SELECT repo, high, medium, low, segments, tier2_confidence FROM breakdown")
def _(c):
    return fusion.breakdown(c.fused).drop("awareness")


@query("z3_context_awareness", "SELECT repo, awareness FROM breakdown")
def _(c):
    return fusion.breakdown(c.fused).select("repo", "awareness")


_ARCH = case_map("framework", X.ARCHITECTURE_OF, q(X.OTHER_ARCHITECTURE))
cte("detected", "SELECT d.*, f.n_evidence FROM dispatched AS d JOIN fw_confidence AS f USING (repo, framework)")
cte(
    "tier1",
    f"""SELECT repo, coalesce(n, 0) AS frameworks, {rnd("coalesce(s / n, 5e-1)")} AS tier1_confidence, {rnd("coalesce(least(e / CAST(n AS DOUBLE) / 10, 1e0), 0e0)")} AS evidence_quality, coalesce(patterns, []) AS patterns FROM repos
        LEFT JOIN (SELECT repo, sum(confidence) AS s, count(*) AS n, sum(n_evidence) AS e, list_sort(list(DISTINCT {_ARCH})) AS patterns FROM detected GROUP BY repo) USING (repo)""",
)


@query("z4_tier1_facts", "SELECT repo, frameworks, tier1_confidence, evidence_quality, array_to_string(patterns, ',') AS patterns FROM tier1")
def _(c):
    return c.tier1.withColumn("patterns", F.array_join("patterns", ","))


_NAMES = case_map("domain", X.GROUND_NAMES, "domain")
cte("names", f"SELECT repo, {_NAMES} AS name, confidence FROM adjusted_domains")
cte("kw", f"SELECT repo, k AS keyword, count(*) AS segments FROM (SELECT repo, unnest(list_filter([{', '.join(q(k) for k in X.KEYWORDS)}], lambda k: contains(low, k))) AS k FROM segments) GROUP BY ALL")
_TERMS = list(dict.fromkeys(t for _, ts, _ in X.GROUNDS.values() for t in ts))
cte(
    "totals",
    f"""SELECT r.repo, coalesce((SELECT CAST(sum(segments) AS BIGINT) FROM kw WHERE kw.repo = r.repo), 0) AS patterns, (SELECT count(*) FROM contexts AS c WHERE c.repo = r.repo) AS files FROM repos AS r""",
)
cte("file_terms", f"SELECT DISTINCT repo, unnest(list_filter([{', '.join(q(t) for t in _TERMS)}], lambda t: contains(lower(string_split(path, '/')[-1]), t))) AS term FROM contexts")
cte("ground_terms", f"SELECT * FROM {values([(n, t, text % t) for n, (text, ts, _) in X.GROUNDS.items() for t in ts], 'name, term, pattern', 'g')}")
cte(
    "terms",
    """SELECT DISTINCT n.repo, n.name, g.pattern FROM names AS n JOIN ground_terms AS g USING (name) WHERE EXISTS (SELECT 1 FROM kw WHERE kw.repo = n.repo AND contains(concat('business_keyword:', keyword), g.term))
       OR EXISTS (SELECT 1 FROM file_terms AS f WHERE f.repo = n.repo AND f.term = g.term)""",
)
_CAPS = "CASE name " + " ".join(f"WHEN {q(n)} THEN [{', '.join(q(x) for x in caps)}]" for n, (_, _, caps) in X.GROUNDS.items()) + " ELSE [concat(name, ' Operations')] END"


def _steps_sql(col, steps, default):
    return "CASE " + " ".join(f"WHEN {has_any(f'lower({col})', ws)} THEN {p}" for p, ws in steps) + f" ELSE {default} END"


cte(
    "insights",
    f"""SELECT n.*, t.patterns, t.files, (SELECT count(*) FROM terms AS x WHERE x.repo = n.repo AND x.name = n.name) AS n_patterns, coalesce((SELECT CAST(sum(segments) AS BIGINT) FROM kw WHERE kw.repo = n.repo AND contains(concat('business_keyword:', keyword), lower(n.name))), 0) AS support,
        {_CAPS} AS capabilities, least(50 + {_steps_sql("name", X.BUSINESS_VALUE_STEPS, 0)} + t.patterns, 100) / 100e0 AS business_value FROM names AS n JOIN totals AS t USING (repo)""",
)


@query("n1_evidence_collection", "SELECT repo, keyword, segments FROM kw")
def _(c):
    return c.kw


@query("n2_domain_term_hits", "SELECT repo, name, pattern FROM terms")
def _(c):
    return c.terms


@query("n3_domain_insight", "SELECT repo, name, confidence, n_patterns, support, business_value, array_to_string(capabilities, '|') AS capabilities FROM insights")
def _(c):
    return c.insights.select("repo", "name", "confidence", "n_patterns", "support", "business_value", F.array_join("capabilities", "|").alias("capabilities"))


_PAIR = lambda x: f"(a = '{x}' OR b = '{x}')"
cte(
    "relations",
    f"""SELECT repo, a, b, CASE WHEN a = 'E-commerce' AND b = 'User Management' THEN 'Authentication Integration' WHEN {_PAIR("Analytics")} THEN 'Data Flow' WHEN {_PAIR("API")} THEN 'Service Integration' ELSE 'Functional Dependency' END AS relation, {rnd("least(common / CAST(na + nb AS DOUBLE), 1e0)")} AS strength FROM
        (SELECT x.repo, x.name AS a, y.name AS b, x.n_patterns AS na, y.n_patterns AS nb, (SELECT count(*) FROM terms AS t WHERE t.repo = x.repo AND t.name = x.name AND EXISTS (SELECT 1 FROM terms AS u WHERE u.repo = y.repo AND u.name = y.name AND list_has_any(string_split(t.pattern, ' '), string_split(u.pattern, ' ')))) AS common
         FROM insights AS x JOIN insights AS y ON y.repo = x.repo AND x.name < y.name) WHERE common > 0""",
)


@query("n4_domain_relationships", "SELECT repo, a, b, relation, strength FROM relations")
def _(c):
    return c.relations


@query("n4_coherence", f"SELECT repo, {rnd('coalesce(s, 5e-1)')} AS coherence FROM repos LEFT JOIN (SELECT repo, sum(strength) / count(*) AS s FROM relations GROUP BY repo) USING (repo)")
def _(c):
    return grounding.coherence(c.repos, c.relations)


@query("n4_integration_points", "SELECT DISTINCT repo, name, 'Service integration capabilities' AS point FROM terms WHERE contains(pattern, 'api') OR contains(pattern, 'service') UNION ALL SELECT DISTINCT repo, name, 'User context integration' FROM terms WHERE contains(pattern, 'auth') OR contains(pattern, 'user')")
def _(c):
    return grounding.integration_points(c.terms)


@query("n5_conflicting_domains", "SELECT x.repo, x.name AS a, y.name AS b FROM insights AS x JOIN insights AS y ON y.repo = x.repo AND x.name < y.name WHERE len(list_intersect(x.capabilities, y.capabilities)) > len(x.capabilities) // 2")
def _(c):
    return grounding.conflicting(c.insights)


cte(
    "validation",
    f"""SELECT repo, name, {rnd("greatest(230 - CASE WHEN n_patterns < 2 THEN 30 ELSE 0 END - CASE WHEN support = 0 THEN 40 WHEN support < 3 THEN 20 ELSE 0 END - CASE WHEN support < 3 THEN 20 ELSE 0 END - CASE WHEN n_patterns * 2 < len(capabilities) THEN 30 ELSE 0 END, 0) / 300e0")} AS validation,
        concat_ws('|', CASE WHEN n_patterns < 2 THEN concat('Insufficient patterns found for ', name) END, CASE WHEN support = 0 THEN concat('No supporting evidence found for ', name) WHEN support < 3 THEN concat('Limited evidence for ', name) END,
          CASE WHEN support < 3 THEN concat('Low implementation completeness for ', name) END, CASE WHEN n_patterns * 2 < len(capabilities) THEN 'Inconsistency between detected patterns and claimed capabilities' END) AS issues FROM insights""",
)


@query("n6_domain_validation", "SELECT repo, name, validation, issues FROM validation")
def _(c):
    return grounding.validate(c.insights).withColumn("issues", F.array_join("issues", "|"))


cte("grounded", "SELECT i.*, validation, least(support, 10) / 10e0 AS strength, CASE WHEN support > 8 THEN 'Complete' WHEN support > 5 THEN 'In Progress' WHEN support > 2 THEN 'Partial' ELSE 'Planned' END AS status FROM insights AS i JOIN validation USING (repo, name) WHERE validation > 6e-1")


@query("n7_grounded_domains", "SELECT repo, name, confidence, validation, strength, status FROM grounded")
def _(c):
    return c.grounded.drop("capabilities")


cte(
    "roadmap",
    f"""SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority DESC, name) AS step FROM (SELECT repo, name, {rnd(f"confidence * 4e-1 + strength * 3e-1 + {case_map('status', X.STATUS_WEIGHT)} / 100e0 * 3e-1")} AS priority, {case_map("status", X.EFFORTS)} AS effort,
        {rnd(f"least({_steps_sql('name', X.ROADMAP_VALUES, 50)} / 100e0 * confidence * strength, 1e0)")} AS business_value,
        coalesce((SELECT array_to_string(list_sort(list(CASE WHEN r.a = g.name THEN r.b ELSE r.a END)), ',') FROM relations AS r WHERE r.repo = g.repo AND (r.a = g.name OR r.b = g.name)), '') AS related FROM grounded AS g)""",
)


@frame("roadmap")
def _(c):
    return grounding.roadmap(c.grounded, c.relations)


@query("n8_roadmap", "SELECT repo, step, name, priority, effort, business_value, related FROM roadmap")
def _(c):
    return c.roadmap.withColumn("related", F.array_join("related", ","))


@query(
    "n9_evidence_summary",
    f"""SELECT repo, patterns, files, coalesce(d, 0) AS domains, coalesce(best, 'None') AS strongest, {rnd("(least(patterns / 20e0, 1e0) + least(files / 10e0, 1e0) + least(coalesce(d, 0) / 5e0, 1e0)) / 3")} AS quality FROM totals
        LEFT JOIN (SELECT repo, count(*) AS d, min_by(name, (-confidence, name)) AS best FROM names GROUP BY repo) USING (repo)""",
)
def _(c):
    return grounding.summary(c.totals, c.names)


_T10 = "CASE framework " + " ".join(f"WHEN '{f}' THEN 3 * len(list_filter(names, lambda d: {has_any('d', ws)}))" for f, ws in X.ALIGNMENT.items()) + " ELSE len(names) END"
cte(
    "fw_consensus",
    f"""SELECT repo, framework, {rnd("t1")} AS tier1, {rnd("t2")} AS tier2, {rnd("t3")} AS tier3,
        {rnd("CASE WHEN d > 0 THEN (t1 * 3e-1 + CASE WHEN t2 > 0 THEN t2 * 4e-1 ELSE 0e0 END + CASE WHEN t3 > 0 THEN t3 * 3e-1 ELSE 0e0 END) / d ELSE t1 END")} AS consensus,
        {rnd("CASE WHEN ad > 0 THEN (CASE WHEN t1 > 0 THEN t1 * 4e-1 ELSE 0e0 END + CASE WHEN t2 > 0 THEN t2 * 4e-1 ELSE 0e0 END + CASE WHEN t3 > 0 THEN t3 * 2e-1 ELSE 0e0 END) / ad ELSE 0e0 END")} AS agreement FROM
        (SELECT *, t1 * 3e-1 + CASE WHEN t2 > 0 THEN 4e-1 ELSE 0e0 END + CASE WHEN t3 > 0 THEN 3e-1 ELSE 0e0 END AS d, CASE WHEN t1 > 0 THEN 4e-1 ELSE 0e0 END + CASE WHEN t2 > 0 THEN 4e-1 ELSE 0e0 END + CASE WHEN t3 > 0 THEN 2e-1 ELSE 0e0 END AS ad FROM
         (SELECT repo, framework, confidence AS t1, coalesce(h / CAST(n AS DOUBLE), 0e0) AS t2, least({_T10}, 10) / 10e0 AS t3 FROM (SELECT d.repo, d.framework, d.confidence, b.segments AS n, h.h, coalesce(g.names, []) AS names FROM detected AS d LEFT JOIN breakdown AS b USING (repo)
           LEFT JOIN (SELECT repo, framework, count(*) AS h FROM fused WHERE framework IS NOT NULL GROUP BY ALL) AS h USING (repo, framework) LEFT JOIN (SELECT repo, list(DISTINCT lower(name)) AS names FROM grounded GROUP BY repo) AS g USING (repo))))""",
)


@frame("fw_consensus")
def _(c):
    return cut_lineage(fusion.framework_consensus(c.detected, c.fused, c.grounded))


@query("z5_framework_consensus", "SELECT * FROM fw_consensus")
def _(c):
    return c.fw_consensus


cte(
    "dom_consensus",
    f"""SELECT repo, name, {rnd("t2")} AS tier2, {rnd("confidence")} AS tier3, {rnd("(confidence * 3e-1 + t2 * 4e-1) / (3e-1 + CASE WHEN t2 > 0 THEN 4e-1 ELSE 0e0 END)")} AS consensus, status FROM
        (SELECT g.*, least(coalesce((SELECT sum(fused) / CAST(any_value(b.segments) AS DOUBLE) / 10000e0 FROM fused AS f JOIN breakdown AS b USING (repo) WHERE f.repo = g.repo), 0e0), 1e0) AS t2 FROM grounded AS g)""",
)


@frame("dom_consensus")
def _(c):
    return cut_lineage(fusion.domain_consensus(c.grounded, c.fused, c.names))


@query("z6_domain_consensus", "SELECT repo, name, tier2, tier3, consensus, status FROM dom_consensus")
def _(c):
    return c.dom_consensus


cte(
    "checked",
    """SELECT repo, 'framework' AS kind, framework AS name, consensus, CASE WHEN consensus < 6e-1 THEN 'low confidence' WHEN agreement < 4e-1 THEN 'low tier agreement' ELSE 'accepted' END AS verdict FROM fw_consensus
       UNION ALL SELECT repo, 'domain', name, consensus, CASE WHEN consensus >= 5e-1 THEN 'accepted' ELSE 'low confidence' END FROM dom_consensus""",
)


@frame("checked")
def _(c):
    return fusion.validated(c.fw_consensus, c.dom_consensus)


@query("z7_consensus_validation", "SELECT repo, kind, name, consensus, verdict FROM checked")
def _(c):
    return c.checked


cte("picked", "SELECT *, CASE WHEN rank = 1 THEN 'primary' ELSE 'secondary' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY repo, kind ORDER BY consensus DESC, name) AS rank FROM checked WHERE verdict = 'accepted')")


@query("z8_primary_and_secondary", "SELECT repo, kind, name, consensus, rank, role FROM picked")
def _(c):
    return fusion.picks(c.checked).drop("verdict")


cte("tier3", f"SELECT repo, {rnd('sum(validation) / count(*)')} AS tier3_confidence FROM validation GROUP BY repo")
cte(
    "assessment",
    f"""SELECT repo, {rnd("ready")} AS readiness, {rnd("(layers / 5e0 + least(n / 100e0, 1e0)) / 2")} AS complexity, {rnd("(CASE WHEN len(patterns) > 0 THEN 8e-1 ELSE 4e-1 END + aw) / 2")} AS maintainability,
        array_to_string(CASE WHEN len(labels) + CASE WHEN layers >= 3 THEN 1 ELSE 0 END = 0 THEN ['Standard scalability patterns detected'] ELSE labels || CASE WHEN layers >= 3 THEN ['Multi-layer architecture supports horizontal scaling'] ELSE [] END END, '|') AS scalability,
        CASE WHEN ready >= 8e-1 THEN 'Project is ready for implementation' WHEN ready >= 6e-1 THEN 'Address remaining framework configuration|Finalize business requirements' ELSE 'Improve framework detection confidence|Enhance business context understanding|Validate architectural decisions' END AS next_steps FROM
        (SELECT t.repo, t.patterns, coalesce(fr, 0e0) * 4e-1 + coalesce(awareness, 0e0) * 3e-1 + coalesce(tier3_confidence, 5e-1) * 3e-1 AS ready, coalesce(layers, 0) AS layers, coalesce(segments, 0) AS n, coalesce(awareness, 0e0) AS aw, coalesce(labels, []) AS labels FROM tier1 AS t LEFT JOIN breakdown USING (repo)
         LEFT JOIN (SELECT repo, count(DISTINCT layer) AS layers FROM fused GROUP BY repo) USING (repo) LEFT JOIN (SELECT repo, sum(consensus) / count(*) AS fr FROM checked WHERE kind = 'framework' AND verdict = 'accepted' GROUP BY repo) USING (repo) LEFT JOIN tier3 USING (repo)
         LEFT JOIN (SELECT repo, list_sort(list(DISTINCT {case_map("framework", X.SCALABILITY)}) FILTER ({case_map("framework", X.SCALABILITY)} IS NOT NULL)) AS labels FROM detected GROUP BY repo) USING (repo))""",
)


@frame("assessment")
def _(c):
    return fusion.assessment(c.tier1, fusion.breakdown(c.fused), c.fused, c.checked, c.tier3, c.detected)


@query("z9_readiness_and_architecture", "SELECT * FROM assessment")
def _(c):
    return c.assessment.withColumn("scalability", F.array_join("scalability", "|")).withColumn("next_steps", F.array_join("next_steps", "|"))


_ABS = "abs(a - b)"
cte(
    "fusion_base",
    """SELECT t.repo, tier1_confidence AS a, coalesce(tier2_confidence, 0e0) AS b, coalesce(tier3_confidence, 5e-1) AS c, coalesce(awareness, 0e0) AS aw, CASE WHEN coalesce(segments, 0) = 0 THEN 5e-1 ELSE coalesce(al, 0) / CAST(segments AS DOUBLE) END AS share, coalesce(overall, 0e0) AS overall,
       (CASE WHEN fp THEN 3 ELSE 0 END + CASE WHEN fs THEN 1 ELSE 0 END + CASE WHEN dp THEN 3 ELSE 0 END + CASE WHEN ds THEN 1 ELSE 0 END + CASE WHEN len(t.patterns) > 0 THEN 1 ELSE 0 END + CASE WHEN readiness > 5e-1 THEN 1 ELSE 0 END) / 10e0 AS complete
       FROM tier1 AS t LEFT JOIN breakdown USING (repo) LEFT JOIN tier3 USING (repo) LEFT JOIN assessment USING (repo) LEFT JOIN (SELECT repo, bool_or(kind = 'framework' AND role = 'primary') AS fp, bool_or(kind = 'framework' AND role = 'secondary') AS fs, bool_or(kind = 'domain' AND role = 'primary') AS dp,
         bool_or(kind = 'domain' AND role = 'secondary') AS ds, sum(consensus) / count(*) AS overall FROM picked GROUP BY repo) USING (repo)
       LEFT JOIN (SELECT f.repo, count(*) AS al FROM fused AS f WHERE EXISTS (SELECT 1 FROM grounded AS g WHERE g.repo = f.repo AND list_contains(f.hints, g.name)) GROUP BY f.repo) USING (repo)""",
)
_MEAN = "((a + b + c) / 3)"
_SQ = lambda x: f"({x} - {_MEAN}) * ({x} - {_MEAN})"
_AL, _DI = "((sqrt(a * aw) + share) / 2)", f"least(greatest({_MEAN} * (1 - sqrt(({_SQ('a')} + {_SQ('b')} + {_SQ('c')}) / 3)), 0e0), 1e0)"


@query(
    "z10_fusion_quality",
    f"""SELECT repo, {rnd(_AL)} AS alignment, {rnd(_DI)} AS distribution, {rnd("overall")} AS consensus, {rnd("complete")} AS completeness, {rnd("(3 - abs(a - b) - abs(a - c) - abs(b - c)) / 3")} AS consistency,
        {rnd(f"{_AL} * 3e-1 + {_DI} * 25e-2 + overall * 25e-2 + complete * 2e-1")} AS quality, {rnd("CASE WHEN a > 0 THEN greatest((overall - a) / a, 0e0) ELSE overall END")} AS improvement FROM fusion_base""",
)
def _(c):
    return fusion.quality(c.tier1, fusion.breakdown(c.fused), c.tier3, fusion.picks(c.checked), c.assessment, c.fused, c.grounded)


@query(
    "z11_coverage_summary",
    f"""SELECT repo, count(*) AS segments, count(*) FILTER (framework IS NOT NULL) AS with_pattern, {rnd("count(*) FILTER (fused > 7000) / CAST(count(*) AS DOUBLE)")} AS high_ratio,
        {rnd("(CASE WHEN count(*) > 0 THEN 25 ELSE 0 END + CASE WHEN count(framework) > 0 THEN 25 ELSE 0 END + CASE WHEN bool_or(len(hints) > 0) THEN 25 ELSE 0 END + CASE WHEN count(purpose) > 0 THEN 25 ELSE 0 END) / 100e0")} AS completeness FROM fused GROUP BY repo""",
)
def _(c):
    n = F.count("*")
    part = lambda test: F.when(test, 25).otherwise(0)
    return c.fused.groupBy("repo").agg(
        n.alias("segments"), F.count("framework").alias("with_pattern"), r6(F.count_if(F.col("fused") > 7000) / n).alias("high_ratio"),
        r6((part(n > 0) + part(F.count("framework") > 0) + part(F.bool_or(F.size("hints") > 0)) + part(F.count("purpose") > 0)) / 100.0).alias("completeness"),
    )


@query(
    "z12_tier2_and_tier3_facts",
    """SELECT repo, 'layer' AS fact, layer AS label, count(*) AS n FROM fused GROUP BY ALL UNION ALL SELECT repo, 'hinted', 'segments', count(*) FILTER (len(hints) > 0) FROM fused GROUP BY repo
       UNION ALL SELECT repo, 'domain', name, CAST(floor(confidence * 1000000 + 5e-1) AS BIGINT) FROM grounded UNION ALL SELECT repo, 'roadmap', 'steps', count(*) FROM roadmap GROUP BY repo""",
)
def _(c):
    row = lambda df, fact, label, n: df.select("repo", F.lit(fact).alias("fact"), label.alias("label"), n.cast("bigint").alias("n"))
    layers = c.fused.groupBy("repo", "layer").agg(F.count("*").alias("n"))
    hinted = c.fused.groupBy("repo").agg(F.count_if(F.size("hints") > 0).alias("n"))
    steps = c.roadmap.groupBy("repo").agg(F.count("*").alias("n"))
    return (
        row(layers, "layer", F.col("layer"), F.col("n")).unionByName(row(hinted, "hinted", F.lit("segments"), F.col("n")))
        .unionByName(row(c.grounded, "domain", F.col("name"), F.floor(F.col("confidence") * 1000000 + 0.5))).unionByName(row(steps, "roadmap", F.lit("steps"), F.col("n")))
    )


@query(
    "z13_business_value",
    f"""SELECT r.repo, {rnd("sum(business_value) / count(*)")} AS mean_value, (SELECT count(*) FROM (SELECT unnest(capabilities) AS cap FROM grounded AS g WHERE g.repo = r.repo) WHERE {has_any("lower(cap)", X.HIGH_VALUE_WORDS)}) AS high_value_capabilities FROM roadmap AS r GROUP BY r.repo""",
)
def _(c):
    caps = c.grounded.select("repo", F.explode("capabilities").alias("cap")).groupBy("repo").agg(F.count_if(F.lower("cap").rlike("|".join(X.HIGH_VALUE_WORDS))).alias("high_value_capabilities"))
    v = c.roadmap.groupBy("repo").agg(r6(F.sum("business_value") / F.count("*")).alias("mean_value"))
    return v.join(caps, "repo", "left").fillna(0)
