"""Queries on project types and business domains."""

from pyspark.sql import functions as F


from repograin.operators import classify, domains
from repograin.plans import code as code_plan  # noqa: F401
from repograin.plans.base import case_any, case_map, cte, frame, has_any, hit_list, q, query, rnd, values
from repograin.rules import domains as B
from repograin.session import cut_lineage


@frame("facts")
def _(c):
    return classify.facts(c.repos, c.preferred, c.deps, c.files)


@frame("types")
def _(c):
    return classify.project_type(c.facts, c.type_scores)


@frame("entries")
def _(c):
    return classify.entry_points(c.files, c.preferred)


@frame("keywords")
def _(c):
    return classify.keywords(c.files)


@frame("type_scores")
def _(c):
    return cut_lineage(classify.weighted(c.preferred, classify.type_texts(c.preferred, c.deps, c.files)))


@frame("profile")
def _(c):
    return cut_lineage(classify.profile(c.facts, c.types, c.entries, c.keywords))


@frame("domain_scores")
def _(c):
    return cut_lineage(domains.scores(domains.evidence(c.files), c.dispatched))


@frame("candidates")
def _(c):
    return cut_lineage(domains.candidates(c.profile, c.dispatched))


@frame("aligned")
def _(c):
    primary = domains.split(c.domain_scores).where("role = 'primary'")
    return cut_lineage(domains.align(domains.semantics(c.segments, c.candidates), primary))


@frame("validated")
def _(c):
    return domains.validate(c.candidates, c.aligned)


@frame("merged_domains")
def _(c):
    return domains.merge(c.domain_scores, c.validated)


@frame("items")
def _(c):
    return domains.items(c.components, c.deps)


_OR = lambda col, ws: " + ".join(f"CAST(bool_or(coalesce(contains({col}, {q(w)}), FALSE)) AS INT)" for w in ws)
cte(
    "dep_facts",
    f"""SELECT repo, {_OR("dep", B.ANALYSIS_DEPS)} AS analysis_deps, {_OR("dep", B.ANALYSIS_CLI)} AS analysis_cli, {_OR("dep", B.WEB_DEPS)} AS web_deps, bool_or(scope NOT IN ('devDependencies', 'dev-dependencies') AND {has_any("dep", B.HEURISTIC_WEB)}) AS is_web,
        bool_or({has_any("dep", B.HEURISTIC_CLI)}) AS is_cli, count(*) AS n_deps FROM (SELECT p.repo, lower(d.name) AS dep, d.scope FROM preferred AS p JOIN deps AS d ON d.repo = p.repo AND d.manifest = p.manifest) GROUP BY repo""",
)
cte("readmes", "SELECT repo, content AS readme FROM files WHERE path = 'README.md'")
cte(
    "facts",
    f"""SELECT p.*, coalesce(analysis_deps, 0) AS analysis_deps, coalesce(analysis_cli, 0) AS analysis_cli, coalesce(web_deps, 0) AS web_deps, coalesce(is_web, FALSE) AS is_web, coalesce(is_cli, FALSE) AS is_cli, coalesce(n_deps, 0) AS n_deps, readme,
        {" + ".join(f"CASE WHEN contains(lower(readme), {q(w)}) THEN 1 ELSE 0 END" for w in B.ANALYSIS_README)} AS readme_hits, {has_any("lower(name)", B.NAME_PATTERNS)} AS name_hit FROM preferred AS p LEFT JOIN dep_facts USING (repo) LEFT JOIN readmes USING (repo)""",
)
_AN = f"CASE WHEN name_hit THEN 3e-1 ELSE 0e0 END + analysis_deps * 25e-2 / {len(B.ANALYSIS_DEPS)} + analysis_cli * 1e-1 / {len(B.ANALYSIS_CLI)} + readme_hits * 2e-1 / {len(B.ANALYSIS_README)}"
cte("type_scores", f"SELECT * FROM (SELECT repo, 'analysis_tool' AS project_type, {rnd(_AN)} AS score FROM facts UNION ALL SELECT repo, 'web_application', {rnd(f'web_deps * 25e-2 / {len(B.WEB_DEPS)}')} FROM facts) WHERE score > 0")
cte("type_ranked", "SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, project_type) AS rank FROM type_scores")
_HEUR = "CASE WHEN is_web THEN 'web_application' WHEN is_cli THEN 'cli_tool' ELSE 'library' END"
cte("types", f"SELECT f.repo, CASE WHEN t.score > 3e-1 THEN t.project_type ELSE {_HEUR} END AS project_type, CASE WHEN t.score > 3e-1 THEN t.score ELSE 5e-1 END AS confidence FROM facts AS f LEFT JOIN type_ranked AS t ON t.repo = f.repo AND t.rank = 1")


@query("g1_weighted_type_scoring", "SELECT repo, project_type, score FROM type_scores")
def _(c):
    return c.type_scores


@query("g2_heuristic_type", f"SELECT repo, {_HEUR} AS project_type, 5e-1 AS score FROM facts")
def _(c):
    return classify.heuristic(c.facts)


@query("g3_strategy_fallback", "SELECT repo, project_type, confidence FROM types")
def _(c):
    return c.types


@query("g4_alternatives", "SELECT repo, project_type, score, rank FROM type_ranked WHERE rank >= 2")
def _(c):
    return classify.alternatives(c.type_scores)


cte("entries", f"SELECT f.repo, f.path, t AS entry_type, c / 100e0 AS confidence FROM files AS f JOIN preferred AS p USING (repo) JOIN {values(B.ENTRY_POINTS, 'm, path, t, c', 'e')} ON e.path = f.path AND e.m = p.package_manager")


@query("g5_entry_points", "SELECT repo, path, entry_type, confidence FROM entries")
def _(c):
    return c.entries


_VOCAB = list(dict.fromkeys([("purpose", w) for w in B.ANALYSIS_README] + [("domain", w) for _, _, ws, _ in B.CONFIG.values() for w in ws]))
cte("keywords", f"SELECT repo, kind, keyword FROM readmes, {values(_VOCAB, 'kind, keyword', 'v')} WHERE contains(lower(readme), keyword)")


@query("d10_keyword_harvest", "SELECT repo, kind, keyword FROM keywords")
def _(c):
    return c.keywords


_T = lambda i: case_map("project_type", {k: v[i] for k, v in B.PROJECT_TYPES.items()}, q(B.PROJECT_TYPES["unknown"][i]))
_FIRST = "trim(regexp_replace(regexp_extract(readme, '^([^\\r\\n]*)', 1), '^#+', ''))"
_HINTS = "CASE project_type " + " ".join(f"WHEN '{t}' THEN {'[' + ', '.join(q(h) for h in hs) + ']' if hs else 'kw'}" for t, (_, _, hs) in B.PROJECT_TYPES.items()) + " END"
cte(
    "profile",
    f"""SELECT f.repo, f.name, package_manager, project_type, confidence, {_T(0)} AS display_name, {_T(1)} AS analysis_focus, CASE WHEN readme IS NOT NULL THEN concat_ws(' - ', description, {_FIRST}) ELSE coalesce(description, {_T(0)}) END AS purpose, coalesce({_HINTS}, []) AS domain_hints,
        (SELECT count(*) FROM entries AS e WHERE e.repo = f.repo) AS entry_points, n_deps, description FROM facts AS f JOIN types USING (repo) LEFT JOIN (SELECT repo, list_sort(list(DISTINCT keyword) FILTER (kind = 'domain')) AS kw FROM keywords GROUP BY repo) USING (repo)""",
)


@query("g6_project_profile", "SELECT repo, name, package_manager, project_type, purpose, array_to_string(domain_hints, ',') AS domain_hints, entry_points FROM profile")
def _(c):
    return c.profile.select("repo", "name", "package_manager", "project_type", "purpose", F.array_join("domain_hints", ",").alias("domain_hints"), "entry_points")


@query("g8_type_labels", "SELECT repo, project_type, display_name, analysis_focus FROM profile")
def _(c):
    return c.types.select("repo", "project_type", *classify.labels(F.col("project_type")))


# --- domains ----------------------------------------------------------------------

_RULES = []
for pack, d, w, ext, where, words, paths in B.ANY_OF:
    hit = " OR ".join(([has_any("content", words)] if words else []) + ([has_any("path", paths)] if paths else []))
    _RULES.append((pack, d, w, f"ext = '{ext}'" + (f" AND {has_any('path', where)}" if where else "") + f" AND ({hit})"))
for pack, d, w, ext, where, words in B.EACH_OF:
    _RULES += [(pack, d, w, f"ext = '{ext}'" + (f" AND {has_any('path', where)}" if where else "") + f" AND contains(content, {q(x)})") for x in words]
_RULES.append((B.NEST, "Notification", 30, f"ext = 'ts' AND contains(path, 'usecase') AND contains(path, 'notification') AND {has_any('path', B.NOTIFICATION_USECASES)}"))
_STEM = "regexp_replace(string_split(path, '/')[-1], '^(.+)[.][^.]*$', '\\1')"
for i, (d, w, words) in enumerate(B.NEST_ENTITIES):
    earlier = "".join(f" AND NOT {has_any(_STEM, ws)}" for _, _, ws in B.NEST_ENTITIES[:i])
    _RULES.append((B.NEST, d, w, f"ext = 'ts' AND {has_any('path', ['entity', 'entities'])} AND contains(content, '@Entity()') AND {has_any(_STEM, words)}{earlier}"))
cte(
    "domain_evidence",
    f"""SELECT repo, pack, domain, CAST(sum(points) AS BIGINT) AS points, count(*) AS rows FROM (SELECT repo, unnest({hit_list([t for *_, t in _RULES])}) AS rule FROM files) JOIN {values([(i, p, d, w) for i, (p, d, w, _) in enumerate(_RULES)], "rule, pack, domain, points", "r")} USING (rule) GROUP BY repo, pack, domain UNION ALL """
    + " UNION ALL ".join(f"SELECT DISTINCT repo, '{p}', '{d}', {w}, 1 FROM files WHERE " + " OR ".join(f"starts_with(path, '{x}/')" for x in ds) for p, d, w, ds in B.DIRECTORIES),
)
_PACKS = [(p, f) for p, fs in B.PACK_FRAMEWORKS.items() for f in fs]
cte(
    "domain_scores",
    f"SELECT repo, domain, CAST(sum(points) AS BIGINT) AS points, CAST(sum(rows) AS BIGINT) AS evidence FROM domain_evidence JOIN {values(_PACKS, 'pack, framework', 'p')} USING (pack) JOIN dispatched USING (repo, framework) GROUP BY repo, domain HAVING sum(points) >= {B.KEEP}",
)


@query("b1_domain_evidence", "SELECT repo, pack, domain, points, rows FROM domain_evidence")
def _(c):
    return domains.evidence(c.files)


@query("b2_domain_scores", "SELECT repo, domain, points, evidence FROM domain_scores")
def _(c):
    return c.domain_scores


@query("b3_primary_secondary_split", f"SELECT repo, domain, points, evidence, CASE WHEN points >= {B.PRIMARY} THEN 'primary' ELSE 'secondary' END AS role, CASE WHEN points >= 80 THEN 'Comprehensive' WHEN points >= 60 THEN 'Core' ELSE 'Minimal' END AS strategy FROM domain_scores")
def _(c):
    return domains.split(c.domain_scores)


_BT = "CASE " + " ".join(f"WHEN {has_any('lower(name)', ns)} OR {has_any(chr(108) + 'ower(coalesce(description, ' + q('') + '))', ws)} THEN {q(t)}" for t, ns, ws in B.BUSINESS_TYPES) + f" WHEN list_has_any(coalesce(known, []), ['{B.WEB_FRAMEWORKS[0]}', '{B.WEB_FRAMEWORKS[1]}']) THEN 'Web Application' WHEN list_has_any(coalesce(known, []), [{', '.join(q(f) for f in B.API_FRAMEWORKS)}]) THEN 'API Service' ELSE 'Application' END"
_BASE = "CASE business_type " + " ".join(f"WHEN {q(t)} THEN [{', '.join(q(x) for x in ns)}]" for t, ns in B.CANDIDATES.items()) + " END"
_EXTRA = lambda w, d: f"CASE WHEN len(list_filter(domain_hints, lambda h: contains(lower(h), '{w}'))) > 0 THEN ['{d}'] ELSE [] END"
cte(
    "candidates",
    f"""SELECT repo, business_type, (base || list_filter({_EXTRA("notification", "Notification")} || {_EXTRA("file", "FileManagement")}, lambda x: NOT list_contains(base, x))) AS candidates FROM
        (SELECT *, {_BASE} AS base FROM (SELECT p.*, {_BT} AS business_type FROM profile AS p LEFT JOIN (SELECT repo, list(framework) AS known FROM dispatched GROUP BY repo) USING (repo)))""",
)


@query("b5_business_type_and_candidates", "SELECT repo, business_type, array_to_string(candidates, ',') AS candidates FROM candidates")
def _(c):
    return c.candidates.withColumn("candidates", F.array_join("candidates", ","))


@query(
    "b5_business_capabilities",
    """SELECT p.repo, array_to_string(CASE WHEN len(coalesce(ls, [])) + len(domain_hints) = 0 THEN ['General Application Functions'] ELSE (coalesce(ls, []) || list_transform(domain_hints, lambda h: concat('Business Logic: ', h))) END, '|') AS capabilities FROM profile AS p
       LEFT JOIN (SELECT repo, list(label ORDER BY path, pos) AS ls FROM (SELECT repo, path, 0 AS pos, 'Core Application Logic' AS label FROM entries WHERE contains(lower(path), 'main') OR contains(lower(path), 'app')
         UNION ALL SELECT repo, path, 1, 'API Services' FROM entries WHERE contains(lower(path), 'server') OR contains(lower(path), 'api') UNION ALL SELECT repo, path, 2, 'Command Line Interface' FROM entries WHERE contains(lower(path), 'cli') OR contains(lower(path), 'command')) GROUP BY repo) USING (repo)""",
)
def _(c):
    return domains.capabilities(c.profile, c.entries).withColumn("capabilities", F.array_join("capabilities", "|"))


cte(
    "semantics",
    f"SELECT s.repo, candidate, pattern, points, count(*) AS n FROM (SELECT repo, unnest({hit_list([has_any('content', ws) for _, _, ws, _ in B.SEMANTICS])}) AS rule FROM segments) AS s JOIN {values([(i, c, w, p) for i, (c, w, _, p) in enumerate(B.SEMANTICS)], 'rule, candidate, points, pattern', 'r')} USING (rule) JOIN candidates AS k ON k.repo = s.repo AND list_contains(k.candidates, candidate) GROUP BY ALL",
)
cte(
    "aligned",
    f"SELECT s.repo, candidate, pattern, s.domain, n, points * CASE WHEN d.domain IS NOT NULL THEN 13 ELSE 10 END AS milli FROM (SELECT *, {case_any('lower(pattern)', B.PATTERN_DOMAINS, 'Unknown')} AS domain FROM semantics) AS s LEFT JOIN (SELECT repo, domain FROM domain_scores WHERE points >= {B.PRIMARY}) AS d ON d.repo = s.repo AND d.domain = s.domain",
)
cte(
    "validated",
    "SELECT repo, domain, rank, p / 10000e0 AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY p DESC, domain) AS rank FROM (SELECT repo, domain, CAST(sum(p) AS BIGINT) AS p FROM (SELECT repo, unnest(candidates) AS domain, 3000 AS p FROM candidates UNION ALL SELECT repo, domain, milli * 6 * n FROM aligned) GROUP BY repo, domain)) WHERE p >= 3000",
)


@query("b4_segment_semantics", "SELECT repo, candidate, pattern, points, n FROM semantics")
def _(c):
    return domains.semantics(c.segments, c.candidates)


@query("b6_alignment_boost", "SELECT repo, candidate, pattern, domain, n, milli FROM aligned")
def _(c):
    return c.aligned


@query("b7_validated_domains", "SELECT repo, domain, rank, confidence FROM validated")
def _(c):
    return c.validated


@query("b8_rank_weighted_confidence", f"SELECT repo, {rnd('sum(confidence * w) / sum(w)')} AS overall_confidence, min_by(domain, rank) AS primary_domain FROM (SELECT *, {case_map('rank', B.RANK_WEIGHTS)} AS w FROM validated) GROUP BY repo")
def _(c):
    return domains.overall(c.validated)


@query("b9_label_normalisation", f"SELECT hint, {case_any('lower(hint)', B.LABELS, 'Unknown')} AS domain, count(*) AS n FROM (SELECT unnest(hints) AS hint FROM segments) GROUP BY ALL")
def _(c):
    return c.segments.select(F.explode("hints").alias("hint")).groupBy("hint", domains.label_domain(F.col("hint")).alias("domain")).agg(F.count("*").alias("n"))


cte(
    "merged_domains",
    f"""SELECT repo, domain, {rnd("CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a * 6e-1 + b * 4e-1 ELSE coalesce(a, b) END")} AS confidence, CASE WHEN a IS NOT NULL THEN CASE WHEN a >= 6e-1 THEN 'primary' ELSE 'secondary' END WHEN b >= 8e-1 THEN 'primary' ELSE 'secondary' END AS role FROM
        (SELECT repo, domain, points / 100e0 AS a FROM domain_scores) FULL JOIN (SELECT repo, {case_any("lower(domain)", B.LABELS, "Unknown")} AS domain, max(confidence) AS b FROM validated GROUP BY ALL) USING (repo, domain)""",
)


@query("b10_two_source_merge", "SELECT repo, domain, confidence, role FROM merged_domains")
def _(c):
    return c.merged_domains


_UP = " OR ".join(f"(project_type = '{t}' AND domain IN ({', '.join(q(d) for d in r)}))" for t, (r, _) in B.ADJUSTMENTS.items())
_DOWN = " OR ".join(f"(project_type = '{t}' AND domain IN ({', '.join(q(d) for d in l)}))" for t, (_, l) in B.ADJUSTMENTS.items() if l)
_ADJ = f"""SELECT repo, domain, confidence, role, project_type FROM (SELECT repo, domain, role, project_type, {rnd(f"CASE WHEN {_UP} THEN least(confidence + 15e-2, 1e0) WHEN {_DOWN} THEN greatest(confidence - 2e-1, 0e0) ELSE confidence END")} AS confidence
    FROM (SELECT m.*, t.project_type FROM merged_domains AS m LEFT JOIN types AS t USING (repo))) WHERE project_type <> 'analysis_tool' OR confidence >= 4e-1"""
cte("adjusted_domains", _ADJ)


@frame("adjusted_domains")
def _(c):
    return domains.adjust(c.merged_domains, c.types)


@query("b13_project_type_adjustment", "SELECT repo, domain, confidence, role, project_type FROM adjusted_domains")
def _(c):
    return c.adjusted_domains


@query(
    "b15_staged_domain_run",
    f"""SELECT r.repo, (SELECT count(*) FROM adjusted_domains AS a WHERE a.repo = r.repo) AS domains, (SELECT count(*) FROM adjusted_domains AS a WHERE a.repo = r.repo AND role = 'primary') AS primary_domains,
        (SELECT max(confidence) FROM adjusted_domains AS a WHERE a.repo = r.repo) AS best_confidence, (SELECT array_to_string(candidates, ',') FROM candidates AS k WHERE k.repo = r.repo) AS candidates FROM repos AS r""",
)
def _(c):
    a = c.adjusted_domains.groupBy("repo").agg(F.count("*").alias("domains"), F.count_if(F.col("role") == "primary").alias("primary_domains"), F.max("confidence").alias("best_confidence"))
    return c.repos.join(a, "repo", "left").join(c.candidates.select("repo", F.array_join("candidates", ",").alias("candidates")), "repo", "left").fillna(0, ["domains", "primary_domains"])


cte("items", "SELECT repo, 'endpoint' AS kind, a.endpoint AS item FROM (SELECT repo, unnest(api_calls) AS a FROM components) UNION ALL SELECT repo, 'dependency', name FROM deps UNION ALL SELECT repo, 'file', string_split(path, '/')[-1] FROM components")
_CFG = [(d, ws, w, B.ITEM_KINDS[t]) for d, (_, _, _, ps) in B.CONFIG.items() for t, ws, w in ps]
cte(
    "config_scores",
    f"SELECT repo, domain, CAST(sum(points) AS BIGINT) AS points FROM (SELECT repo, unnest({hit_list([f'kind IN ({chr(44).join(q(k) for k in kinds)}) AND ' + has_any('lower(item)', [x.lower() for x in ws]) for _, ws, _, kinds in _CFG])}) AS rule FROM items) JOIN {values([(i, d, w) for i, (d, _, w, _) in enumerate(_CFG)], 'rule, domain, points', 'r')} USING (rule) GROUP BY repo, domain",
)
cte("best_domain", f"SELECT repo, coalesce(domain, '{B.GENERAL[0]}') AS domain, coalesce(points, 0) / 100e0 AS score FROM repos LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY points DESC, domain) AS k FROM config_scores) USING (repo) WHERE coalesce(k, 1) = 1")


@query("b11_config_match_score", "SELECT repo, domain, points FROM config_scores")
def _(c):
    return domains.config_scores(c.items)


@query("b12_best_domain", "SELECT repo, domain, score FROM best_domain")
def _(c):
    return domains.best(c.repos, domains.config_scores(c.items))


_NM = lambda i: case_map("domain", {k: v[i] for k, v in B.CONFIG.items()} | {B.GENERAL[0]: B.GENERAL[i + 1]})
cte("purpose_evidence", "SELECT DISTINCT repo, kind, item FROM items WHERE kind IN ('endpoint', 'dependency') AND item IS NOT NULL")
_NUM = lambda kind: f"(SELECT count(*) FROM purpose_evidence AS i WHERE i.repo = b.repo AND kind = '{kind}')"


@query("b14_purpose_facts", f"SELECT repo, domain, {_NM(0)} AS name, {_NM(1)} AS description, {_NUM('endpoint')} AS endpoints, {_NUM('dependency')} AS dependencies, kind, item FROM best_domain AS b LEFT JOIN purpose_evidence USING (repo)")
def _(c):
    """What is a repository for, and which endpoints and dependencies say so? A row per item, all of them; one without items where there is none."""
    facts = domains.purpose(domains.best(c.repos, domains.config_scores(c.items)), c.items)
    return facts.join(domains.purpose_evidence(c.items), "repo", "left")


@query("b14_purpose_evidence", "SELECT repo, kind, item FROM purpose_evidence")
def _(c):
    return domains.purpose_evidence(c.items)


@query(
    "s13_rule_table_load",
    """SELECT id, kind, count(*) AS patterns, min(pattern) AS first_pattern FROM (SELECT p_brand AS id, 'name' AS kind, unnest(string_split(p_name, ' ')) AS pattern FROM part UNION ALL SELECT p_brand, 'type', unnest(string_split(p_type, ' ')) FROM part) GROUP BY id, kind""",
)
def _(c):
    from repograin.sources.configs import rule_rows

    # Rule documents of the configuration format, one per part, parsed back to rule rows.
    words = lambda col: F.split(col, " ")
    doc = F.to_json(F.struct(F.col("p_brand").alias("id"), F.array(
        F.struct(F.lit("name").alias("type"), words("p_name").alias("patterns")), F.struct(F.lit("type").alias("type"), words("p_type").alias("patterns"))).alias("patterns")))
    rules = rule_rows(c.table("part").select(doc.alias("value")))
    return rules.groupBy("id", "kind").agg(F.count("*").alias("patterns"), F.min("pattern").alias("first_pattern"))


_RULE_TEXTS = [("name", "documents", "doc_id", "text"), ("type", "pages", "page_id", "html")]


@query(
    "s13_rules_in_use",
    " UNION ALL ".join(
        f"""SELECT subject, '{kind}' AS scope, count(*) AS texts FROM (SELECT DISTINCT subject, {key} FROM (SELECT DISTINCT p_brand AS subject, unnest(string_split(lower(p_{kind}), ' ')) AS w FROM part)
        JOIN {table} ON contains(lower({text}), w)) GROUP BY subject"""
        for kind, table, key, text in _RULE_TEXTS
    ),
)
def _(c):
    """How many texts does each loaded rule set find, documents by its names and pages by its types?"""
    from repograin.functions import automaton
    from repograin.sources.configs import rule_rows

    pack = lambda kind: F.struct(F.lit(kind).alias("type"), F.split(f"p_{kind}", " ").alias("patterns"))
    rules = automaton.rules_of(rule_rows(c.table("part").select(F.to_json(F.struct(
        F.col("p_brand").alias("id"), F.col("p_brand").alias("name"), F.array(pack("name"), pack("type")).alias("patterns"))).alias("value"))))
    texts = None
    for kind, table, key, text in _RULE_TEXTS:
        rows = c.table(table).select(F.col(key).alias("id"), F.lit(kind).alias("scope"), F.lower(text).alias("text"))
        texts = rows if texts is None else texts.unionByName(rows)
    found = automaton.hits(texts, rules, ["id", "scope"]).select("id", "scope", "rule").distinct()
    subjects = c.spark.createDataFrame([(n, r.subject) for n, r in enumerate(rules)], "rule int, subject string")
    return found.join(subjects, "rule").groupBy("subject", "scope").agg(F.count("*").alias("texts"))
