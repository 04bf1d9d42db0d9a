"""Queries on cross-repository links, insights, corrections, scoring, history, metrics, exports."""

from pyspark.sql import functions as F

from repograin.functions.scores import r6
from repograin.operators import components as comp_ops
from repograin.operators import corrections, crossrepo, exports, history, insights, reports, run_metrics, scoring
from repograin.plans import context as context_plan  # noqa: F401
from repograin.plans.base import ORACLES, case_any, case_map, cte, fold, frame, has_any, q, query, rnd, values
from repograin.plans.markers import _EFFORT
from repograin.rules import code as K
from repograin.rules import context as X
from repograin.session import cut_lineage

# --- cross-repository links -----------------------------------------------------


@frame("identifiers")
def _(c):
    return crossrepo.identifiers(c.repos, c.metadata)


@frame("links")
def _(c):
    return cut_lineage(crossrepo.mentions(c.sections, c.identifiers))


@frame("link_relations")
def _(c):
    return crossrepo.relations(c.links)


@frame("relevant")
def _(c):
    return crossrepo.relevance(c.links)


_CAMEL = "concat(lower(p[1]), array_to_string(list_transform(list_filter(p[2:], lambda x: x <> ''), lambda x: concat(upper(x[1]), lower(x[2:]))), ''))"
cte(
    "identifiers",
    f"""SELECT DISTINCT repo, identifier FROM (SELECT repo, unnest([repo, replace(repo, '-', '_'), replace(repo, '_', '-'), {_CAMEL}, lower(replace(repo, '_', '-'))]) AS identifier FROM (SELECT repo, string_split_regex(repo, '[-_]') AS p FROM repos)
        UNION ALL SELECT repo, name FROM metadata WHERE manifest IN ('package.json', 'Cargo.toml'))""",
)
_ID = "regexp_replace(identifier, '([^A-Za-z0-9_])', '\\\\\\1', 'g')"
_B, _A = "(?:^|[^\\pL\\pN_])", "(?:$|[^\\pL\\pN_])"  # no letter, digit or underscore beside the name
cte(
    "links",
    f"""SELECT s.repo AS source, path, ord, section, body, i.repo AS target, identifier, regexp_matches(body, concat('(?i){_B}', {_ID}, '-[\\pL\\pN_]|[\\pL\\pN_]-', {_ID}, '{_A}')) AS related,
        regexp_matches(body, concat('(?i)(?:component|service|module|project)(?:|.*[^\\pL\\pN_])', {_ID}, '{_A}|{_B}', {_ID}, '(?:|[^\\pL\\pN_].*)(?:component|service|module)')) AS component
        FROM sections AS s JOIN identifiers AS i ON i.repo <> s.repo AND contains(lower(s.body), lower(i.identifier)) AND regexp_matches(body, concat('(?i){_B}', {_ID}, '{_A}')) WHERE section IN ('Description', 'Architecture', 'Api')""",
)


@query("q1_project_identifiers", "SELECT repo, identifier FROM identifiers")
def _(c):
    return c.identifiers


cte(
    "link_relations",
    f"""SELECT DISTINCT target, source, 'ParentProject' AS relation, source AS name, 8e-1 AS confidence FROM links WHERE section <> 'Api' AND regexp_matches({fold("body")}, {q(X.PARENT_PATTERN)})
        UNION ALL SELECT DISTINCT target, source, 'SharedContext', identifier, 9e-1 FROM links WHERE section <> 'Api' UNION ALL SELECT DISTINCT target, source, 'SiblingProject', identifier, 7e-1 FROM links WHERE section <> 'Api' AND related""",
)


@query("q2_relation_patterns", "SELECT target, source, relation, name, confidence FROM link_relations")
def _(c):
    return c.link_relations


_PO = f"CAST(regexp_matches({fold('body')}, {q(X.PARENT_PATTERN)}) AS INT) + CAST(regexp_matches({fold('body')}, {q(X.OVERVIEW_PATTERN)}) AS INT)"
cte(
    "relevant",
    f"""SELECT * FROM (SELECT *, {rnd("(e * 4 + r * 3 + k * 2 + po) / CAST(e + r + k + po AS DOUBLE) / 10e0")} AS relevance FROM (SELECT source, path, ord, section, target, any_value(body) AS body, count(*) AS e, count(*) FILTER (related) AS r, count(*) FILTER (component) AS k,
        any_value({_PO}) AS po, list_sort(list(DISTINCT identifier)) AS refs FROM links WHERE section IN ('Architecture', 'Api') GROUP BY source, path, ord, section, target)) WHERE relevance >= 3e-1""",
)


@query("q3_relevance_score", "SELECT source, path, ord, target, relevance FROM relevant")
def _(c):
    return c.relevant.select("source", "path", "ord", "target", "relevance")


@query("q4_project_references", "SELECT source, path, ord, target, array_to_string(refs, ',') AS refs FROM relevant")
def _(c):
    return c.relevant.select("source", "path", "ord", "target", F.array_join("references", ",").alias("refs"))


@query(
    "q5_parent_context",
    """SELECT p.target, p.name AS parent, p.confidence, coalesce(n, 0) AS siblings, first_sibling FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY confidence DESC, name) AS k FROM link_relations WHERE relation = 'ParentProject') AS p
       LEFT JOIN (SELECT target, count(DISTINCT name) AS n, min(name) AS first_sibling FROM link_relations WHERE relation = 'SiblingProject' GROUP BY target) AS s ON s.target = p.target WHERE k = 1""",
)
def _(c):
    return crossrepo.parents(c.link_relations)


@query(
    "q6_role_inference",
    "SELECT target, coalesce(min_by(role, (-n, role)), '" + X.DEFAULT_ROLE + "') AS role FROM (SELECT target, " + "NULL::VARCHAR AS role, 0 AS n FROM relevant WHERE FALSE"
    + "".join(f" UNION ALL SELECT target, {q(r)}, count(*) FROM relevant WHERE {has_any('lower(body)', ws)} GROUP BY target" for r, ws in X.ROLES) + ") GROUP BY target",
)
def _(c):
    return crossrepo.roles(c.relevant)


@query(
    "q7_shared_infrastructure",
    f"SELECT target, array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN bool_or({has_any(chr(108) + chr(111) + chr(119), ws)}) THEN {q(t)} END' for t, ws in X.INFRASTRUCTURE)}], lambda x: x IS NOT NULL)), ',') AS shared FROM (SELECT *, lower(body) AS low FROM relevant) GROUP BY target",
)
def _(c):
    return crossrepo.infrastructure(c.relevant).withColumn("shared", F.array_join("shared", ","))


@query(
    "q8_cross_repository_run",
    """SELECT target, count(*) AS relations, count(DISTINCT source) AS sources, max(confidence) AS confidence, (SELECT count(*) FROM relevant AS r WHERE r.target = l.target) AS documents FROM link_relations AS l GROUP BY target""",
)
def _(c):
    d = c.relevant.groupBy("target").agg(F.count("*").alias("documents"))
    by_source = c.link_relations.groupBy("target", "source").agg(F.count("*").alias("n"), F.max("confidence").alias("c"))
    return by_source.groupBy("target").agg(F.sum("n").alias("relations"), F.count("*").alias("sources"), F.max("c").alias("confidence")).join(d, "target", "left").fillna(0)


# --- insights --------------------------------------------------------------------


@frame("technical")
def _(c):
    return insights.technical(c.components)


@frame("metrics")
def _(c):
    return insights.quality(c.components, c.technical)


@frame("story_components")
def _(c):
    return cut_lineage(comp_ops.story_components(c.stories, c.components))


@frame("risks")
def _(c):
    return insights.story_risk(c.stories, c.story_components)


_OPEN = "status IN ('Todo', 'Incomplete')"
cte("tech_counts", f"SELECT repo, count(*) FILTER (complexity > 70) AS a, count(*) FILTER (len(api_calls) > 0) AS b, count(*) FILTER ({_OPEN}) AS c FROM components GROUP BY repo")
cte(
    "technical",
    """SELECT repo, 'Maintainability' AS category, 'High Complexity Components Detected' AS title, a AS n, CASE WHEN a > 5 THEN 'High' ELSE 'Medium' END AS severity FROM tech_counts WHERE a > 0
       UNION ALL SELECT repo, 'Architecture', 'API-Heavy Architecture Detected', b, 'Medium' FROM tech_counts WHERE b > 3 UNION ALL SELECT repo, 'Testing', 'Incomplete Implementation Risk', c, CASE WHEN c > 3 THEN 'High' ELSE 'Medium' END FROM tech_counts WHERE c > 0""",
)


@query("y1_technical_insights", "SELECT repo, category, title, n, severity FROM technical")
def _(c):
    return c.technical


@query(
    "y2_architecture_recommendations",
    """WITH k AS (SELECT repo, count(*) FILTER (component_type = 'Service') AS s, count(*) FILTER (component_type = 'Context') AS c, count(*) FILTER (component_type = 'Service' AND complexity > 50) AS x FROM components GROUP BY repo)
       SELECT repo, 'Consider organizing components into domain-specific modules based on business capabilities' AS description, 'Medium' AS effort FROM k WHERE s > 5 AND c > 3
       UNION ALL SELECT repo, 'Large number of services suggests potential for microservices decomposition', 'Large' FROM k WHERE s > 8 UNION ALL SELECT repo, 'Complex services may benefit from caching to improve performance', 'Small' FROM k WHERE x > 0""".replace("WITH k AS (", "SELECT * FROM (WITH k AS (").rstrip() + ")",
)
def _(c):
    return insights.recommendations(c.components)


@query(
    "y3_refactoring_opportunities",
    f"""SELECT repo, path, 'very high complexity' AS kind, 'Medium' AS effort FROM components WHERE complexity > 80 UNION ALL SELECT repo, path, 'high coupling', 'Large' FROM components WHERE len(imports) > 8
        UNION ALL SELECT repo, path, 'not fully implemented', CASE WHEN complexity > 50 THEN 'Large' ELSE 'Medium' END FROM components WHERE {_OPEN}""",
)
def _(c):
    return insights.refactoring(c.components)


cte(
    "metrics_raw",
    """SELECT repo, 1 - cx / CAST(n AS DOUBLE) / 100e0 AS easy, greatest(1 - coalesce(high, 0) / CAST(n AS DOUBLE), 0e0) AS debt, done / CAST(n AS DOUBLE) * 6e-1 + (1 - cx / CAST(n AS DOUBLE) / 100e0) * 4e-1 AS tests, CASE WHEN svc THEN 6e-1 ELSE 4e-1 END AS docs FROM
       (SELECT repo, CAST(sum(complexity) AS BIGINT) AS cx, count(*) AS n, count(*) FILTER (status = 'Complete') AS done, bool_or(component_type = 'Service') AS svc FROM components GROUP BY repo) LEFT JOIN (SELECT repo, count(*) AS high FROM technical WHERE severity = 'High' GROUP BY repo) USING (repo)""",
)
cte("metrics", f"SELECT repo, {rnd('easy')} AS maintainability, {rnd('easy')} AS complexity, {rnd('debt')} AS technical_debt, {rnd('tests')} AS test_coverage, docs AS documentation, {rnd('(easy + easy + debt + tests + docs) / 5')} AS overall FROM metrics_raw")


@query("y4_quality_metrics", "SELECT * FROM metrics")
def _(c):
    return c.metrics


_VALUE = f"least(greatest(({case_map('priority', insights.PRIORITY_VALUE)} + {case_map('complexity', insights.COMPLEXITY_VALUE)} + {case_map('status', insights.STATUS_VALUE)}) / 20e0, 0e0), 1e0)"


@query("y5_story_value", f"SELECT repo, id, {_VALUE} AS value FROM stories")
def _(c):
    return c.stories.select("repo", "id", insights.story_value(F.col("priority"), F.col("complexity"), F.col("status")).alias("value"))


cte(
    "story_components",
    """SELECT s.repo, s.id, g.name AS component, g.path AS component_path, g.status, g.complexity, g.imports FROM stories AS s JOIN comp_groups AS g ON g.repo = s.repo AND ((s.rank < 100 AND g.language = 'typescript' AND g.g = s.story_group) OR (s.rank = 100 AND g.path = s.path))""",
)
cte("risks", "SELECT s.repo, s.id, CASE WHEN f.status = 'Todo' THEN 'High' WHEN f.status IN ('Incomplete', 'InProgress') THEN 'Medium' WHEN f.status = 'Complete' AND f.complexity > 70 THEN 'Medium' ELSE 'Low' END AS risk FROM stories AS s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY component_path) AS k FROM story_components) AS f ON f.repo = s.repo AND f.id = s.id AND k = 1")


@query("y6_story_risk", "SELECT repo, id, risk FROM risks")
def _(c):
    return c.risks


@query("y7_story_dependencies", "SELECT DISTINCT repo, id, dependency FROM (SELECT repo, id, unnest(imports) AS dependency FROM story_components) WHERE NOT starts_with(dependency, 'std') AND NOT starts_with(dependency, 'java.')")
def _(c):
    return insights.story_dependencies(c.story_components)


_CRIT = [(t, i + 1, x) for _, t, _, _, cs in K.STORIES for i, x in enumerate(cs)]
_NAMED = lambda cs: "[" + ", ".join((f"concat({q(x.split('%s')[0])}, story_group, {q(x.split('%s')[1])})" if "%s" in x else q(x)) for x in cs) + "]"


@query(
    "y8_acceptance_tests",
    f"""SELECT repo, id, step, concat('Test ', step, ' - ', criterion) AS scenario, concat('Given the user wants to ', lower(title)) AS given, concat('When they ', lower(criterion)) AS when_text, 'Then the system should respond appropriately' AS then_text FROM
        (SELECT repo, id, s.title, step, criterion FROM stories AS s JOIN {values(_CRIT, "title, step, criterion", "c")} ON c.title = s.title AND s.rank < 100
         UNION ALL SELECT repo, id, title, unnest(range(1, 4)), unnest(cs) FROM (SELECT *, CASE WHEN title LIKE 'View %' OR (title LIKE 'Use %' AND title NOT LIKE '% service') THEN {_NAMED(K.DISPLAY_CRITERIA)} ELSE {_NAMED(K.SERVICE_CRITERIA)} END AS cs FROM stories WHERE rank = 100))""",
)
def _(c):
    return insights.acceptance_tests(c.stories).drop("title")


@query(
    "y9_business_insights",
    f"SELECT repo, 'UserExperience' AS kind, count(*) AS n FROM components WHERE component_type = 'Form' GROUP BY repo UNION ALL SELECT repo, 'FeaturePriority', count(*) FROM stories WHERE {_VALUE} > 7e-1 GROUP BY repo UNION ALL SELECT repo, 'RiskAssessment', count(*) FROM risks WHERE risk IN ('High', 'Critical') GROUP BY repo",
)
def _(c):
    return insights.business(c.components, c.stories, c.risks)


@query(
    "y10_pattern_library",
    " UNION ALL ".join(f"SELECT repo, path, '{k}' AS kind, {q(n)} AS pattern FROM components WHERE {has_any('lower(name)' if k == 'business' else 'name', ws)}" for k, n, ws in insights.PATTERNS)
    + f" UNION ALL SELECT repo, path, 'anti', 'God Object' FROM components WHERE complexity > {insights.GOD_COMPLEXITY} OR len(api_calls) > {insights.GOD_METHODS}",
)
def _(c):
    return insights.patterns(c.components)


@query(
    "y11_executive_grades",
    f"""SELECT repo, CASE WHEN overall >= 9e-1 THEN 'A' WHEN overall >= 8e-1 THEN 'B' WHEN overall >= 7e-1 THEN 'C' WHEN overall >= 6e-1 THEN 'D' ELSE 'F' END AS grade, CASE WHEN pct >= 90 THEN 'Excellent' WHEN pct >= 70 THEN 'Good' WHEN pct >= 50 THEN 'Fair' ELSE 'Needs work' END AS completion,
        CASE WHEN open = 0 THEN 'Low' WHEN open <= n // 4 THEN 'Medium' ELSE 'High' END AS implementation_risk, CASE WHEN cx = 0 THEN 'Low' WHEN cx <= 3 THEN 'Medium' ELSE 'High' END AS complexity_risk,
        CASE WHEN maintainability >= 8e-1 THEN 'Good' WHEN maintainability >= 6e-1 THEN 'Fair' WHEN maintainability >= 4e-1 THEN 'Poor' ELSE 'Critical' END AS maintainability FROM
        (SELECT repo, count(*) AS n, count(*) FILTER ({_OPEN}) AS open, count(*) FILTER (complexity > 70) AS cx, count(*) FILTER (status = 'Complete') * 100 / CAST(count(*) AS DOUBLE) AS pct FROM components GROUP BY repo) JOIN metrics USING (repo)""",
)
def _(c):
    return insights.grades(c.components, c.metrics)




@query(
    "y12_phased_roadmap",
    f"""SELECT repo, 1 AS phase, 'debt' AS kind, name AS item FROM components WHERE complexity > 80 UNION ALL SELECT repo, 1, 'todo', name FROM components WHERE status = 'Todo' UNION ALL SELECT repo, 2, 'finish', name FROM components WHERE status = 'InProgress'
        UNION ALL SELECT repo, 2, 'story', title FROM stories WHERE priority IN ('High', 'Critical') UNION ALL SELECT repo, 3, 'enhance', 'Architecture Refactoring' FROM metrics WHERE technical_debt > 6e-1 UNION ALL SELECT repo, 3, 'enhance', 'Testing Enhancement' FROM metrics WHERE test_coverage < 7e-1
        UNION ALL SELECT repo, 3, 'enhance', 'Complexity Reduction' FROM metrics WHERE complexity > 8e-1 UNION ALL SELECT repo, 3, 'enhance', 'Integration Expansion' FROM metrics AS m WHERE NOT EXISTS (SELECT 1 FROM files AS f WHERE f.repo = m.repo AND f.path = 'package.json' AND {has_any("content", ['"axios"', '"fetch"'])})
        UNION ALL SELECT repo, 3, 'enhance', unnest(['Performance Optimization', 'Documentation & Knowledge Transfer']) FROM metrics""",
)
def _(c):
    return insights.roadmap(c.components, c.stories, c.metrics, comp_ops.integration_points(c.files).where("kind = 'service'"))


# --- corrections: repositories whose documents carry labels are the reviewed ones -----

_REPO = "concat('shop-unit-', CAST(CAST(floor(doc_id / 40) AS BIGINT) AS STRING))"
cte("reviewed", f"SELECT {_REPO} AS repo, CAST(max(quality) AS BIGINT) AS good, count(*) AS reviews, CAST(sum(toxic) AS BIGINT) AS flagged FROM labels GROUP BY 1")


@frame("reviewed")
def _(c):
    return c.table("labels").groupBy(F.expr(_REPO).alias("repo")).agg(F.max("quality").cast("bigint").alias("good"), F.count("*").alias("reviews"), F.sum("toxic").alias("flagged"))


def _fixes(c):
    return c.reviewed.where("good = 1 AND flagged > 0").select("repo", F.lit("Reviewed product").alias("fixed_type"), F.when(F.col("reviews") > 10, "Enterprise").alias("market"), F.lit(None).cast("string").alias("model"))


@query(
    "w1_corrections_overlay",
    """SELECT p.repo, coalesce(f.fixed_type, p.display_name) AS product_type, coalesce(f.market, 'General market') AS market_segment, 'Not specified' AS business_model, f.repo IS NOT NULL AS corrected FROM profile AS p
       LEFT JOIN (SELECT repo, 'Reviewed product' AS fixed_type, CASE WHEN reviews > 10 THEN 'Enterprise' END AS market FROM reviewed WHERE good = 1 AND flagged > 0) AS f USING (repo)""",
)
def _(c):
    return corrections.overlay(c.profile.select("repo", F.col("display_name").alias("product_type")), _fixes(c))


@query(
    "w2_batch_corrections",
    "SELECT repo, n, trim(persona) AS persona, concat('Primary user of ', display_name) AS description, 'High' AS priority FROM (SELECT repo, display_name, unnest(range(1, len(us) + 1)) AS n, unnest(us) AS persona FROM (SELECT repo, display_name, string_split(concat('analyst, ', package_manager, ' user'), ',') AS us FROM profile JOIN reviewed USING (repo)))",
)
def _(c):
    b = c.profile.join(c.reviewed, "repo").select("repo", F.col("display_name").alias("context"), F.concat(F.lit("analyst, "), "package_manager", F.lit(" user")).alias("users"))
    return corrections.batch_personas(b)


@query(
    "w3_confidence_change",
    f"SELECT repo, {rnd('confidence')} AS context_before, 85e-2 AS context_after, CASE WHEN entry_points = 0 THEN 0e0 ELSE 6e-1 END AS personas_before, 9e-1 AS personas_after, 5e-1 AS priorities_before, CASE WHEN reviews IS NOT NULL THEN 85e-2 ELSE 5e-1 END AS priorities_after, 25e-2 AS overall FROM profile LEFT JOIN reviewed USING (repo)",
)
def _(c):
    o = c.profile.select("repo", "confidence", F.col("entry_points").alias("personas")).join(c.reviewed.select("repo", "reviews"), "repo", "left")
    return corrections.confidence_change(o, F.col("reviews").isNotNull())


@query(
    "w4_before_after_comparison",
    f"""SELECT a.repo, entry_points AS items_before, reviews AS items_after, {rnd("0.85::DOUBLE - confidence")} AS gain, CASE WHEN {rnd("0.85::DOUBLE - confidence")} > 2e-1 THEN 'significant' WHEN {rnd("0.85::DOUBLE - confidence")} > 1e-1 THEN 'good' ELSE 'minimal' END AS verdict FROM profile AS a JOIN reviewed AS b USING (repo)""",
)
def _(c):
    return corrections.compare(c.profile.select("repo", "confidence", F.col("entry_points").alias("items")), c.reviewed.select("repo", F.lit(0.85).alias("confidence"), F.col("reviews").alias("items")))


_SHARE = "(complete / CAST(total AS DOUBLE))"
_SC = f"least({_SHARE} * 3 + CASE WHEN pats > 0 THEN 25e-1 ELSE 0e0 END + 2e0 + CASE WHEN reviews IS NOT NULL THEN 15e-1 ELSE 5e-1 END + CASE WHEN debt_items > 0 THEN 1e0 ELSE 5e-1 END, 10e0)"


@query(
    "w5_readiness_grades",
    f"""SELECT repo, {rnd(_SHARE)} AS completion, {rnd(_SC)} AS context_score, CASE {" ".join(f"WHEN {_SHARE} >= {b}::DOUBLE THEN {q(s)}" for b, s in corrections.STAGES)} ELSE {q(corrections.FIRST_STAGE)} END AS stage,
        CASE WHEN {_SC} / 10 >= 8e-1 THEN 'excellent' WHEN {_SC} / 10 >= 6e-1 THEN 'good' ELSE 'low' END AS grade, CASE WHEN {_SC} / 10 >= 9e-1 THEN 'HIGH' WHEN {_SC} / 10 >= 7e-1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level
        FROM component_completion LEFT JOIN reviewed USING (repo) LEFT JOIN (SELECT repo, count(*) AS pats FROM dispatched GROUP BY repo) USING (repo)""",
)
def _(c):
    p = c.dispatched.groupBy("repo").agg(F.count("*").alias("patterns"))
    counts = comp_ops.completion(c.components).join(p, "repo", "left").join(c.reviewed.select("repo", "reviews"), "repo", "left")
    return corrections.readiness(counts.select("repo", "complete", "total", "patterns", F.col("debt_items").alias("debt"), F.col("reviews").isNotNull().alias("validated")))


# --- batch scoring on conversations ---------------------------------------------------

@frame("batched")
def _(c):
    return cut_lineage(scoring.batches(c.table("conversations"), "role", ["conv_id", "turn"]))


@frame("prompts")
def _(c):
    return scoring.prompts(c.batched, "role")


def _batched_sql(rows: str, key: str, order: str) -> str:
    chars, budget = scoring.part_chars(scoring.BUDGET), scoring.BUDGET
    return f"""SELECT *, row_number() OVER (PARTITION BY {key}, batch ORDER BY ahead) - 1 AS slot FROM (SELECT *, CAST(ahead // {budget - budget // 4} AS BIGINT) AS batch FROM
        (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {key} ORDER BY {order}, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM
         (SELECT * REPLACE (substr(text, part * {chars} + 1, {chars}) AS text), CAST(ceil(length(substr(text, part * {chars} + 1, {chars})) / {scoring.TOKEN_CHARS}) + {scoring.ITEM_TOKENS} AS BIGINT) AS tokens FROM
          (SELECT *, unnest(range(0, CAST(greatest(ceil(length(text) / {chars}), 1) AS BIGINT))) AS part FROM {rows}))))"""


cte("turns", "SELECT role, conv_id, turn, coalesce(text, '') AS text FROM conversations")
cte("batched", _batched_sql("turns", "role", "conv_id, turn"))
cte(
    "prompts",
    "SELECT role, batch, count(*) AS segments, concat('Analyse the following segments.', chr(10), string_agg(concat('Segment ', slot + 1, ': ', text), chr(10) ORDER BY slot), chr(10), 'Reply with JSON.') AS prompt FROM batched GROUP BY role, batch",
)
_KW = case_any("lower(prompt)", scoring.DOMAIN_KEYWORDS, None)
cte(
    "scored",
    f"""SELECT role, batch, CASE WHEN d IS NULL THEN '{{"segments":[{{"primary_domain":null,"confidence":0.0,"evidence":[]}}]}}' ELSE concat('{{"segments":[{{"primary_domain":"', d, '","confidence":0.7,"evidence":[]}}]}}') END AS reply, d FROM (SELECT *, {_KW} AS d FROM prompts)""",
)


@query("v1_batch_packing", "SELECT role, conv_id, turn, CAST(part AS INT) AS part, tokens, batch, slot FROM batched")
def _(c):
    return c.batched.select("role", "conv_id", "turn", "part", "tokens", "batch", "slot")


_PLACE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, (k, _) in enumerate(scoring.PARTS)) + " END"
_HEAD = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{h}'" for k, h in scoring.PARTS) + " END"
cte(
    "project_items",
    f"""SELECT repo, {_PLACE} AS place, kind, text, text AS name FROM (SELECT DISTINCT repo, kind, text FROM (SELECT repo, kind, item AS text FROM items UNION ALL SELECT repo, 'segment', concat_ws(' ', segment_type, name) FROM segments) WHERE text <> '')""",
)
cte("project_batches", _batched_sql("project_items", "repo", "place, name"))


@query(
    "v2_project_prompts",
    f"""SELECT repo, batch, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens, md5(concat('Analyse the following segments.', chr(10), string_agg(concat(head, '- ', text), chr(10) ORDER BY slot), chr(10), 'Reply with JSON.')) AS prompt_md5
        FROM (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY repo, batch ORDER BY slot) = kind THEN '' ELSE concat({_HEAD}, ':', chr(10)) END AS head FROM project_batches) GROUP BY repo, batch""",
)
def _(c):
    batched = scoring.batches(scoring.project_items(c.items, c.segments), "repo", ["place", "name"])
    return scoring.project_prompts(batched).select("repo", "batch", "items", "tokens", F.md5("prompt").alias("prompt_md5"))


@query("v2_prompt_assembly", "SELECT role, CAST(batch AS BIGINT) AS batch, segments, md5(prompt) AS prompt_md5 FROM prompts")
def _(c):
    return c.prompts.select("role", "batch", "segments", F.md5("prompt").alias("prompt_md5"))


@query("v3_batch_scoring", "SELECT role, CAST(batch AS BIGINT) AS batch, reply FROM scored")
def _(c):
    return scoring.score(c.prompts, "role").drop("error")


# Replies in three forms: plain JSON, JSON inside text, free text that mentions a word.
_REPLY = (
    "CASE turn % 3 WHEN 0 THEN concat('{\"segments\":[{\"primary_domain\":\"', upper(role), '\",\"confidence\":0.', CAST(conv_id % 9 + 1 AS STRING), ',\"evidence\":[\"e\"]}]}') "
    "WHEN 1 THEN concat('Here it is: {\"segments\":[{\"primary_domain\":\"Domain ', CAST(conv_id % 5 AS STRING), '\"}]} done') "
    "ELSE concat(CASE conv_id % 4 WHEN 0 THEN 'About payment: ' WHEN 1 THEN 'The user wants ' WHEN 2 THEN 'E-Commerce ' ELSE '' END, text) END"
)
cte("replies", f"SELECT concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)) AS id, role, turn, {_REPLY} AS reply FROM conversations")
_ISJ = "turn % 3 < 2"
_JS = "regexp_extract(reply, '(?s)([{].*[}])', 1)"


@frame("replies")
def _(c):
    return c.table("conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "role", "turn", F.expr(_REPLY).alias("reply"))


_PARSED = f"""SELECT id, role, CASE WHEN {_ISJ} THEN 'json' ELSE 'text' END AS form, CASE WHEN {_ISJ} THEN json_extract_string({_JS}, '$.segments[0].primary_domain') ELSE {case_any("lower(reply)", scoring.DOMAIN_KEYWORDS, None)} END AS domain,
    CASE WHEN {_ISJ} THEN coalesce(CAST(json_extract_string({_JS}, '$.segments[0].confidence') AS DOUBLE), 0e0) ELSE 5e-1 END AS confidence, CASE WHEN NOT {_ISJ} THEN reply END AS evidence FROM replies"""
cte("parsed", _PARSED)


@query("v4_reply_parsing", "SELECT id, form, domain, confidence FROM parsed")
def _(c):
    return scoring.parse(c.replies).select("id", "form", "domain", "confidence")


@query("v6_keyword_fallback", "SELECT id, domain, md5(evidence) AS evidence_md5 FROM parsed WHERE form = 'text'")
def _(c):
    return scoring.parse(c.replies).where("form = 'text'").select("id", "domain", F.md5("evidence").alias("evidence_md5"))


_REQ = (
    "concat('{\"functional_requirements\":{\"domains\":{\"', role, '\":{\"segment_ids\":[\"s', CAST(turn AS STRING), '\",\"s', CAST(turn + 1 AS STRING), '\"],\"confidence\":0.', CAST(conv_id % 9 + 1 AS STRING), ',\"evidence\":[]}}},"
    "\"non_functional_requirements\":{\"domains\":{\"Speed\":{\"segment_ids\":[\"s', CAST(conv_id % 3 AS STRING), '\"]}}}}')"
)


@query(
    "v5_requirement_explosion",
    """SELECT id, unnest([concat('s', turn), concat('s', turn + 1)]) AS segment_id, concat(role, ' (Functional)') AS domain, (conv_id % 9 + 1) / 10e0 AS confidence FROM (SELECT *, concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)) AS id FROM conversations)
       UNION ALL SELECT concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)), concat('s', conv_id % 3), 'Speed (Non-Functional)', 0e0 FROM conversations""",
)
def _(c):
    return scoring.requirements(c.table("conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.expr(_REQ).alias("reply")))


@query("v7_scoring_summary", f"SELECT role, count(*) AS segments, count(domain) AS with_domain, {rnd('coalesce(sum(confidence) FILTER (confidence > 0) / count(*) FILTER (confidence > 0), 0e0)')} AS mean_confidence FROM parsed GROUP BY role")
def _(c):
    return scoring.summary(scoring.parse(c.replies), "role")


_PROJ = (
    "CASE turn % 2 WHEN 0 THEN concat('Reply: {\"project_classification\":{\"inferred_project_type\":\"Web Application\"},\"business_domain_analysis\":{\"primary_domain\":\"', role, '\",\"domain_confidence\":0.', CAST(conv_id % 9 + 1 AS STRING), "
    "',\"feature_analysis\":[{\"feature_name\":\"f', CAST(turn AS STRING), '\",\"implementation_status\":\"partial\"},{\"feature_name\":\"g\",\"implementation_status\":\"done\"}]},\"confidence_metrics\":{\"context_coverage\":0.25}}') ELSE text END"
)


@query(
    "v8_structured_project_reply",
    """SELECT id, project_type, 5e-1 AS type_confidence, domain, domain_confidence, coverage, 6e-1 AS certainty, 7e-1 AS analysis, f.feature_name AS feature_name, f.implementation_status AS implementation_status FROM
       (SELECT *, unnest(fs) AS f FROM (SELECT concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)) AS id, CASE turn % 2 WHEN 0 THEN 'web_application' ELSE 'unknown' END AS project_type, CASE turn % 2 WHEN 0 THEN role ELSE 'Unknown' END AS domain,
        CASE turn % 2 WHEN 0 THEN (conv_id % 9 + 1) / 10e0 ELSE 5e-1 END AS domain_confidence, CASE turn % 2 WHEN 0 THEN 25e-2 ELSE 8e-1 END AS coverage,
        CASE turn % 2 WHEN 0 THEN [{'feature_name': concat('f', turn), 'implementation_status': 'partial'}, {'feature_name': 'g', 'implementation_status': 'done'}] ELSE [{'feature_name': NULL, 'implementation_status': NULL}] END AS fs FROM conversations))""",
)
def _(c):
    return scoring.project_reply(c.table("conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.expr(_PROJ).alias("reply")))


@query(
    "v9_context_first_fallback",
    f"SELECT id, CASE WHEN contains(lower(reply), 'payment') THEN 'Payment' WHEN contains(lower(reply), 'system') THEN 'System' WHEN turn % 2 = 0 THEN concat('Hint ', role) ELSE {case_any('lower(reply)', scoring.DOMAIN_KEYWORDS, None)} END AS domain FROM replies",
)
def _(c):
    r = c.replies.withColumn("domains", F.array(F.lit("Payment"), F.lit("System"))).withColumn("hints", F.when(F.col("turn") % 2 == 0, F.array(F.concat(F.lit("Hint "), "role"))).otherwise(F.array().cast("array<string>")))
    return scoring.context_domain(r)


# --- history: orders as commits, line items as touched files ----------------------------


# Repositories by the orders' key, so that a file path lies in several of them.
_COMMIT_REPO = "concat('shop-unit-', CAST({key} % 7 AS STRING))"


@frame("commits")
def _(c):
    return c.table("orders").select(
        F.expr(_COMMIT_REPO.format(key="o_orderkey")).alias("repo"),
        F.col("o_orderkey").alias("seq"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"), F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@example.org")).alias("author_email"),
        F.concat(F.lit("Dev "), "o_orderpriority").alias("author_name"), F.col("o_orderdate").alias("ts"), F.concat(F.lit("Change "), F.col("o_orderkey").cast("string"), F.lit("\nstatus "), "o_orderstatus").alias("message"),
    )


@frame("commit_files")
def _(c):
    return c.table("lineitem").select(
        F.expr(_COMMIT_REPO.format(key="l_orderkey")).alias("repo"), F.md5(F.col("l_orderkey").cast("string")).alias("hash"), F.concat(F.lit("src/part_"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path")
    )


cte("commits", f"SELECT {_COMMIT_REPO.format(key='o_orderkey')} AS repo, o_orderkey AS seq, md5(CAST(o_orderkey AS VARCHAR)) AS hash, concat('user', o_custkey, '@example.org') AS author_email, concat('Dev ', o_orderpriority) AS author_name, o_orderdate AS ts, concat('Change ', o_orderkey, chr(10), 'status ', o_orderstatus) AS message FROM orders")
cte("commit_files", f"SELECT {_COMMIT_REPO.format(key='l_orderkey')} AS repo, md5(CAST(l_orderkey AS VARCHAR)) AS hash, concat('src/part_', l_partkey, '.py') AS path FROM lineitem")


@query("a1_contributors", "SELECT repo, author_email, count(*) AS commits, min_by(author_name, seq) AS author_name FROM commits GROUP BY repo, author_email")
def _(c):
    return history.contributors(c.commits)


@query(
    "a2_recent_commits",
    """SELECT t.repo, left(t.hash, 8) AS short_hash, seq, CAST(ts AS VARCHAR) AS ts, author_name, string_split(message, chr(10))[1] AS title, (SELECT count(*) FROM commit_files AS f WHERE f.repo = t.repo AND f.hash = t.hash) AS files_changed
       FROM (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ts DESC, seq DESC) <= 100) AS t""",
)
def _(c):
    return history.recent_commits(c.commits, c.commit_files, 100).withColumn("ts", F.col("ts").cast("string"))


@query("a3_file_churn", "SELECT f.repo, path, count(DISTINCT f.hash) AS commits FROM commit_files AS f JOIN (SELECT repo, hash FROM commits WHERE seq > 0) AS t ON t.repo = f.repo AND t.hash = f.hash GROUP BY f.repo, path")
def _(c):
    return history.churn(c.commits, c.commit_files)


_KEYS = ", ".join(q(k) for k in history.KEY_FILES)
cte(
    "fingerprints",
    f"""SELECT repo, sha256(concat_ws('|', ks, ds)) AS fingerprint FROM repos LEFT JOIN (SELECT repo, string_agg(concat_ws('|', path, length, modified), '|' ORDER BY list_position([{_KEYS}], path)) AS ks FROM files WHERE path IN ({_KEYS}) GROUP BY repo) USING (repo)
        LEFT JOIN (SELECT repo, string_agg(d, '|' ORDER BY d) AS ds FROM (SELECT DISTINCT repo, string_split(path, '/')[1] AS d FROM files WHERE contains(path, '/')) WHERE NOT starts_with(d, '.') AND d NOT IN ('target', 'node_modules') GROUP BY repo) USING (repo)""",
)


@frame("fingerprints")
def _(c):
    return cut_lineage(history.fingerprint(c.repos, c.files))


@query("a4_project_fingerprint", "SELECT repo, fingerprint, sha256(concat(repo, 'full', '1.0')) AS cache_key FROM fingerprints")
def _(c):
    return c.fingerprints.withColumn("cache_key", history.state_key(F.col("repo"), F.lit("full"), F.lit("1.0")))


# Saved state: reviewed repositories were analysed; some long ago, some with another content or version.
cte(
    "saved_state",
    "SELECT f.repo, 'full' AS analysis, CASE WHEN flagged > 1 THEN 'changed' ELSE fingerprint END AS fingerprint, TIMESTAMP '2024-01-02 00:00:00' - to_hours(CAST(reviews * 2 AS BIGINT)) AS ts, CASE WHEN good = 1 THEN '1.0' ELSE '0.9' END AS version FROM fingerprints AS f JOIN reviewed USING (repo)",
)


@frame("saved_state")
def _(c):
    return c.fingerprints.join(c.reviewed, "repo").select(
        "repo", F.lit("full").alias("analysis"), F.when(F.col("flagged") > 1, "changed").otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.expr("TIMESTAMP '2024-01-02 00:00:00' - make_interval(0, 0, 0, 0, cast(reviews * 2 as int), 0, 0)").alias("ts"), F.when(F.col("good") == 1, "1.0").otherwise("0.9").alias("version"),
    )


cte("fresh_state", "SELECT s.* FROM saved_state AS s JOIN fingerprints AS f ON f.repo = s.repo AND f.fingerprint = s.fingerprint WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 24 HOUR AND version = '1.0'")
_NOW = "TIMESTAMP '2024-01-02 00:00:00'"


def _fresh(c):
    return history.fresh(c.saved_state, c.fingerprints, F.expr(_NOW), "1.0")


@query("a5_freshness", "SELECT repo, analysis, version, CAST(ts AS VARCHAR) AS ts FROM fresh_state")
def _(c):
    return _fresh(c).select("repo", "analysis", "version", F.col("ts").cast("string").alias("ts"))


@query("a6_incremental_selection", "SELECT repo, fingerprint FROM fingerprints AS f WHERE NOT EXISTS (SELECT 1 FROM fresh_state AS s WHERE s.repo = f.repo AND s.fingerprint = f.fingerprint)")
def _(c):
    return history.stale(c.fingerprints, _fresh(c))


_GONE, _LATE = "length % 5 = 0", "length % 3 = 0"  # files that are deleted, and that are first seen with their first half


@query("a6_incremental_changes", f"SELECT repo, path, line_no, marker, description FROM todos JOIN (SELECT repo, path FROM files WHERE NOT ({_GONE})) USING (repo, path)")
def _(c):
    """Which markers hold after files were added, edited, deleted and delivered again, without a full run?"""
    from repograin.operators import markers
    from repograin.session import new_folder
    from repograin.sources.corpus import marker_files
    from repograin.streaming import incremental

    files = marker_files(c.files).select("repo", "path", "ext", "lang", "length", F.col("modified").cast("bigint").alias("modified"), "content")
    half = F.substring("content", F.lit(1), (F.length("content") / 2).cast("int"))
    first = files.withColumn("content", F.when(F.expr(_LATE), half).otherwise(F.col("content"))).withColumn("deleted", F.lit(False))
    edits = files.where(_LATE).withColumn("modified", F.col("modified") + 1).withColumn("deleted", F.lit(False))
    gone = files.where(_GONE).withColumn("modified", F.col("modified") + 2).withColumn("content", F.lit(None).cast("string")).withColumn("deleted", F.lit(True))
    inbox, target, offsets = (new_folder(c.spark, n) for n in ("inbox", "kept", "offsets"))
    for batch in (first, edits, gone, first):  # the last is delivered a second time
        batch.write.mode("append").parquet(inbox)
        stream = incremental.stream_files(c.spark, inbox, schema=incremental.CHANGES_SCHEMA)
        incremental.maintain(stream, markers.scan, target, offsets).awaitTermination()
    return incremental.current(c.spark, target).select("repo", "path", "line_no", "marker", "description")


# --- templates and run metrics on orders and events ----------------------------------------


@query("o1_template_rendering", "SELECT o_orderkey, concat('Order ', o_orderkey, ' of ', o_custkey, ' is ', o_orderstatus, ' {unknown}') AS text FROM orders")
def _(c):
    s = lambda x: F.col(x).cast("string")
    v = F.create_map(F.lit("id"), s("o_orderkey"), F.lit("customer"), s("o_custkey"), F.lit("status"), F.col("o_orderstatus"))
    return c.table("orders").select("o_orderkey", run_metrics.render(F.lit("Order {id} of {customer} is {status} {unknown}"), v).alias("text"))


@query("o2_lookup_with_default", "SELECT c_custkey, c_nationkey, coalesce(n.n_name, (SELECT n_name FROM nation WHERE n_nationkey = 0)) AS value FROM customer AS c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) AS n ON n.n_nationkey = c.c_nationkey")
def _(c):
    nation = c.table("nation")
    named = nation.where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    table = named.unionByName(nation.where("n_nationkey = 0").select(F.lit("default").alias("key"), F.col("n_name").alias("value")))
    rows = c.table("customer").select("c_custkey", "c_nationkey", F.col("c_nationkey").cast("string").alias("nation"))
    return run_metrics.lookup_default(rows, table, "nation").select("c_custkey", "c_nationkey", "value")


@frame("gaps")
def _(c):
    return run_metrics.phase_gaps(c.table("events").select(F.col("user_id").alias("run"), F.col("event_type").alias("phase"), "ts", F.col("event_id").alias("seq")))


cte("gaps", "SELECT user_id AS run, event_type AS phase, event_id AS seq, ts AS started, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000e0 AS seconds FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
cte("durations", "SELECT run, phase, max_by(seconds, (started, seq)) AS seconds, count(*) AS times FROM gaps WHERE seconds IS NOT NULL GROUP BY run, phase")


@query("o5_phase_durations", "SELECT run, phase, seconds, times FROM durations")
def _(c):
    return run_metrics.phase_durations(c.gaps)


@query("o3_phase_bottlenecks", f"SELECT run, phase, {rnd('seconds')} AS seconds, {rnd('seconds / total * 100')} AS share, 'Consider optimization opportunities for this phase' AS advice FROM durations JOIN (SELECT run, sum(seconds) AS total FROM durations GROUP BY run) USING (run) WHERE seconds / total * 100 > 20")
def _(c):
    return run_metrics.bottlenecks(run_metrics.phase_durations(c.gaps))


_RATE = "CASE WHEN h + m = 0 THEN 0e0 ELSE h / CAST(h + m AS DOUBLE) END"


@query(
    "o4_cache_hit_rate_and_grade",
    f"""SELECT run, h AS hits, m AS misses, {rnd(_RATE)} AS rate, CASE {" ".join(f"WHEN fps > {a}::DOUBLE AND {_RATE} > {b}::DOUBLE THEN '{g}'" for a, b, g in run_metrics.GRADES)} ELSE 'D' END AS grade FROM
        (SELECT user_id AS run, count(*) FILTER (event_type <> 'error') AS h, count(*) FILTER (event_type = 'error') AS m, count(*) / 10e0 AS fps FROM events GROUP BY user_id)""",
)
def _(c):
    e = c.table("events").groupBy(F.col("user_id").alias("run")).agg(F.count_if(F.col("event_type") != "error").alias("hits"), F.count_if(F.col("event_type") == "error").alias("misses"), (F.count("*") / 10.0).alias("fps"))
    rate = run_metrics.hit_rate(F.col("hits"), F.col("misses"))
    return e.select("run", "hits", "misses", r6(rate).alias("rate"), run_metrics.grade(F.col("fps"), rate).alias("grade"))


@query("o6_target_check", "SELECT run, n AS files, floor(s) < CASE WHEN n < 100 THEN 30 WHEN n < 500 THEN 120 ELSE 300 END AS meets FROM (SELECT user_id AS run, count(*) AS n, max(value) AS s FROM events GROUP BY user_id)")
def _(c):
    e = c.table("events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("files"), F.max("value").alias("s"))
    return e.select("run", "files", run_metrics.meets_target(F.col("files"), F.col("s")).alias("meets"))


# --- exports ---------------------------------------------------------------------------------

_STATE = "CASE status WHEN 'Complete' THEN 'completed' WHEN 'InProgress' THEN 'in_progress' ELSE 'todo' END"


@query(
    "k2_feature_status_json",
    f"""SELECT repo, 'header' AS kind, concat('{{"completed":', count(*) FILTER ({_STATE} = 'completed'), ',"in_progress":', count(*) FILTER ({_STATE} = 'in_progress'), ',"todo":', count(*) FILTER ({_STATE} = 'todo'), '}}') AS json, '' AS path FROM components GROUP BY repo
        UNION ALL SELECT repo, {_STATE}, concat('{{"name":"', name, '","component_type":"', component_type, '","complexity":', complexity, '}}'), path FROM components""",
)
def _(c):
    return exports.feature_status(c.components)


_NUMBERED = case_map("title", {t: "\n".join(f"{i}. {x}" for i, x in enumerate(cs, 1)) for _, t, _, _, cs in K.STORIES})
_BODY = (
    f"concat('**User Story**: ', description, {q(chr(10) * 2 + '## Acceptance Criteria' + chr(10) * 2)}, {_NUMBERED}, {q(chr(10) * 2)}, '**Priority**: ', priority, {q(chr(10))}, "
    f"'**Complexity**: ', complexity, {q(chr(10))}, '**Status**: ', status)"
)


@query(
    "k3_tracker_payloads",
    f"SELECT repo, 'issue' AS kind, id, title, CAST(json_object('title', title, 'body', {_BODY}, 'labels', ['user-story', concat('priority:', lower(priority))]) AS VARCHAR) AS payload FROM stories WHERE priority IN ('High', 'Critical')",
)
def _(c):
    return exports.tracker(c.stories, c.tasks)


@query(
    "k3_marker_tickets",
    f"""SELECT repo, 'ticket' AS kind, id, name AS title, CAST(json_object('title', name, 'body', concat('*Task Description*: ', description, {q(chr(10) * 2)}, '*Priority*: Critical', {q(chr(10))}, '*Status*: Todo', {q(chr(10))}, '*Effort Estimate*: ', effort), 'labels', ['task']) AS VARCHAR) AS payload
        FROM (SELECT repo, concat(path, ':', line_no, ':', column_no) AS id, concat('Resolve ', marker, ' in ', path) AS name, description, {_EFFORT} AS effort FROM todos WHERE priority = 'Critical')""",
)
def _(c):
    """Which urgent work markers become tickets?"""
    from repograin.operators import markers

    tasks = c.todos.select(
        "repo", F.concat_ws(":", "path", "line_no", "column_no").alias("id"), F.concat(F.lit("Resolve "), "marker", F.lit(" in "), "path").alias("name"),
        "description", F.lit("Todo").alias("status"), markers.effort(F.col("description")).alias("effort"), "priority")
    return exports.tickets(tasks)


@query(
    "k3_issue_components",
    "SELECT s.repo, s.id, c.component, c.component_path FROM stories AS s JOIN story_components AS c ON c.repo = s.repo AND c.id = s.id WHERE s.priority IN ('High', 'Critical')",
)
def _(c):
    return exports.issue_components(c.stories, c.story_components)


@query(
    "k4_report_facts",
    """SELECT repo, fact, value FROM (SELECT repo, count(*) AS components, (SELECT count(*) FROM seg_lines AS l WHERE l.repo = c.repo) AS lines, count(*) FILTER (status = 'Complete') AS complete, (SELECT count(*) FROM stories AS s WHERE s.repo = c.repo) AS stories,
       (SELECT count(*) FROM tasks AS t WHERE t.repo = c.repo) AS tasks FROM components AS c GROUP BY repo) UNPIVOT (value FOR fact IN (components, lines, complete, stories, tasks))""",
)
def _(c):
    return exports.report_facts(c.components, c.stories, c.tasks)


@query("k5_stories_by_status", "SELECT repo, CASE WHEN status IN ('Complete', 'InProgress', 'Todo') THEN status ELSE 'New' END AS state, count(*) AS stories, min(title) AS first_title FROM stories GROUP BY ALL")
def _(c):
    return exports.stories_by_status(c.stories)


@query(
    "k1_result_export",
    """SELECT repo, concat('{"ecosystem":"', ecosystem, '","project_type":"', project_type, '","components":', total, ',"stories":', n, '}') AS json FROM ecosystem JOIN types USING (repo) JOIN component_completion USING (repo) JOIN (SELECT repo, count(*) AS n FROM stories GROUP BY repo) USING (repo)""",
)
def _(c):
    n = c.stories.groupBy("repo").agg(F.count("*").alias("stories"))
    wide = c.ecosystem.select("repo", "ecosystem").join(c.types.select("repo", "project_type"), "repo").join(comp_ops.completion(c.components).select("repo", F.col("total").alias("components")), "repo").join(n, "repo")
    return wide.select("repo", F.to_json(F.struct("ecosystem", "project_type", "components", "stories")).alias("json"))


_FACTS = "(SELECT repo, fact, value FROM (" + ORACLES["k4_report_facts"] + "))"
cte(
    "report_rows",
    f"""SELECT repo, 0 AS section, concat(fact, ': ', value) AS line FROM {_FACTS}
        UNION ALL SELECT repo, 1, concat(name, ' (', component_type, ', ', status, ')') FROM components
        UNION ALL SELECT repo, 2, concat(a.method, ' ', a.endpoint) FROM (SELECT repo, unnest(api_calls) AS a FROM components)
        UNION ALL SELECT repo, 3, concat(title, ' [', priority, '] ', status) FROM stories
        UNION ALL SELECT repo, 4, concat(name, ' [', effort, ']') FROM tasks""",
)


def _report(c):
    return reports.rows(exports.report_facts(c.components, c.stories, c.tasks), c.components, comp_ops.endpoints(c.components), c.stories, c.tasks)


@query("k4_report_lists", "SELECT repo, section, line, count(*) AS n FROM report_rows GROUP BY ALL")
def _(c):
    return _report(c).groupBy("repo", "section", "line").agg(F.count("*").alias("n"))


@query("k1_report_sink", "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY section, line) AS line_no, section, line FROM report_rows")
def _(c):
    """Does each written report come back whole and in order?"""
    from repograin.session import new_folder

    return reports.write(_report(c), new_folder(c.spark, "report")).numbered(c.spark)
