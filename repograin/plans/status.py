"""Queries on evidence, conflicts, unified status and completeness."""

from pyspark.sql import functions as F

from repograin.functions.scores import r6
from repograin.operators import conflicts, inference, markers, reality, status

from repograin.plans import documents as docs_plan  # noqa: F401
from repograin.plans import sources as sources_plan  # noqa: F401
from repograin.plans.base import by_position, case_map, cte, fold, frame, has_any, q, query, regex_hits, rnd, words_sql
from repograin.plans.documents import jaccard_sql
from repograin.plans.markers import _EFFORT
from repograin.rules import documents as D
from repograin.rules import reality as R
from repograin.session import cut_lineage
from repograin.sources.corpus import reality_files


@frame("evidence")
def _(c):
    return cut_lineage(reality.all_evidence(reality_files(c.files), c.deps))


@frame("reality")
def _(c):
    return cut_lineage(reality.merge(c.evidence))


@frame("matched")
def _(c):
    return cut_lineage(conflicts.matches(c.claims, c.reality))


@frame("conflicts")
def _(c):
    return conflicts.resolve(c.matched, c.reality)


_FLAT = [(t, i, p) for t, (_, ps) in enumerate(R.EVIDENCE) for i, p in enumerate(ps)]
_TYPES = [t for t, _ in R.EVIDENCE]
_TYPE_NAME = "CASE type_no " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"
_LEVEL = "CASE " + " ".join(f"WHEN points >= {b} THEN '{n}'" for b, n in R.LEVELS) + f" ELSE '{R.LOWEST_LEVEL}' END"
cte(
    "evidence_hits",
    rf"""SELECT repo, path, line_no, regexp_replace(line, '^\s+|\s+\z', '', 'g') AS snippet, {by_position("k", [str(t) for t, _, _ in _FLAT])} AS type_no, {by_position("k", [str(i) for _, i, _ in _FLAT])} AS pattern_no
        FROM (SELECT l.*, unnest({regex_hits(fold("line"), [p for _, _, p in _FLAT])}) AS k FROM all_lines AS l JOIN reality_files USING (repo, path))""",
)
cte(
    "file_evidence",
    f"""SELECT repo, path, type_no, reality_type, snippets, line_numbers, patterns, points, {_LEVEL} AS level, concat_ws(':', '0', path, type_no) AS impl_id,
        concat({case_map("reality_type", R.PHRASES)}, ' ', array_to_string(list_filter(feats, lambda x, i: list_position(feats, x) = i), ', ')) AS description FROM
        (SELECT *, {_TYPE_NAME} AS reality_type, list_transform(snippets, lambda s: array_to_string({words_sql("s")}, ' ')) AS feats,
         least(greatest(30 + 10 * len(snippets) + CASE WHEN CAST(list_sum(list_transform(snippets, lambda s: strlen(s))) AS BIGINT) // len(snippets) > 50 THEN 20 ELSE 0 END
           + CASE WHEN type_no = 6 AND contains(path, 'test') THEN 30 ELSE 0 END + CASE WHEN type_no = 7 AND string_split(path, '/')[-1] = 'Dockerfile' THEN 40 ELSE 0 END
           - CASE WHEN list_min(list_transform(snippets, lambda s: strlen(s))) < 10 THEN 10 ELSE 0 END, 0), 100) AS points FROM
         (SELECT repo, path, type_no, list(snippet ORDER BY line_no, pattern_no) AS snippets, list(line_no ORDER BY line_no, pattern_no) AS line_numbers, list(pattern_no ORDER BY line_no, pattern_no) AS patterns
          FROM evidence_hits GROUP BY repo, path, type_no))""",
)
cte(
    "dep_evidence",
    f"""SELECT repo, manifest AS path, list_position([{", ".join(q(t) for t in _TYPES)}], rt) - 1 AS type_no, rt AS reality_type, [concat('Dependency: ', name)] AS snippets, [0] AS line_numbers, [0] AS patterns,
        {R.DEPENDENCY_POINTS} AS points, 'Partial' AS level, concat_ws(':', '1', manifest, name, scope) AS impl_id, concat('Uses ', name, ' dependency') AS description
        FROM (SELECT *, {case_map("name", R.DEPENDENCY_TYPE)} AS rt FROM deps WHERE manifest IN ('package.json', 'Cargo.toml', 'requirements.txt')) WHERE rt IS NOT NULL""",
)
_EV = "repo, path, type_no, reality_type, snippets, line_numbers, points, level, impl_id, description"
cte("evidence", f"SELECT {_EV} FROM file_evidence UNION ALL SELECT {_EV} FROM dep_evidence")
cte("ev_named", f"SELECT repo, reality_type, description, min(impl_id) AS first_id, list_sort(list_distinct({words_sql('description')})) AS tokens FROM evidence GROUP BY ALL")
cte("ev_nodes", "SELECT repo, reality_type, tokens, min(first_id) AS id, row_number() OVER (PARTITION BY repo, reality_type ORDER BY md5(min(first_id)), min(first_id)) AS n FROM ev_named GROUP BY repo, reality_type, tokens")
cte(
    "ev_adj",
    f"""SELECT a.repo, a.reality_type, a.n, a.id, a.tokens, coalesce(list(b.n) FILTER (b.n IS NOT NULL), []) AS adj FROM ev_nodes AS a LEFT JOIN ev_nodes AS b
        ON b.repo = a.repo AND b.reality_type = a.reality_type AND b.n < a.n AND {jaccard_sql("a.tokens", "b.tokens")} > 7e-1 GROUP BY ALL""",
)
cte(
    "ev_greedy",
    """SELECT repo, reality_type, n, [n] AS leaders FROM ev_nodes WHERE n = 1 UNION ALL
       SELECT g.repo, g.reality_type, g.n + 1, CASE WHEN list_has_any(a.adj, g.leaders) THEN g.leaders ELSE list_append(g.leaders, g.n + 1) END
       FROM ev_greedy AS g JOIN ev_adj AS a ON a.repo = g.repo AND a.reality_type = g.reality_type AND a.n = g.n + 1""",
)
cte("ev_leaders", "SELECT repo, reality_type, max_by(leaders, n) AS leaders FROM ev_greedy GROUP BY ALL")
cte(
    "ev_assigned",
    """SELECT m.repo, m.reality_type, m.description, l.id AS leader FROM ev_named AS m JOIN ev_adj AS a USING (repo, reality_type, tokens) JOIN ev_leaders AS g USING (repo, reality_type)
       JOIN ev_nodes AS l ON l.repo = m.repo AND l.reality_type = m.reality_type AND l.n = CASE WHEN list_contains(g.leaders, a.n) THEN a.n ELSE list_min(list_intersect(a.adj, g.leaders)) END""",
)
_KW = "[" + ", ".join(q(k) for k in D.KEYWORD_BONUS) + "]"
cte("ev_keywords", f"SELECT *, list_filter({_KW}, lambda w: contains(low, w)) AS kws FROM (SELECT *, lower(array_to_string(snippets, chr(10))) AS low FROM evidence JOIN ev_assigned USING (repo, reality_type, description))")
cte(
    "reality_groups",
    """SELECT repo, reality_type, leader AS impl_id, min_by(description, impl_id) AS description, max(points) AS points, CASE WHEN bool_or(level = 'Complete') THEN 'Complete' WHEN bool_or(level = 'Partial') THEN 'Partial' ELSE min_by(level, impl_id) END AS level,
        count(*) AS members, CAST(sum(len(line_numbers)) AS BIGINT) AS hits, flatten(list(kws)) AS kws FROM ev_keywords GROUP BY repo, reality_type, leader""",
)
cte("reality", f"SELECT * EXCLUDE (kws), list_filter({_KW}, lambda k: list_contains(kws, k)) AS snippet_keywords FROM reality_groups")


@query("r1_evidence_per_file", "SELECT repo, path, reality_type, array_to_string(line_numbers, ',') AS line_numbers, md5(array_to_string(snippets, chr(10))) AS snippets_md5, array_to_string(list_transform(patterns, lambda p: concat('Pattern_', p)), ',') AS patterns FROM file_evidence")
def _(c):
    e = reality.evidence(reality_files(c.files))
    return e.select("repo", "path", "reality_type", F.array_join(F.transform("line_numbers", lambda x: x.cast("string")), ",").alias("line_numbers"),
                    F.md5(F.array_join("snippets", "\n")).alias("snippets_md5"), F.array_join("patterns", ",").alias("patterns"))


@query("r2_evidence_confidence", "SELECT repo, path, reality_type, points / 100e0 AS confidence FROM file_evidence")
def _(c):
    return c.evidence.where("impl_id LIKE '0:%'").select("repo", "path", "reality_type", (F.col("points") / 100.0).alias("confidence"))


@query("r3_evidence_level", "SELECT repo, reality_type, level, count(*) AS n FROM file_evidence GROUP BY ALL")
def _(c):
    return c.evidence.where("impl_id LIKE '0:%'").groupBy("repo", "reality_type", "level").agg(F.count("*").alias("n"))


@query("r4_evidence_description", "SELECT repo, impl_id, description FROM file_evidence")
def _(c):
    return c.evidence.where("impl_id LIKE '0:%'").select("repo", "impl_id", "description")


@query("r5_dependency_evidence", "SELECT repo, path, reality_type, description, points / 100e0 AS confidence, level FROM dep_evidence")
def _(c):
    return reality.dependency_evidence(c.deps).select("repo", "path", "reality_type", "description", (F.col("points") / 100.0).alias("confidence"), "level")


@query("r6_merge_similar_evidence", "SELECT repo, reality_type, impl_id, description, points, level, members, hits, array_to_string(snippet_keywords, ',') AS snippet_keywords FROM reality")
def _(c):
    return c.reality.withColumn("snippet_keywords", F.array_join("snippet_keywords", ","))


cte(
    "reality_score",
    f"""SELECT repo, count(*) AS total_implementations, count(*) FILTER (level = 'Complete') AS fully_implemented, count(*) FILTER (level = 'Partial') AS partially_implemented, count(*) FILTER (level = 'Placeholder') AS placeholders,
        {rnd("(count(*) FILTER (level = 'Complete') * 2 + count(*) FILTER (level = 'Partial')) / CAST(count(*) * 2 AS DOUBLE)")} AS implementation_score FROM reality GROUP BY repo""",
)


@query(
    "r7_reality_summary",
    """SELECT f.*, s.total_implementations, s.fully_implemented, s.partially_implemented, s.placeholders, s.implementation_score FROM (SELECT repo, 'type' AS dimension, reality_type AS label, count(*) AS n FROM reality GROUP BY ALL
       UNION ALL SELECT repo, 'level', level, count(*) FROM reality GROUP BY ALL) AS f JOIN reality_score AS s USING (repo)""",
)
def _(c):
    return reality.summary(c.reality)


# --- conflicts ---------------------------------------------------------------

_TOK3 = lambda x: f"list_sort(list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: strlen(w) > 2)))"
_TOK1 = lambda x: f"list_sort(list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> '')))"
cte("claim_tok", f"SELECT *, {_TOK3('description')} AS tok, {_TOK1('description')} AS tok1, {case_map('claim_type', R.CLAIM_TO_EVIDENCE)} AS mapped FROM claims")
cte("reality_tok", f"SELECT *, {_TOK3('description')} AS tok, {_TOK1('description')} AS tok1 FROM reality")
cte(
    "matched",
    f"""SELECT c.repo, c.claim_id, c.claim_type, c.description, c.points, c.priority, c.keywords,
        (SELECT min(impl_id) FROM reality_tok AS e WHERE e.repo = c.repo AND (e.reality_type = c.mapped OR {jaccard_sql("c.tok", "e.tok")} > 7e-1)) AS impl_id FROM claim_tok AS c""",
)
_EXPECTED = "CASE WHEN (m.points > 80 AND m.priority IN ('Critical', 'High')) OR claim_type IN ('Security', 'Api') THEN 'Complete' ELSE 'Partial' END"
_SCORE = f"({case_map('m.priority', R.PRIORITY_WEIGHT)} * 100 + (m.points + e.points) * 15 + {case_map('e.level', R.LEVEL_GAP)} * 100)"
_UP = {"Low": "Medium", "Medium": "High", "High": "Critical", "Critical": "Critical"}
cte(
    "conflicts_raw",
    f"""SELECT m.repo, 'ImplementationMismatch' AS conflict_type, CASE WHEN {_SCORE} >= 9000 THEN 'Critical' WHEN {_SCORE} >= 7000 THEN 'High' WHEN {_SCORE} >= 5000 THEN 'Medium' ELSE 'Low' END AS severity,
          claim_id, impl_id, m.points + e.points AS points2, 'PreferCode' AS base, concat('Implementation level mismatch: claimed as ', lower({_EXPECTED}), ' but implemented as ', e.level) AS description,
          m.description AS claim_text, claim_type, priority AS claim_priority, e.description AS impl_text, e.level AS impl_level, keywords, snippet_keywords
        FROM matched AS m JOIN reality AS e USING (repo, impl_id) WHERE e.level <> {_EXPECTED}
        UNION ALL SELECT repo, 'ClaimedButNotImplemented', sev, claim_id, NULL, points * 2, CASE WHEN points > 80 THEN 'FlagAsInconsistent' ELSE 'PreferCode' END,
          concat('Feature claimed in documentation but not found in code: ', description), description, claim_type, priority, NULL, NULL, keywords, NULL
        FROM (SELECT *, CASE WHEN points > 80 AND claim_type IN ('Security', 'Api') THEN {case_map("priority", _UP)} ELSE priority END AS sev FROM matched WHERE impl_id IS NULL) WHERE NOT (sev = 'Low' AND points < 80)
        UNION ALL SELECT repo, 'ImplementedButNotClaimed', CASE level WHEN 'Complete' THEN 'Medium' ELSE 'Low' END, NULL, impl_id, points * 2, 'Merge', concat('Feature implemented in code but not documented: ', description),
          NULL, NULL, NULL, description, level, NULL, snippet_keywords FROM reality AS e WHERE level IN ('Complete', 'Partial') AND NOT EXISTS (SELECT 1 FROM matched AS m WHERE m.repo = e.repo AND m.impl_id = e.impl_id)""",
)
cte("conflicts", f"SELECT *, points2 / 200e0 AS confidence, {case_map('strategy', R.ACTIONS)} AS action FROM (SELECT *, CASE WHEN severity = 'Critical' THEN 'FlagAsInconsistent' ELSE base END AS strategy FROM conflicts_raw)")


@query("x1_claim_evidence_match", "SELECT repo, claim_id, impl_id FROM matched WHERE impl_id IS NOT NULL")
def _(c):
    return c.matched.where("impl_id IS NOT NULL").select("repo", "claim_id", "impl_id")


@query("x2_expected_level", f"SELECT repo, claim_id, {_EXPECTED} AS expected_level FROM claims AS m")
def _(c):
    return c.claims.select("repo", "claim_id", conflicts.expected_level(F.col("claim_type"), F.col("priority"), F.col("points")).alias("expected_level"))


_CONF = "repo, claim_id, impl_id, severity, confidence, strategy, action, description"


def _conf(name, kind):
    @query(name, f"SELECT {_CONF} FROM conflicts WHERE conflict_type = '{kind}'")
    def _(c):
        return c.conflicts.where(F.col("conflict_type") == kind).select(*[x.strip() for x in _CONF.split(",")])


_conf("x3_level_mismatch", "ImplementationMismatch")
_conf("x4_claimed_not_implemented", "ClaimedButNotImplemented")
_conf("x5_implemented_not_claimed", "ImplementedButNotClaimed")


@query("x6_severity", f"SELECT conflict_type, severity, count(*) AS n, {rnd('avg(confidence)')} AS mean_confidence FROM conflicts GROUP BY ALL")
def _(c):
    return c.conflicts.groupBy("conflict_type", "severity").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("mean_confidence"))


cte(
    "conflict_scores",
    """SELECT repo, coalesce(n, 0) AS total_conflicts, coalesce(crit, 0) AS critical_conflicts, coalesce(flagged, 0) AS flagged_for_review, coalesce(n, 0) - coalesce(flagged, 0) AS resolved_conflicts,
       greatest(10 - coalesce(n, 0) - 3 * coalesce(crit, 0), 0) / 10e0 AS consistency_score FROM repos LEFT JOIN
       (SELECT repo, count(*) AS n, count(*) FILTER (severity = 'Critical') AS crit, count(*) FILTER (strategy = 'FlagAsInconsistent') AS flagged FROM conflicts GROUP BY repo) USING (repo)""",
)


@query("x7_resolution_scores", "SELECT * FROM conflict_scores")
def _(c):
    return conflicts.scores(c.repos, c.conflicts)


@query(
    "x7_resolution_summary",
    " UNION ALL ".join(f"SELECT repo, '{d}' AS dimension, {col} AS label, count(*) AS n FROM conflicts GROUP BY ALL" for d, col in [("type", "conflict_type"), ("severity", "severity"), ("strategy", "strategy")]),
)
def _(c):
    return conflicts.summary(c.conflicts)


# --- status -------------------------------------------------------------------


@query(
    "u1_incomplete_features",
    """SELECT repo, claim_id, claim_text AS feature_name, impl_text AS actual_implementation, CASE impl_level WHEN 'Partial' THEN 5e-1 ELSE 2e-1 END AS completion,
       CASE WHEN len(miss) = 0 THEN 'Unknown missing components' ELSE array_to_string(miss, '|') END AS missing_components FROM
       (SELECT *, list_transform(list_filter(keywords, lambda k: NOT list_contains(snippet_keywords, k)), lambda k: concat('Missing ', k)) AS miss FROM conflicts WHERE claim_id IS NOT NULL AND impl_level IN ('Partial', 'Skeleton'))""",
)
def _(c):
    return status.incomplete_features(c.conflicts).withColumn("missing_components", F.array_join("missing_components", "|"))


@query("u2_missing_implementations", "SELECT repo, claim_id, claim_text AS feature_name, concat('Implementation for ', lower(claim_type)) AS expected_implementation, confidence AS priority_score FROM conflicts WHERE conflict_type = 'ClaimedButNotImplemented'")
def _(c):
    return status.missing_implementations(c.conflicts)


@query("u3_partial_implementations", "SELECT repo, impl_id, description AS feature_name, CASE WHEN points > 80 THEN 'Development' WHEN points > 50 THEN 'Prototype' ELSE 'Skeleton' END AS quality, points / 100e0 AS completion_estimate FROM reality WHERE level = 'Partial'")
def _(c):
    return status.partial_implementations(c.reality)


_ACTIONS = (
    "CASE WHEN status = 'PlannedNotImplemented' THEN 'Implement this feature' WHEN status = 'PartiallyImplemented' AND completion = 'Partial' THEN 'Complete the implementation|Add error handling|Add tests' "
    "WHEN status = 'CompletelyImplemented' THEN 'Consider enhancements' WHEN status = 'UnplannedImplemented' THEN 'Document this feature' ELSE 'Review implementation status' END"
)
cte(
    "board_claims",
    f"""SELECT c.repo, claim_id AS item_id, c.description AS feature_name, CASE e.level WHEN 'Complete' THEN 'CompletelyImplemented' WHEN 'Partial' THEN 'PartiallyImplemented' ELSE 'PlannedNotImplemented' END AS status,
        CASE WHEN e.points >= 90 THEN 'Complete' WHEN e.points >= 70 THEN 'NearComplete' WHEN e.points >= 30 THEN 'Partial' WHEN e.points >= 10 THEN 'Minimal' ELSE 'NotStarted' END AS completion,
        coalesce(e.points, c.points) AS p, e.description AS impl_text
        FROM (SELECT *, (SELECT min(impl_id) FROM reality_tok AS e WHERE e.repo = c.repo AND {jaccard_sql("c.tok1", "e.tok1")} > 3e-1) AS first_id FROM claim_tok AS c) AS c LEFT JOIN reality AS e ON e.repo = c.repo AND e.impl_id = c.first_id""",
)
cte(
    "board",
    """SELECT repo, item_id, feature_name, status, completion, p FROM board_claims UNION ALL
       SELECT repo, impl_id, description, 'UnplannedImplemented', CASE level WHEN 'Complete' THEN 'Complete' WHEN 'Partial' THEN 'Partial' WHEN 'Skeleton' THEN 'Minimal' ELSE 'NotStarted' END, points
       FROM (SELECT *, row_number() OVER (PARTITION BY repo, description ORDER BY impl_id) AS k FROM reality) AS e WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM board_claims AS b WHERE b.repo = e.repo AND b.impl_text = e.description)""",
)


@query("u4_feature_status_board", f"SELECT repo, item_id, feature_name, status, completion, p / 100e0 AS confidence, {_ACTIONS} AS next_actions FROM board")
def _(c):
    return status.feature_board(c.claims, c.reality).withColumn("next_actions", F.array_join("next_actions", "|"))


_HARD = case_map("claim_type", R.COMPLEXITY_BY_CLAIM, q(R.DEFAULT_COMPLEXITY))


@query(
    "u5_implementation_priorities",
    f"""SELECT repo, claim_id, claim_text AS feature_name, claim_priority AS business_impact, complexity, {case_map("complexity", R.EFFORT_BY_COMPLEXITY)} AS estimated_effort,
        {case_map("concat_ws('/', claim_priority, complexity)", {f"{a}/{b}": v for (a, b), v in R.TIMELINE.items()})} AS timeline,
        ({case_map("claim_priority", R.IMPACT_SCORE)} * 40 + {case_map("complexity", R.EASE_SCORE)} * 20 + CAST(points2 / 2 AS BIGINT) * 20) / 10000e0 AS priority_score FROM (SELECT *, {_HARD} AS complexity FROM conflicts WHERE conflict_type = 'ClaimedButNotImplemented')""",
)
def _(c):
    return status.priorities(c.conflicts)


@query(
    "u6_recommended_actions",
    f"""SELECT * EXCLUDE (g, o1, o2) FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY g, o1, o2) AS rank FROM
        (SELECT repo, {case_map("conflict_type", {"ImplementationMismatch": 0, "ClaimedButNotImplemented": 1, "ImplementedButNotClaimed": 2})} AS g, coalesce(claim_id, impl_id) AS o1, 0 AS o2,
          {case_map("conflict_type", {"ClaimedButNotImplemented": "Implement", "ImplementedButNotClaimed": "Document", "ImplementationMismatch": "Complete"})} AS action_type, action AS description,
          coalesce(claim_text, impl_text) AS target_feature, 'Urgent' AS priority, 'Medium' AS effort FROM conflicts WHERE severity = 'Critical'
         UNION ALL SELECT repo, 3, path, line_no, 'Implement', concat('Address TODO: ', description), description, CASE priority WHEN 'Critical' THEN 'Urgent' ELSE 'High' END, {_EFFORT} FROM todos WHERE priority IN ('Critical', 'High')))""",
)
def _(c):
    return status.recommended_actions(c.conflicts, c.todos)


_CNT = lambda sql: f"(SELECT count(*) FROM {sql})"


@query(
    "u7_accuracy_and_coverage",
    f"""SELECT repo, claims, matched, evidence, false_claims, {rnd("CASE WHEN claims = 0 THEN 1e0 ELSE 1 - false_claims / CAST(claims AS DOUBLE) END")} AS documentation_accuracy,
        {rnd("CASE WHEN evidence = 0 THEN 0e0 ELSE least(matched / CAST(evidence AS DOUBLE), 1e0) END")} AS implementation_coverage FROM
        (SELECT repo, {_CNT("matched AS m WHERE m.repo = r.repo")} AS claims, {_CNT("matched AS m WHERE m.repo = r.repo AND impl_id IS NOT NULL")} AS matched, {_CNT("reality AS e WHERE e.repo = r.repo")} AS evidence,
         {_CNT("conflicts AS x WHERE x.repo = r.repo AND conflict_type = 'ClaimedButNotImplemented'")} AS false_claims FROM repos AS r)""",
)
def _(c):
    return status.accuracy(c.repos, c.matched, c.reality, c.conflicts)


@query("u8_major_discrepancies", f"SELECT repo, conflict_type, severity, claim_id, impl_id, description, {case_map('conflict_type', R.IMPACTS, q(R.DEFAULT_IMPACT))} AS impact, action AS recommendation FROM conflicts WHERE severity IN ('Critical', 'High')")
def _(c):
    return status.discrepancies(c.conflicts)


@query(
    "u8_consistency_recommendations",
    """SELECT repo, 'ImplementFeature' AS kind, concat('Implement ', count(*), ' features claimed in documentation') AS description, 'High' AS priority FROM matched WHERE impl_id IS NULL GROUP BY repo UNION ALL
       SELECT repo, 'UpdateDocumentation', concat('Document ', count(*), ' implemented features'), 'Medium' FROM reality AS e WHERE NOT EXISTS (SELECT 1 FROM matched AS m WHERE m.repo = e.repo AND m.impl_id = e.impl_id) GROUP BY repo""",
)
def _(c):
    return status.recommendations(c.matched, c.reality)


_OVERALL = f"""SELECT repo, completion_score, {rnd("inf")} AS inferred_score, {rnd("sc")} AS implementation_score, {rnd("completion_score * 4e-1 + inf * 3e-1 + sc * 2e-1")} AS overall_completion, consistency_score AS confidence
    FROM (SELECT r.repo, greatest(100 - coalesce(n, 0), 10) / 100e0 AS completion_score, coalesce(implementation_score, 0e0) AS sc, greatest(coalesce(implementation_score, 0e0) - critical_conflicts * 1e-1, 0e0) AS inf, consistency_score
          FROM repos AS r LEFT JOIN (SELECT repo, count(*) AS n FROM todos GROUP BY repo) USING (repo) LEFT JOIN reality_score USING (repo) LEFT JOIN conflict_scores USING (repo))"""


@frame("overall")
def _(c):
    return status.overall(markers.completion(c.repos, c.todos).select("repo", "completion_score"), reality.score(c.reality).select("repo", "implementation_score"), conflicts.scores(c.repos, c.conflicts))


@query("u9_overall_completion", _OVERALL)
def _(c):
    return c.overall


@query(
    "u10_status_run",
    f"""SELECT o.*, (SELECT count(*) FROM todos AS x WHERE x.repo = o.repo) AS markers, (SELECT count(*) FROM claims AS x WHERE x.repo = o.repo) AS claims, (SELECT count(*) FROM reality AS x WHERE x.repo = o.repo) AS implementations,
        (SELECT count(*) FROM conflicts AS x WHERE x.repo = o.repo) AS conflicts, (SELECT count(*) FROM board AS x WHERE x.repo = o.repo) AS features FROM ({_OVERALL}) AS o""",
)
def _(c):
    out = c.overall
    for name, df in [("markers", c.todos), ("claims", c.claims), ("implementations", c.reality), ("conflicts", c.conflicts), ("features", status.feature_board(c.claims, c.reality))]:
        out = out.join(df.groupBy("repo").agg(F.count("*").alias(name)), "repo", "left")
    return out.fillna(0)


# --- completeness inference ----------------------------------------------------

_DIRS = "string_split(path, '/')[1:-2]"
cte("crud_files", f"SELECT * FROM files WHERE ext IN ({', '.join(q(e) for e in R.CRUD_EXTENSIONS)}) AND NOT list_has_any({_DIRS}, [{', '.join(q(d) for d in R.CRUD_SKIPPED)}])")
_EFOLD = fold("content")
cte(
    "entities",
    " UNION ALL ".join(
        f"""SELECT repo, path, {i} AS pattern_no, unnest(range(0, len(ns))) AS seq, unnest(ns) AS name, content FROM (SELECT repo, path, {fold("content")} AS content, regexp_extract_all({_EFOLD}, {q(p)}, 1) AS ns FROM crud_files
            WHERE {has_any("lower(string_split(path, '/')[-1])", R.ENTITY_NAMES)} OR {has_any("concat('/', path)", R.ENTITY_DIRECTORIES)})"""
        for i, p in enumerate(R.ENTITY_PATTERNS)
    ),
)
_CRUD_FLAT = [(op, i, p) for op, ps in R.CRUD for i, p in enumerate(ps)]
cte(  # a match starts after the texts before it and the matches before it
    "op_windows",
    f"""SELECT repo, path, operation, pattern_no, lower(substr(content, greatest(pos - 200, 1), pos - greatest(pos - 200, 1) + length(text) + 200)) AS win FROM
        (SELECT repo, path, content, operation, pattern_no, found[n] AS text, CAST(1 + list_sum(list_transform(parts[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:n - 1], lambda x: length(x))), 0) AS BIGINT) AS pos FROM
         (SELECT *, unnest(range(1, len(found) + 1)) AS n FROM
          (SELECT repo, path, content, {by_position("k", [q(o) for o, _, _ in _CRUD_FLAT])} AS operation, {by_position("k", [str(i) for _, i, _ in _CRUD_FLAT])} AS pattern_no,
           {by_position("k", [f"regexp_extract_all(content, {q(p)})" for _, _, p in _CRUD_FLAT])} AS found, {by_position("k", [f"string_split_regex(content, {q(p)})" for _, _, p in _CRUD_FLAT])} AS parts
           FROM (SELECT repo, path, content, unnest({regex_hits("content", [p for _, _, p in _CRUD_FLAT])}) AS k FROM (SELECT repo, path, {fold("content")} AS content FROM crud_files)))))""",
)
_LAYER = "CASE " + " ".join(f"WHEN {has_any('w.path', ws)} THEN '{n}'" for n, ws in R.LAYERS) + " END"
cte(
    "crud_hits",
    f"""SELECT e.repo, e.name, operation, count(*) AS hits, list_sort(list(DISTINCT {_LAYER}) FILTER ({_LAYER} IS NOT NULL)) AS layers FROM (SELECT DISTINCT repo, lower(name) AS name FROM entities) AS e
        JOIN op_windows AS w ON w.repo = e.repo AND contains(w.win, e.name) GROUP BY e.repo, e.name, operation""",
)


@frame("entities")
def _(c):
    return inference.entities(c.files)


@frame("crud_hits")
def _(c):
    return cut_lineage(inference.crud_hits(c.entities, cut_lineage(inference.surroundings(c.files))))


@query("i2_entity_discovery", "SELECT repo, path, pattern_no, seq, name FROM entities")
def _(c):
    return c.entities.select("repo", "path", "pattern_no", "seq", "name")


_FIELDS = " || ".join(f"regexp_extract_all(regexp_extract(content, concat('(?i){kw}\\s+', name, '\\s*\\{{([^}}]+)\\}}'), 1), '(\\w+)\\s*:\\s*\\w+', 1)" for kw in ("class", "interface"))


@query("i3_entity_fields", f"SELECT repo, path, pattern_no, seq, name, array_to_string({_FIELDS}, ',') AS fields FROM entities")
def _(c):
    return c.entities.select("repo", "path", "pattern_no", "seq", "name", F.array_join("fields", ",").alias("fields"))


@query("i4_crud_proximity", "SELECT repo, name, operation, hits, least(hits * 20, 100) / 100e0 AS confidence, array_to_string(coalesce(layers, []), ',') AS layers FROM crud_hits")
def _(c):
    return c.crud_hits.withColumn("layers", F.array_join("layers", ","))


@query(
    "i5_crud_completeness",
    """SELECT repo, path, pattern_no, seq, name, array_to_string(have, ',') AS implemented, array_to_string(list_filter(['create', 'read', 'update', 'delete'], lambda o: NOT list_contains(have, o)), ',') AS missing,
       CASE len(have) WHEN 4 THEN 'complete' WHEN 3 THEN 'partial' WHEN 2 THEN 'partial' ELSE 'missing' END AS verdict FROM
       (SELECT e.*, list_filter(['create', 'read', 'update', 'delete'], lambda o: list_contains(coalesce(ops, []), o)) AS have FROM entities AS e
        LEFT JOIN (SELECT repo, name, list(operation) AS ops FROM crud_hits GROUP BY ALL) AS h ON h.repo = e.repo AND h.name = lower(e.name))""",
)
def _(c):
    return inference.crud_completeness(c.entities, c.crud_hits).select(
        "repo", "path", "pattern_no", "seq", "name", F.array_join("implemented", ",").alias("implemented"), F.array_join("missing", ",").alias("missing"), "verdict"
    )


@query(
    "i1_analyzer_contributions",
    f"""SELECT repo, n AS analyzers, {rnd("inf")} AS inference_confidence, {rnd("(conf + inf) / 2")} AS total_confidence FROM (SELECT r.repo, CASE WHEN e THEN 5 ELSE 4 END AS n,
        (CASE WHEN e THEN 2000 ELSE 0 END + 3500) / CAST(CASE WHEN e THEN 5 ELSE 4 END AS DOUBLE) / 10000e0 AS inf, greatest(100 - 5 * coalesce(n, 0), 30) / 100e0 AS conf
        FROM repos AS r LEFT JOIN (SELECT repo, count(*) AS n FROM todos GROUP BY repo) AS t USING (repo) LEFT JOIN (SELECT DISTINCT repo, TRUE AS e FROM entities) AS x USING (repo))""",
)
def _(c):
    return inference.contributions(c.repos, c.entities, markers.completion(c.repos, c.todos))
