"""Queries on documentation and its claims."""

from pyspark.sql import functions as F

from repograin.functions.scores import r6
from repograin.functions.similarity import jaccard
from repograin.functions.text import words
from repograin.operators import claims, documents
from repograin.plans import corpus_ctes  # noqa: F401
from repograin.plans.base import (
    by_position, case_any, case_map, cte, fold, frame, has_any, q, query, regex_hits, rnd, words_sql,
)
from repograin.rules import documents as D
from repograin.session import cut_lineage
from repograin.sources.corpus import claim_files, documentation_files


@frame("docs")
def _(c):
    return documentation_files(c.files)


@frame("sections")
def _(c):
    return documents.sections(c.docs)


@frame("technologies")
def _(c):
    return documents.technologies(c.docs)


@frame("commands")
def _(c):
    return documents.setup_commands(c.docs)


@frame("coverage")
def _(c):
    return documents.coverage(c.repos, c.sections, c.commands)


@frame("raw_claims")
def _(c):
    return claims.extract(claim_files(c.files))


@frame("claims")
def _(c):
    return cut_lineage(claims.final(claim_files(c.files)))


_TRIM = r"regexp_replace({}, '^\s+|\s+\z', '', 'g')"
cte("doc_lines", "SELECT l.* FROM all_lines AS l JOIN doc_files USING (repo, path)")
cte("doc_heads", f"SELECT *, {by_position(regex_hits('line', [p for _, p in D.SECTIONS]) + '[1]', [q(n) for n, _ in D.SECTIONS])} AS head FROM doc_lines")
cte("doc_numbered", "SELECT *, count(head) OVER (PARTITION BY repo, path ORDER BY line_no) AS ord FROM doc_heads")
cte(
    "sections",
    f"""SELECT repo, path, ord, section, {_TRIM.format("string_agg(line, chr(10) ORDER BY line_no)")} AS body FROM
        (SELECT *, max(head) OVER (PARTITION BY repo, path, ord) AS section,
         min(CASE WHEN head IS NULL AND line LIKE '#%' THEN line_no END) OVER (PARTITION BY repo, path, ord) AS stop FROM doc_numbered WHERE ord > 0)
        WHERE head IS NULL AND (stop IS NULL OR line_no <= stop) GROUP BY repo, path, ord, section HAVING body <> ''""",
)


@query("d1_section_split", "SELECT repo, path, ord, section, body FROM sections")
def _(c):
    return c.sections


@query("p3_line_split", "SELECT repo, count(*) AS n_lines, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes, max(line_no) AS longest_file FROM all_lines GROUP BY repo")
def _(c):
    return documents.number_lines(c.files).groupBy("repo").agg(
        F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("n_bytes"), F.max("line_no").alias("longest_file")
    )


_KEPT = ", ".join(q(s) for s in D.KEPT_SECTIONS[1:])
cte(
    "routed",
    f"""SELECT repo, section, path, ord, body FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, ord) AS k FROM sections WHERE section = 'Description') WHERE k = 1
        UNION ALL SELECT repo, section, path, ord, body FROM sections WHERE section IN ({_KEPT})""",
)


@query("d2_section_routing", "SELECT repo, section, path, ord, body FROM routed")
def _(c):
    return documents.routing(c.sections)


_FOLDED = "folded"
_CTX = by_position(
    "k", [f"array_to_string(regexp_extract_all(folded, {q('(?is).{0,100}(?:' + p.removeprefix('(?i)') + ').{0,100}')}), ' | ')" for _, p in D.TECHNOLOGIES]
)
_VER = "coalesce(" + ", ".join(f"nullif(regexp_extract(context, {q(p)}, 1), '')" for p in D.VERSION_PATTERNS) + ")"
cte("doc_folded", f"SELECT repo, path, {fold('content')} AS folded FROM doc_files")
cte("tech_hits", f"SELECT repo, path, folded, unnest({regex_hits('folded', [p for _, p in D.TECHNOLOGIES])}) AS k FROM doc_folded")
cte(
    "technologies",
    f"""SELECT repo, name, path, context, {_VER} AS version, coalesce({case_map("name", D.PURPOSES)}, {case_any("lower(context)", D.PURPOSE_WORDS, D.DEFAULT_PURPOSE)}) AS purpose,
        {by_position(regex_hits("context", [p for _, p in D.INSTALL_METHODS]) + "[1]", [q(m) for m, _ in D.INSTALL_METHODS])} AS installation_method,
        least(50 + CASE WHEN contains(lower(context), 'install') THEN 20 ELSE 0 END + CASE WHEN contains(context, 'v') THEN 10 ELSE 0 END
          + CASE WHEN {has_any("context", ["dependencies", "requirements"])} THEN 15 ELSE 0 END, 100) AS pts
        FROM (SELECT *, {by_position("k", [q(n) for n, _ in D.TECHNOLOGIES])} AS name, {_CTX} AS context,
              row_number() OVER (PARTITION BY repo, k ORDER BY path) AS rn FROM tech_hits) WHERE rn = 1""",
)


@query("d3_technology_detection", "SELECT repo, name, path FROM technologies")
def _(c):
    return c.technologies.select("repo", "name", "path")


@query("d4_technology_confidence", "SELECT repo, name, pts / 100e0 AS confidence FROM technologies")
def _(c):
    return c.technologies.select("repo", "name", "confidence")


@query("d5_version_from_text", "SELECT repo, name, version FROM technologies WHERE version IS NOT NULL")
def _(c):
    return c.technologies.where("version IS NOT NULL").select("repo", "name", "version")


@query("d6_technology_purpose", "SELECT repo, name, purpose FROM technologies")
def _(c):
    return c.technologies.select("repo", "name", "purpose")


@query("d7_install_method", "SELECT repo, name, installation_method FROM technologies")
def _(c):
    return c.technologies.select("repo", "name", "installation_method")


@query("p7_text_context_window", "SELECT repo, name, CAST(length(context) AS BIGINT) AS context_chars, len(string_split(context, ' | ')) AS windows FROM technologies")
def _(c):
    return c.technologies.select(
        "repo", "name", F.length("context").cast("bigint").alias("context_chars"), F.size(F.split("context", r" \| ")).alias("windows")
    )


_NOTES = f"list_filter(list_transform(string_split(context, '.'), lambda s: trim(s)), lambda s: {has_any('lower(s)', D.CONFIG_WORDS)} AND strlen(s) > 10)"


@query("d8_configuration_notes", f"SELECT repo, name, length(note) AS note_chars, count(*) AS n FROM (SELECT repo, name, unnest({_NOTES}) AS note FROM technologies) GROUP BY ALL")
def _(c):
    return (
        c.technologies.select("repo", "name", F.explode("configuration_notes").alias("note"))
        .groupBy("repo", "name", F.length("note").alias("note_chars")).agg(F.count("*").alias("n"))
    )


_ANY_CMD = "(?i)(?:" + "|".join(p.removeprefix("(?i)") for p in D.SETUP_COMMANDS) + ")"
cte(
    "commands",
    rf"""SELECT repo, command, path, line_no FROM (SELECT *, row_number() OVER (PARTITION BY repo, command ORDER BY path, line_no) AS k FROM
        (SELECT repo, path, line_no, {_TRIM.format("regexp_replace(regexp_replace(regexp_replace(t, '^`+', ''), '`+$', ''), '^([$] )+', '')")} AS command
         FROM (SELECT repo, path, line_no, {_TRIM.format("line")} AS t FROM doc_lines)
         WHERE regexp_matches({fold("t")}, {q(_ANY_CMD)}) AND t NOT LIKE '```%' AND t NOT LIKE '#%')) WHERE k = 1""",
)


@query("d9_setup_commands", "SELECT repo, command, path, line_no FROM commands")
def _(c):
    return c.commands


_EXPECTED = ", ".join(q(s) for s in D.EXPECTED_SECTIONS)
cte(
    "coverage",
    f"""SELECT repo, coalesce(f, []) AS found, list_filter([{_EXPECTED}], lambda s: NOT list_contains(coalesce(f, []), s)) AS missing,
        len(found) / CAST(len(found) + len(missing) AS DOUBLE) AS completeness, coalesce(cmd, FALSE) AS has_commands
        FROM repos LEFT JOIN (SELECT repo, list_sort(list(DISTINCT section)) AS f FROM sections GROUP BY repo) USING (repo)
        LEFT JOIN (SELECT DISTINCT repo, TRUE AS cmd FROM commands) USING (repo)""",
)
_HAS = {s: f"list_contains(found, '{s}')" for s in ("Description", "Installation", "Usage")}


@query(
    "d11_coverage",
    f"""SELECT repo, array_to_string(found, ',') AS found, array_to_string(missing, ',') AS missing, {rnd("completeness")} AS completeness,
        concat_ws('|', CASE WHEN {_HAS["Description"]} THEN 'Has project description' END, CASE WHEN {_HAS["Installation"]} THEN 'Has installation instructions' END,
          CASE WHEN {_HAS["Usage"]} THEN 'Has usage examples' END, CASE WHEN has_commands THEN 'Has setup commands' END) AS indicators,
        concat_ws('|', CASE WHEN NOT {_HAS["Description"]} THEN 'Add project description' END, CASE WHEN NOT {_HAS["Installation"]} THEN 'Add installation instructions' END,
          CASE WHEN NOT {_HAS["Usage"]} THEN 'Add usage examples' END) AS suggestions FROM coverage""",
)
def _(c):
    join = lambda col, sep: F.array_join(col, sep).alias(col)
    return c.coverage.select("repo", join("found", ","), join("missing", ","), r6(F.col("completeness")).alias("completeness"), join("indicators", "|"), join("suggestions", "|"))


cte(
    "doc_confidence",
    f"""SELECT repo, completeness, tech AS tech_confidence,
        (completeness + coalesce(tech, 0e0) + CASE WHEN substantial THEN 0e0 ELSE 3e-1 END) / (1 + CASE WHEN tech IS NULL THEN 0 ELSE 1 END + CASE WHEN substantial THEN 0 ELSE 1 END) AS confidence
        FROM (SELECT *, {" OR ".join(_HAS.values())} AS substantial FROM coverage) LEFT JOIN (SELECT repo, CAST(sum(pts) AS DOUBLE) / count(*) / 100e0 AS tech FROM technologies GROUP BY repo) USING (repo)""",
)


@query("d12_documentation_confidence", f"SELECT repo, {rnd('confidence')} AS confidence FROM doc_confidence")
def _(c):
    return documents.confidence(c.coverage, c.technologies).select("repo", "confidence")


@query(
    "d13_multi_source_merge",
    r"""SELECT source, m.doc_id AS doc_id, copies, md5(text) AS text_md5 FROM (SELECT min({'lang': lang, 'doc_id': doc_id}) AS m, count(*) AS copies,
        lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k, source FROM documents GROUP BY k, source) AS g JOIN documents AS d ON d.doc_id = g.m.doc_id""".replace("SELECT source,", "SELECT g.source,"),
)
def _(c):
    # Raw documents: sources by language, one description space per origin.
    items = c.table("documents").select(
        F.col("source").alias("repo"), F.col("lang").alias("source_rank"), F.lit(0).alias("kind_rank"), F.col("doc_id").alias("ord"), F.col("text").alias("body")
    )
    return documents.merge_texts(items).select(F.col("repo").alias("source"), F.col("ord").alias("doc_id"), "copies", F.md5("body").alias("text_md5"))


@query(
    "d13_section_merge",
    r"""SELECT repo, section, path, ord, copies FROM (SELECT *, row_number() OVER (PARTITION BY repo, k ORDER BY path, kind, ord) AS rn, count(*) OVER (PARTITION BY repo, k) AS copies FROM
        (SELECT *, lower(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS k, list_position(['Installation', 'Usage', 'Api', 'Architecture', 'Contributing'], section) AS kind FROM routed WHERE section <> 'Description')) WHERE rn = 1""",
)
def _(c):
    kinds = F.array(*[F.lit(s) for s in D.KEPT_SECTIONS[1:]])
    items = documents.routing(c.sections).where("section <> 'Description'").select(
        "repo", F.col("path").alias("source_rank"), F.array_position(kinds, F.col("section")).alias("kind_rank"), "ord", "body"
    )
    return documents.merge_texts(items).select(
        "repo", F.element_at(kinds, F.col("kind_rank").cast("int")).alias("section"), F.col("source_rank").alias("path"), "ord", "copies"
    )


@query(
    "d14_docs_vs_code_rule",
    """SELECT DISTINCT repo, 'MissingDependency' AS conflict_type, 'Uses React' AS documentation_claim, 'No npm installation instructions found' AS code_reality, 'Medium' AS severity,
       'Add npm install instructions for React dependencies' AS recommendation FROM technologies AS t WHERE name = 'React'
       AND NOT EXISTS (SELECT 1 FROM sections AS s WHERE s.repo = t.repo AND section = 'Installation' AND contains(body, 'npm'))""",
)
def _(c):
    return documents.rule_conflicts(c.technologies, c.sections)


@query(
    "d15_documentation_profile",
    f"""SELECT r.repo, {rnd("completeness")} AS completeness, {rnd("confidence")} AS confidence, {", ".join(f"coalesce(n_{s.lower()}, 0) AS n_{s.lower()}" for s in D.KEPT_SECTIONS)},
        (SELECT any_value(length(body)) FROM routed AS x WHERE x.repo = r.repo AND section = 'Description') AS description_chars,
        (SELECT count(*) FROM technologies AS x WHERE x.repo = r.repo) AS n_technologies, (SELECT count(*) FROM commands AS x WHERE x.repo = r.repo) AS n_commands
        FROM doc_confidence AS r LEFT JOIN (SELECT repo, {", ".join(f"count(*) FILTER (section = '{s}') AS n_{s.lower()}" for s in D.KEPT_SECTIONS)} FROM sections GROUP BY repo) USING (repo)""",
)
def _(c):
    p = documents.profile(c.repos, c.sections, c.technologies, c.commands)
    return p.select(
        "repo", r6(F.col("completeness")).alias("completeness"), "confidence", *[f"n_{s.lower()}" for s in D.KEPT_SECTIONS],
        F.length("description").alias("description_chars"), "n_technologies", "n_commands",
    )


# --- claims -----------------------------------------------------------------

_PUNCT = r"[!-/:-@\[-`{-~]+"
_CONTEXT = (
    "(SELECT trim(string_agg(line, ' ' ORDER BY line_no)) FROM claim_lines AS n WHERE n.repo = h.repo AND n.path = h.path AND n.line_no BETWEEN h.line_no - 3 AND h.line_no + 3)"
)
cte("claim_lines", "SELECT l.* FROM all_lines AS l JOIN claim_files USING (repo, path)")
cte("claim_hits", f"SELECT *, unnest({regex_hits('folded', [p for _, _, p in claims.RULES])}) AS k FROM (SELECT *, {fold('line')} AS folded FROM claim_lines)")
cte(
    "claim_contexts",
    """SELECT h.repo, h.path, h.line_no, trim(string_agg(n.line, ' ' ORDER BY n.line_no)) AS context FROM (SELECT DISTINCT repo, path, line_no FROM claim_hits) AS h
       JOIN claim_lines AS n ON n.repo = h.repo AND n.path = h.path AND n.line_no BETWEEN h.line_no - 3 AND h.line_no + 3 GROUP BY ALL""",
)
_BONUS = f"coalesce(list_sum(list_transform(keywords, lambda w: {case_map('w', D.KEYWORD_BONUS, '0')})), 0)"
_PRIO = (
    "CASE claim_type " + " ".join(f"WHEN '{t}' THEN {case_any('lower(context)', cs, D.CLAIM_PRIORITY[t])}" for t, cs in D.CLAIM_PRIORITY_WORDS.items())
    + f" ELSE {case_map('claim_type', D.CLAIM_PRIORITY)} END"
)
cte(
    "raw_claims",
    f"""SELECT *, least(greatest({D.CLAIM_BASE} + {case_map("claim_type", D.CLAIM_TYPE_BONUS, str(D.CLAIM_OTHER_BONUS))} + CAST({_BONUS} AS BIGINT)
          - CASE WHEN strlen(description) < 10 THEN 20 WHEN strlen(description) > 200 THEN 10 ELSE 0 END, 0), 100) AS points, {_PRIO} AS priority FROM
        (SELECT *, list_filter(list_transform({words_sql("description")}, lambda w: regexp_replace(lower(w), '^{_PUNCT}|{_PUNCT}$', '', 'g')), lambda w: w IN ({", ".join(q(k) for k in D.KEYWORD_BONUS)})) AS keywords FROM
         (SELECT repo, path, line_no, context, {by_position("k", [q(t) for t, _, _ in claims.RULES])} AS claim_type, {by_position("k", [str(i) for _, i, _ in claims.RULES])} AS pattern_no,
          trim({by_position("k", [f"regexp_extract(folded, {q(p)}, 1)" for _, _, p in claims.RULES])}) AS description FROM claim_hits JOIN claim_contexts USING (repo, path, line_no)))""",
)


def jaccard_sql(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0e0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END)"


cte(
    "claims",
    f"""SELECT *, concat_ws(':', path, lpad(CAST(line_no AS VARCHAR), 7, '0'), claim_type, pattern_no) AS claim_id FROM raw_claims AS a WHERE points >= {D.CLAIM_THRESHOLD} AND NOT EXISTS
        (SELECT 1 FROM raw_claims AS b WHERE b.repo = a.repo AND b.path = a.path AND b.claim_type = a.claim_type
         AND (-b.points, b.line_no, b.pattern_no) < (-a.points, a.line_no, a.pattern_no) AND {jaccard_sql(words_sql("a.description"), words_sql("b.description"))} > 8e-1)""",
)


@query("c1_claim_extraction", "SELECT repo, path, line_no, claim_type, pattern_no, description FROM raw_claims")
def _(c):
    return c.raw_claims.select("repo", "path", "line_no", "claim_type", "pattern_no", "description")


@query("p2_regex_by_category_and_line", "SELECT claim_type, pattern_no, count(*) AS hits, count(DISTINCT repo) AS repos FROM raw_claims GROUP BY ALL")
def _(c):
    per_repo = c.raw_claims.groupBy("claim_type", "pattern_no", "repo").agg(F.count("*").alias("n"))
    return per_repo.groupBy("claim_type", "pattern_no").agg(F.sum("n").alias("hits"), F.count("*").alias("repos"))


@query("c2_claim_keywords", "SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM raw_claims) GROUP BY keyword")
def _(c):
    return c.raw_claims.select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


@query("c3_claim_confidence", "SELECT repo, path, line_no, claim_type, pattern_no, points / 100e0 AS confidence FROM raw_claims")
def _(c):
    return c.raw_claims.select("repo", "path", "line_no", "claim_type", "pattern_no", (F.col("points") / 100.0).alias("confidence"))


@query("c4_claim_priority", "SELECT claim_type, priority, count(*) AS n FROM raw_claims GROUP BY ALL")
def _(c):
    return c.raw_claims.groupBy("claim_type", "priority").agg(F.count("*").alias("n"))


@query("c5_claim_context", "SELECT repo, path, line_no, md5(context) AS context_md5 FROM claim_contexts")
def _(c):
    return c.raw_claims.select("repo", "path", "line_no", F.md5("context").alias("context_md5")).distinct()


@query("c6_near_duplicate_claims", "SELECT repo, claim_id, description, points FROM claims")
def _(c):
    return c.claims.select("repo", "claim_id", "description", "points")


@query("p4_threshold_filter", f"SELECT claim_type, count(*) AS kept FROM raw_claims WHERE points >= {D.CLAIM_THRESHOLD} GROUP BY claim_type")
def _(c):
    return c.raw_claims.where(F.col("points") >= D.CLAIM_THRESHOLD).groupBy("claim_type").agg(F.count("*").alias("kept"))


@query(
    "c7_claim_summary",
    f"""SELECT f.*, total_claims, high_confidence_claims, verification_needed, mean_confidence FROM
        (SELECT repo, 'type' AS dimension, claim_type AS label, count(*) AS n FROM claims GROUP BY repo, claim_type UNION ALL SELECT repo, 'priority', priority, count(*) FROM claims GROUP BY repo, priority) AS f
        JOIN (SELECT repo, count(*) AS total_claims, count(*) FILTER (points > 80) AS high_confidence_claims, count(*) FILTER (claim_type IN ('Feature', 'Api', 'Security')) AS verification_needed,
              {rnd("CAST(sum(points) AS DOUBLE) / count(*) / 100e0")} AS mean_confidence FROM claims GROUP BY repo) AS t USING (repo)""",
)
def _(c):
    return claims.summary(c.claims)


@query("x8_token_set_similarity", f"SELECT claim_id, s AS similarity FROM (SELECT claim_id, {rnd(jaccard_sql(words_sql('description'), words_sql('context')))} AS s FROM claims)")
def _(c):
    return c.claims.select("claim_id", r6(jaccard(F.array_distinct(words(F.col("description"))), F.array_distinct(words(F.col("context"))))).alias("similarity"))
