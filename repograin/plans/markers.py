"""Queries on work markers."""

from pyspark.sql import functions as F

from repograin.functions.scores import r6
from repograin.operators import markers
from repograin.operators.markers import marker_pattern
from repograin.plans import corpus_ctes  # noqa: F401
from repograin.plans.base import by_position, case_any, case_map, cte, has_any, q, query, regex_hits, rnd, values, words_sql
from repograin.rules import markers as M

_PATTERNS = [marker_pattern(m) for m in M.MARKERS]
_TEXT = by_position(
    "k", ["trim(concat(" + ", ".join(f"regexp_extract(line, {q(p)}, {g + 1})" for g in range(len(M.COMMENT_STYLES))) + "))" for p in _PATTERNS]
)
_PRIORITY = (
    f"CASE WHEN {has_any('lower(description)', M.CRITICAL_WORDS)} THEN 'Critical' WHEN {has_any('lower(description)', M.HIGH_WORDS)} THEN 'High' "
    f"ELSE {case_map('marker', M.PRIORITY_BY_MARKER)} END"
)
cte(
    "marker_hits",
    f"""SELECT *, {by_position("k", [q(m) for m in M.MARKERS])} AS marker, {_TEXT} AS description FROM
        (SELECT l.*, m.lang, {regex_hits("line", _PATTERNS)}[1] AS k FROM all_lines AS l JOIN marker_files AS m USING (repo, path)) AS x WHERE k IS NOT NULL""",
)
cte(
    "todos",
    f"""SELECT repo, path, lang AS file_type, line_no, line, marker, description, {_PRIORITY} AS priority,
        CASE WHEN strpos(line, marker) = 0 THEN 0 ELSE strlen(left(line, strpos(line, marker) - 1)) END AS column_no,
        nullif(regexp_extract(description, '@([a-zA-Z0-9_-]+)', 1), '') AS author,
        nullif(regexp_extract(description, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS date_text,
        regexp_extract_all(description, '#([a-zA-Z0-9_-]+)', 1) AS tags
        FROM marker_hits AS h""",
)
_EFFORT = (
    f"CASE WHEN {has_any('lower(description)', M.BIG_WORK)} THEN CASE WHEN len({words_sql('description')}) > 10 THEN 'Large' ELSE 'Medium' END "
    f"WHEN {has_any('lower(description)', M.SMALL_WORK)} THEN 'Small' ELSE 'Medium' END"
)
_URGENCY = case_map("priority", {k: v / 100 for k, v in M.URGENCY.items()}) + "::DOUBLE"


@query("t1_marker_extraction", "SELECT repo, path, line_no, column_no, marker, description FROM todos")
def _(c):
    return c.todos.select("repo", "path", "line_no", "column_no", "marker", "description")


@query("t2_marker_priority", "SELECT repo, marker, priority, count(*) AS n FROM todos GROUP BY ALL")
def _(c):
    return c.todos.groupBy("repo", "marker", "priority").agg(F.count("*").alias("n"))


@query("t3_author_and_date", "SELECT repo, path, line_no, author, date_text AS date_added FROM todos WHERE author IS NOT NULL OR date_text IS NOT NULL")
def _(c):
    return (
        c.todos.where(F.col("author").isNotNull() | F.col("date_added").isNotNull())
        .select("repo", "path", "line_no", "author", F.col("date_added").cast("string").alias("date_added"))
    )


@query("t4_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM todos) GROUP BY tag")
def _(c):
    return c.todos.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(
    "t5_surrounding_lines",
    """SELECT t.repo, t.path, t.line_no, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no), '') AS context
       FROM todos AS t LEFT JOIN all_lines AS l ON l.repo = t.repo AND l.path = t.path AND l.line_no BETWEEN t.line_no - 2 AND t.line_no + 1 AND l.line_no <> t.line_no
       GROUP BY t.repo, t.path, t.line_no""",
)
def _(c):
    return c.todos.select("repo", "path", "line_no", F.array_join("context_lines", "\n").alias("context"))


@query(
    "t6_marker_summary",
    """SELECT repo, 'total' AS dimension, 'all' AS label, count(*) AS n FROM todos GROUP BY repo
       UNION ALL SELECT repo, 'type', marker, count(*) FROM todos GROUP BY repo, marker
       UNION ALL SELECT repo, 'priority', priority, count(*) FROM todos GROUP BY repo, priority
       UNION ALL SELECT repo, 'file_type', file_type, count(*) FROM todos WHERE file_type IS NOT NULL GROUP BY repo, file_type""",
)
def _(c):
    return markers.summary(c.todos)


@query(
    "t7_most_marked_files",
    f"""SELECT t.*, {rnd("todo_count * 100e0 / line_count")} AS density_per_100_lines FROM
        (SELECT repo, path, count(*) AS todo_count, count(*) FILTER (priority IN ('High', 'Critical')) AS high_priority_count
         FROM todos GROUP BY repo, path ORDER BY todo_count DESC, repo, path LIMIT 10) AS t
        JOIN (SELECT repo, path, count(*) AS line_count FROM all_lines GROUP BY repo, path) AS s USING (repo, path)
        """.replace("t.*,", "t.repo, t.path, todo_count, high_priority_count, line_count,"),
)
def _(c):
    return markers.most_marked(c.todos, c.files, 10)


@query(
    "t7_most_marked_files_per_repo",
    """SELECT * FROM (SELECT repo, path, count(*) AS todo_count, count(*) FILTER (priority IN ('High', 'Critical')) AS high_priority_count,
       row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, path) AS rank FROM todos GROUP BY repo, path) WHERE rank <= 10""",
)
def _(c):
    return markers.most_marked_per_repo(c.todos, 10)


@query("t8_marker_topic", f"SELECT repo, {case_any('lower(description)', M.TOPICS, M.DEFAULT_TOPIC)} AS category, count(*) AS n, {rnd(f'avg({_URGENCY})')} AS mean_priority FROM todos GROUP BY repo, category")
def _(c):
    t = markers.by_topic(c.todos)
    return t.groupBy("repo", "category").agg(F.count("*").alias("n"), r6(F.avg("priority_score")).alias("mean_priority"))


@query("t9_effort_estimate", f"SELECT repo, path, line_no, {_EFFORT} AS estimated_effort FROM todos")
def _(c):
    return markers.by_topic(c.todos).select("repo", "path", "line_no", "estimated_effort")


@query(
    "t10_placeholder_list",
    f"SELECT repo, path, line_no, array_to_string({words_sql('description')}, ' ') AS feature_name, marker AS placeholder_type, description, {_URGENCY} AS urgency_score FROM todos WHERE marker = 'TODO'",
)
def _(c):
    return markers.placeholders(c.todos)


@query(
    "t11_placeholder_code",
    f"SELECT repo, path, line_no, indicator, trim(line) AS snippet FROM all_lines, {values([(p,) for p in M.PLACEHOLDERS], 'indicator', 'p')} WHERE contains(line, indicator)",
)
def _(c):
    return markers.placeholder_code(c.files)


@query(
    "t12_marker_completion",
    """SELECT repo, coalesce(n, 0) AS todo_count, greatest(100 - coalesce(n, 0), 10) / 100e0 AS completion_score, greatest(100 - 5 * coalesce(n, 0), 30) / 100e0 AS confidence
       FROM repos LEFT JOIN (SELECT repo, count(*) AS n FROM todos GROUP BY repo) USING (repo)""",
)
def _(c):
    return markers.completion(c.repos, c.todos)
