"""Queries on segments, components and delivery tables."""

from pyspark.sql import functions as F

from repograin.functions.scores import r6
from repograin.operators import components, segments
from repograin.plans import frameworks as fw_plan  # noqa: F401
from repograin.plans.base import by_position, case_map, cte, frame, has_any, hit_list, q, query, rnd, values

from repograin.rules import code as K
from repograin.rules.frameworks import SEGMENT_PATTERNS
from repograin.session import cut_lineage


@frame("segments")
def _(c):
    return cut_lineage(segments.framework(segments.extract(c.files), c.dispatched))


@frame("components")
def _(c):
    return cut_lineage(components.table(c.files))


@frame("stories")
def _(c):
    return cut_lineage(components.stories(c.components))


@frame("tasks")
def _(c):
    return components.tasks(c.components)


cte("seg_files", f"SELECT *, {case_map('ext', K.SEGMENT_LANGUAGES)} AS language FROM pruned_files WHERE ext IN ({', '.join(q(e) for e in K.SEGMENT_LANGUAGES)})")
_DECLS = [(lang, kind, p, g) for lang, rules in K.DECLARATIONS.items() for kind, p, g in rules]
_BAD = ", ".join(q(n) for n in K.NOT_NAMES)
_TESTS = [f"language = '{lang}' AND regexp_extract(line, {q(p)}, {g}) <> '' AND regexp_extract(line, {q(p)}, {g}) NOT IN ({_BAD})" for lang, _, p, g in _DECLS]
cte(
    "seg_lines",
    f"""SELECT *, coalesce(max(CASE WHEN NOT starts_with(ltrim(line), '@') THEN line_no END) OVER (PARTITION BY repo, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start_line,
        max(line_no) OVER (PARTITION BY repo, path) AS n_lines FROM (SELECT l.*, f.language, {hit_list(_TESTS)}[1] AS k FROM all_lines AS l JOIN seg_files AS f USING (repo, path))""",
)
cte(
    "seg_decls",
    f"""SELECT repo, path, language, line_no AS header_line, start_line, n_lines, line AS header, {by_position("k", [q(kind) for _, kind, _, _ in _DECLS])} AS kind, {by_position("k", [f"regexp_extract(line, {q(p)}, {g})" for _, _, p, g in _DECLS])} AS name,
        length({by_position("k", [f"regexp_extract(line, {q(p)}, 1)" for _, _, p, _ in _DECLS])}) AS indent FROM seg_lines WHERE k IS NOT NULL""",
)
cte(
    "seg_spans",
    "SELECT *, coalesce((SELECT min(b.header_line) - 1 FROM seg_decls AS b WHERE b.repo = a.repo AND b.path = a.path AND b.header_line > a.header_line AND b.indent <= a.indent), n_lines) AS end_line FROM seg_decls AS a",
)
_MODEL = " OR ".join(f"(language = '{lang}' AND {has_any('content', ws)})" for lang, ws in K.MODEL_WORDS.items())
_HINTS = "CASE language " + " ".join(
    f"WHEN '{lang}' THEN list_filter([{', '.join(f'CASE WHEN {has_any(chr(108) + chr(111) + chr(119), ws)} THEN {q(h)} END' for h, ws in groups)}], lambda x: x IS NOT NULL)" for lang, groups in K.HINTS.items()
) + " END"
_CANDS = "list_filter([" + ", ".join(f"CASE WHEN {has_any('low', ws)}" + (f" OR {has_any('lower(path)', ps)}" if ps else "") + f" THEN '{f}' END" for f, ps, ws in K.SEGMENT_FRAMEWORKS) + "], lambda x: x IS NOT NULL)"
cte(
    "seg_content",
    "SELECT s.*, concat_ws(':', s.path, header_line, name) AS segment_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS content FROM seg_spans AS s JOIN seg_lines AS l ON l.repo = s.repo AND l.path = s.path AND l.line_no BETWEEN s.start_line AND s.end_line GROUP BY ALL",
)
cte(
    "segments",
    f"""SELECT * EXCLUDE (known, cands), list_filter(cands, lambda f: list_contains(coalesce(known, []), f))[1] AS framework FROM
        (SELECT *, CASE WHEN kind = 'Class' AND ({_MODEL}) THEN 'Database' ELSE kind END AS segment_type, {_HINTS} AS hints, {_CANDS} AS cands FROM (SELECT *, lower(content) AS low FROM seg_content)) AS s
        LEFT JOIN (SELECT repo, list(framework) AS known FROM dispatched GROUP BY repo) USING (repo)""",
)


@query("e1_segment_extraction", "SELECT repo, segment_id, segment_type, name, start_line, end_line, md5(content) AS content_md5 FROM segments")
def _(c):
    return segments.extract(c.files).select("repo", "segment_id", "segment_type", "name", "start_line", "end_line", F.md5("content").alias("content_md5"))


_SPLIT = lambda x: f"list_filter(list_transform(string_split({x}, ','), lambda p: trim(p)), lambda p: p <> '')"
_OPT = lambda x: f"nullif(trim({x}), '')"


@query(
    "e2_segment_details",
    rf"""SELECT repo, segment_id, CASE WHEN kind = 'Function' THEN array_to_string({_SPLIT("regexp_extract(header, '[(]([^)]*)[)]', 1)")}, '|') END AS parameters,
        CASE WHEN kind = 'Function' THEN CASE language WHEN 'python' THEN {_OPT("regexp_extract(header, '->\\s*([^:]+):', 1)")} WHEN 'typescript' THEN {_OPT("regexp_extract(header, '[)]\\s*:\\s*([^{=]+)', 1)")} ELSE {_OPT("regexp_extract(header, '([\\w<>\\[\\]]+)\\s+\\w+\\s*[(]', 1)")} END END AS return_type,
        regexp_matches(header, '\basync\b') AS is_async, array_to_string(regexp_extract_all(content, '(?m)^\s*(@[\w.]+)', 1), '|') AS decorators,
        CASE WHEN kind = 'Class' THEN CASE language WHEN 'python' THEN {_OPT("regexp_extract(header, 'class\\s+\\w+[(]([^)]*)[)]', 1)")} ELSE {_OPT("regexp_extract(header, 'extends\\s+([\\w.]+)', 1)")} END END AS extends,
        CASE WHEN kind = 'Class' AND language <> 'python' THEN array_to_string({_SPLIT("regexp_extract(header, 'implements\\s+([\\w, ]+)', 1)")}, '|') END AS implements,
        CASE WHEN kind = 'Class' THEN array_to_string(CASE language WHEN 'python' THEN regexp_extract_all(content, '(?m)^\s+(?:async\s+)?def\s+(\w+)', 1)
          WHEN 'java' THEN regexp_extract_all(content, '(?m)^\s+(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\], ]+\s+(\w+)\s*[(][^)]*[)][^\n;]*\{{', 1)
          ELSE list_filter(regexp_extract_all(content, '(?m)^\s+(?:(?:public|private|protected|static|async)\s+)*(\w+)\s*[(][^)\n]*[)][^\n;]*\{{\s*$', 1), lambda m: m NOT IN ({_BAD})) END, '|') END AS methods,
        CASE WHEN kind = 'Interface' THEN array_to_string(list_filter(list_transform(list_filter(list_transform(string_split(content, chr(10)), lambda l: trim(l)), lambda l: contains(l, ':') AND NOT starts_with(l, '//')), lambda l: trim(split_part(l, ':', 1))), lambda p: p <> ''), '|') END AS properties
        FROM segments""".replace("\\\\", "\\"),
)
def _(c):
    d = segments.details(segments.extract(c.files))
    join = lambda n: F.array_join(n, "|").alias(n)
    return d.select("repo", "segment_id", join("parameters"), "return_type", "is_async", join("decorators"), "extends", join("implements"), join("methods"), join("properties"))


_UNQ = lambda x: f"regexp_replace(trim({x}), '^[''\"]+|[''\"]+$', '', 'g')"
_INNER = "regexp_extract(line, '[(]([^)]*)[)]', 1)"
_FIRST = _UNQ(f"split_part({_INNER}, ',', 1)")
_METHODS = "regexp_extract(line, 'methods[^\\[]*\\[([^\\]]*)\\]', 1)"
cte(
    "line_routes",
    f"""SELECT repo, path, line_no, CASE WHEN kind IN ('nest') THEN CASE WHEN {_UNQ(_INNER)} = '' THEN '/' ELSE {_UNQ(_INNER)} END WHEN kind = 'express' THEN {_UNQ("regexp_extract(line, '(?:app|router)[.][a-z]+[(]([^,]*),', 1)")} WHEN kind IN ('flask', 'fastapi') THEN {_FIRST}
        ELSE CASE WHEN regexp_matches(trim({_INNER}), '^[''"]') THEN {_FIRST} WHEN {_UNQ(f"regexp_extract({_INNER}, '(?:value|path)[^=]*=([^,]*)', 1)")} <> '' THEN {_UNQ(f"regexp_extract({_INNER}, '(?:value|path)[^=]*=([^,]*)', 1)")} ELSE '/' END END AS route,
        CASE kind WHEN 'nest' THEN upper(regexp_extract(line, '@(Get|Post|Put|Delete)[(]', 1)) WHEN 'express' THEN upper(regexp_extract(line, '(?:app|router)[.](get|post|put|delete|patch)[(]', 1))
          WHEN 'flask' THEN CASE WHEN {_METHODS} <> '' THEN array_to_string(list_transform(string_split({_METHODS}, ','), lambda m: {_UNQ("m")}), ',') ELSE 'GET' END WHEN 'fastapi' THEN upper(regexp_extract(line, '@(?:app|router)[.](get|post|put|delete)', 1))
          ELSE CASE WHEN contains(line, '@RequestMapping') THEN coalesce(nullif(regexp_extract(line, 'method\\s*=\\s*RequestMethod[.](GET|POST|PUT|DELETE)', 1), ''), 'ANY') ELSE upper(regexp_extract(line, '@(Get|Post|Put|Delete)Mapping', 1)) END END AS method,
        CASE kind WHEN 'nest' THEN 'NestJS Controller Method' WHEN 'express' THEN 'Express Route Handler' WHEN 'flask' THEN 'Flask Route Handler' WHEN 'fastapi' THEN 'FastAPI Endpoint' ELSE 'Spring Boot Controller Method' END AS handler
        FROM (SELECT *, CASE WHEN language = 'typescript' AND regexp_matches(line, '@(Get|Post|Put|Delete)[(]') THEN 'nest' WHEN language = 'typescript' AND regexp_matches(line, '(?:app|router)[.](get|post|put|delete|patch)[(]') AND contains(line, ',') THEN 'express'
              WHEN language = 'python' AND {has_any("line", ["@app.route", "@bp.route"])} AND contains(line, ')') THEN 'flask' WHEN language = 'python' AND regexp_matches(line, '@(?:app|router)[.](get|post|put|delete)') AND contains(line, ')') THEN 'fastapi'
              WHEN language = 'java' AND regexp_matches(line, '@(Get|Post|Put|Delete|Request)Mapping') THEN 'spring' END AS kind FROM seg_lines) WHERE kind IS NOT NULL""",
)
cte(
    "routes",
    """SELECT repo, path, line_no, route, method, handler FROM line_routes UNION ALL
       SELECT repo, path, 0, CASE language WHEN 'typescript' THEN '/api/*' ELSE '/*' END, 'ANY', CASE language WHEN 'typescript' THEN 'Next.js API Handler' ELSE 'Django View' END FROM seg_files AS f
       WHERE NOT EXISTS (SELECT 1 FROM line_routes AS r WHERE r.repo = f.repo AND r.path = f.path) AND ((language = 'typescript' AND contains(content, 'export default') AND contains(content, 'req') AND contains(content, 'res'))
         OR (language = 'python' AND contains(content, 'def') AND (contains(content, 'request') OR contains(content, 'HttpResponse'))))""",
)


@query("e3_routes", "SELECT repo, path, line_no, route, method, handler FROM routes")
def _(c):
    return segments.routes(c.files)


_LINES = "list_transform(string_split(content, chr(10)), lambda l: trim(l))"
_ACC = "'^(?:private|public|protected) '"
_LAST = lambda l: f"regexp_replace(string_split_regex({l}, '\\s+')[-1], ';+$', '')"


@query(
    "e4_database_models",
    rf"""SELECT repo, segment_id, name, CASE language WHEN 'python' THEN nullif({_UNQ("regexp_extract(content, '__tablename__[^=]*=([^\\n]*)', 1)")}, '') ELSE nullif({_UNQ("regexp_extract(content, '(?s)@Table.*?name.*?=([^,)]*)', 1)")}, '') END AS table_name,
        array_to_string(CASE language WHEN 'python' THEN list_filter(list_transform(list_filter(ls, lambda l: {has_any("l", K.PY_FIELD_WORDS)} AND contains(l, '=')), lambda l: trim(split_part(l, '=', 1))), lambda n: n <> '' AND NOT starts_with(n, '_'))
          ELSE list_transform(list_filter(ls, lambda l: NOT {has_any("l", ["@Column", "@Id", "@GeneratedValue"])} AND regexp_matches(l, {_ACC}) AND contains(l, ';') AND NOT contains(l, '(') AND len(string_split_regex(l, '\s+')) >= 3), lambda l: {_LAST("l")}) END, ',') AS fields,
        array_to_string(CASE language WHEN 'python' THEN list_transform(list_filter(ls, lambda l: {has_any("l", K.PY_RELATION_WORDS)} AND contains(l, '=')), lambda l: trim(split_part(l, '=', 1)))
          ELSE list_filter(list_transform(ls, lambda l, i: CASE WHEN {has_any("l", K.JAVA_RELATION_WORDS)} THEN {_LAST(f"list_filter(ls[i + 1:], lambda x: regexp_matches(x, {_ACC}) AND contains(x, ';'))[1]")} END), lambda n: n IS NOT NULL) END, ',') AS relations
        FROM (SELECT *, {_LINES} AS ls FROM segments WHERE segment_type = 'Database')""".replace("\\\\", "\\"),
)
def _(c):
    m = segments.models(segments.extract(c.files))
    return m.select("repo", "segment_id", "name", "table_name", F.array_join("fields", ",").alias("fields"), F.array_join("relations", ",").alias("relations"))


@query("e5_business_hints", "SELECT repo, hint, count(*) AS n FROM (SELECT repo, unnest(hints) AS hint FROM segments) GROUP BY ALL")
def _(c):
    return segments.extract(c.files).select("repo", F.explode("hints").alias("hint")).groupBy("repo", "hint").agg(F.count("*").alias("n"))


@query("e6_segment_framework", "SELECT repo, segment_id, framework FROM segments WHERE framework IS NOT NULL")
def _(c):
    return c.segments.where("framework IS NOT NULL").select("repo", "segment_id", "framework")


@query(
    "e7_segment_statistics",
    """SELECT repo, 'total' AS dimension, 'all' AS label, count(*) AS n FROM segments GROUP BY repo UNION ALL SELECT repo, 'type', segment_type, count(*) FROM segments GROUP BY ALL
       UNION ALL SELECT repo, 'framework', framework, count(*) FROM segments WHERE framework IS NOT NULL GROUP BY ALL UNION ALL SELECT repo, 'language', language, count(*) FROM segments GROUP BY ALL
       UNION ALL SELECT repo, 'hint', hint, count(*) FROM (SELECT repo, unnest(hints) AS hint FROM segments) GROUP BY ALL""",
)
def _(c):
    return segments.statistics(c.segments)


_PAT = " UNION ALL ".join(f"SELECT repo, segment_id, framework, hints, {q(n)} AS pattern FROM segments WHERE framework = '{f}' AND {has_any('low', ws)}" for f, n, ws in SEGMENT_PATTERNS)


@query("f17_segment_framework_patterns", f"SELECT repo, segment_id, framework, pattern, array_to_string(hints, ',') AS hints FROM ({_PAT})")
def _(c):
    return segments.patterns(c.segments).withColumn("hints", F.array_join("hints", ","))


@query(
    "f10_segment_boost",
    f"""SELECT repo, framework, coalesce(n, 0) AS segments, {rnd("least(confidence + CASE WHEN n > 10 THEN 3e-1 WHEN n >= 4 THEN 2e-1 WHEN n >= 1 THEN 1e-1 ELSE 0e0 END, 1e0)")} AS confidence
        FROM fw_enhanced LEFT JOIN (SELECT repo, framework, count(*) AS n FROM segments WHERE framework IS NOT NULL GROUP BY ALL) USING (repo, framework)""",
)
def _(c):
    n = c.segments.where("framework IS NOT NULL").groupBy("repo", "framework").agg(F.count("*").alias("n"))
    boost = F.when(F.col("n") > 10, 0.3).when(F.col("n") >= 4, 0.2).when(F.col("n") >= 1, 0.1).otherwise(0.0)
    return c.fw_enhanced.join(n, ["repo", "framework"], "left").select(
        "repo", "framework", F.coalesce("n", F.lit(0)).alias("segments"), r6(F.least(F.col("confidence") + boost, F.lit(1.0))).alias("confidence")
    )


# --- components -----------------------------------------------------------------

_H = lambda *ws: has_any("content", ws)
_TS_TYPE = f"""CASE WHEN contains(ln, 'page') OR {_H('useRouter', 'Router')} THEN 'Page' WHEN contains(ln, 'layout') OR {_H('children')} THEN 'Layout' WHEN contains(ln, 'form') OR {_H('onSubmit')} THEN 'Form' WHEN {has_any('ln', ['nav', 'menu'])} THEN 'Navigation'
    WHEN {has_any('ln', ['modal', 'dialog'])} THEN 'Modal' WHEN contains(ln, 'hook') OR starts_with(ln, 'use') THEN 'Hook' WHEN contains(ln, 'context') OR {_H('createContext')} THEN 'Context' WHEN {has_any('ln', ['service', 'api'])} THEN 'Service'
    WHEN {_H('return')} AND {_H('jsx', '<')} THEN 'Display' ELSE 'Utility' END"""
_PY_TYPE = f"""CASE WHEN {_H('class')} AND {_H('View')} THEN 'Service' WHEN {_H('class')} AND {_H('Model')} THEN 'Display' WHEN {_H('def')} AND {_H('render')} THEN 'Display' WHEN {_H('@app.route', '@bp.route')} THEN 'Service' WHEN {_H('forms.', 'Form')} THEN 'Display' ELSE 'Utility' END"""
_JAVA_TYPE = f"CASE WHEN {_H('@RestController', '@Controller', '@Service', '@Repository')} THEN 'Service' WHEN {_H('@Entity')} THEN 'Display' ELSE 'Utility' END"
_CX = "least(CASE language " + " ".join(f"WHEN '{lang}' THEN {K.COMPLEXITY_BASE} + " + " + ".join(f"(length(content) - length(replace(content, {q(t)}, ''))) // {len(t)} * {w}" for t, w in ts) for lang, ts in K.COMPLEXITY.items()) + " END, 100)"
_TAIL = lambda done, low: f"CASE WHEN {done} THEN 'Complete' WHEN length_b < {low} THEN 'Incomplete' ELSE 'Complete' END"
_STATUS = f"""CASE WHEN {_H('TODO', 'FIXME')} THEN 'Todo' WHEN language = 'typescript' THEN CASE WHEN {_H('throw new Error', 'console.error')} THEN 'InProgress' ELSE {_TAIL(_H('test', 'spec'), 100)} END
    WHEN language = 'python' THEN CASE WHEN (length(content) - length(replace(content, 'pass', ''))) // 4 > 1 THEN 'Todo' WHEN {_H('print(', 'logging.debug')} THEN 'InProgress' ELSE {_TAIL(_H('def test_', 'class Test'), 200)} END
    ELSE CASE WHEN {_H('throw new UnsupportedOperationException')} THEN 'Todo' WHEN {_H('System.out.println', 'logger.debug')} THEN 'InProgress' ELSE {_TAIL(_H('@Test'), 200)} END END"""
_ALL = lambda p, g=1: f"regexp_extract_all(content, {q(p)}, {g})"
_IMPORTS = f"""CASE language WHEN 'typescript' THEN list_filter({_ALL(K.TS_IMPORT)}, lambda d: NOT starts_with(d, '.') AND NOT starts_with(d, '/'))
    WHEN 'python' THEN list_sort(list_distinct(list_filter(list_transform(list_zip({_ALL(K.PY_IMPORT, 1)}, {_ALL(K.PY_IMPORT, 2)}), lambda p: CASE WHEN p[1] <> '' THEN p[1] ELSE p[2] END), lambda d: NOT starts_with(d, '.') AND NOT starts_with(d, '__'))))
    ELSE list_filter({_ALL(K.JAVA_IMPORT)}, lambda d: NOT starts_with(d, 'java.lang')) END"""
_CALL = lambda p, m: f"list_transform({_ALL(p)}, lambda e: {{'endpoint': e, 'method': '{m}'}})"
_CALLS = f"""CASE language WHEN 'typescript' THEN list_concat({_CALL(K.TS_FETCH, 'GET')}, list_transform(list_zip({_ALL(K.TS_AXIOS, 2)}, {_ALL(K.TS_AXIOS, 1)}), lambda p: {{'endpoint': p[1], 'method': upper(p[2])}}))
    WHEN 'python' THEN list_concat({_CALL(K.PY_ROUTE, 'HTTP')}, {_CALL(K.PY_PATH, 'HTTP')}) ELSE {_CALL(K.JAVA_MAPPING, 'REST')} END"""
cte(
    "components",
    f"""SELECT repo, path, language, name, content, CASE language WHEN 'typescript' THEN {_TS_TYPE} WHEN 'python' THEN {_PY_TYPE} ELSE {_JAVA_TYPE} END AS component_type, {_IMPORTS} AS imports, {_CALLS} AS api_calls, {_CX} AS complexity, {_STATUS} AS status
        FROM (SELECT *, lower(name) AS ln FROM (SELECT *, length AS length_b, regexp_replace(string_split(path, '/')[-1], '^(.+)[.][^.]*$', '\\1') AS name FROM seg_files))""",
)


@query("m1_component_table", "SELECT repo, path, name, component_type, complexity, status, len(imports) AS n_imports, len(api_calls) AS n_calls FROM components")
def _(c):
    return c.components.select("repo", "path", "name", "component_type", "complexity", "status", F.size("imports").alias("n_imports"), F.size("api_calls").alias("n_calls"))


_P = lambda t: "concat(" + ", ".join(x for x in [q(t.split("%s")[0]), "name", q(t.split("%s")[1])]) + ")"
_PURPOSE = "CASE WHEN language = 'typescript' THEN CASE component_type " + " ".join(f"WHEN '{k}' THEN {_P(t)}" for k, t in K.PURPOSES.items()) + " END WHEN language = 'python' THEN CASE " + " ".join(
    f"WHEN {cond} THEN {_P(t)}" for cond, t in [
        (_H("@app.route"), "Flask route handler for %s"), (f"{_H('class')} AND {_H('View')}", "Django view handling requests for %s"), (f"{_H('class')} AND {_H('Model')}", "Django model representing %s data"),
        (_H("forms."), "Django form for %s data validation"), ("component_type = 'Service'", "Service component for %s"), ("component_type = 'Display'", "Display component for %s")]
) + f" ELSE {_P('Utility module for %s')} END ELSE CASE " + " ".join(
    f"WHEN {cond} THEN {_P(t)}" for cond, t in [
        (_H("@RestController"), "REST controller handling HTTP requests for %s"), (_H("@Service"), "Service layer providing business logic for %s"), (_H("@Repository"), "Data access layer for %s operations"),
        (_H("@Entity"), "JPA entity representing %s data model"), ("component_type = 'Service'", "Service component for %s")]
) + f" ELSE {_P('Utility class for %s')} END END"


@query("m2_component_type_and_purpose", f"SELECT repo, path, component_type, {_PURPOSE} AS purpose FROM components")
def _(c):
    return c.components.select("repo", "path", "component_type", "purpose")


@query("m3_complexity_score", "SELECT repo, path, complexity FROM components")
def _(c):
    return c.components.select("repo", "path", "complexity")


@query("m4_implementation_status", "SELECT repo, status, count(*) AS n FROM components GROUP BY ALL")
def _(c):
    return c.components.groupBy("repo", "status").agg(F.count("*").alias("n"))


@query("m5_imports", "SELECT repo, path, i AS import_name, count(*) AS n FROM (SELECT repo, path, unnest(imports) AS i FROM components) GROUP BY ALL")
def _(c):
    return c.components.select("repo", "path", F.explode("imports").alias("import_name")).groupBy("repo", "path", "import_name").agg(F.count("*").alias("n"))


@query("m6_api_calls", "SELECT repo, method, count(*) AS n, count(DISTINCT endpoint) AS endpoints FROM (SELECT repo, a.endpoint AS endpoint, a.method AS method FROM (SELECT repo, unnest(api_calls) AS a FROM components)) GROUP BY ALL")
def _(c):
    per = components.endpoints(c.components).groupBy("repo", "method", "endpoint").agg(F.count("*").alias("n"))
    return per.groupBy("repo", "method").agg(F.sum("n").alias("n"), F.count("*").alias("endpoints"))


_LN = lambda x: f"string_split_regex(regexp_replace({x}, '\\r?\\n\\z', ''), '\\r?\\n')"
_IFACE = f"flatten(list_transform({_ALL(K.TS_PROPS, 2)}, lambda b: list_transform(list_filter(list_transform({_LN('b')}, lambda l: trim(l)), lambda l: contains(l, ':')), lambda l: concat(regexp_replace(trim(split_part(l, ':', 1)), '[?]+$', ''), '/', regexp_replace(regexp_replace(trim(regexp_replace(l, '^[^:]*:', '')), ',+$', ''), ';+$', ''), '/', NOT ends_with(trim(split_part(l, ':', 1)), '?')))))"
_ARGS = f"flatten(list_transform({_ALL(K.TS_ARGUMENTS, 1)}, lambda b: list_transform(string_split(b, ','), lambda p: concat(trim(split_part(p, ':', 1)), '/unknown/true'))))"
_PYARGS = f"list_transform(list_zip({_ALL(K.PY_ARGUMENT, 1)}, {_ALL(K.PY_ARGUMENT, 2)}), lambda p: concat(p[1], '/', p[2], '/true'))"


@query("m7_props", f"SELECT repo, path, unnest(CASE language WHEN 'typescript' THEN list_concat({_IFACE}, {_ARGS}) WHEN 'python' THEN {_PYARGS} ELSE [] END) AS prop FROM components")
def _(c):
    return c.components.select("repo", "path", F.explode("props").alias("p")).select("repo", "path", F.concat_ws("/", "p.name", "p.type", F.col("p.required").cast("string")).alias("prop"))


@query("m8_hooks", "SELECT repo, path, array_to_string(list_filter([" + ", ".join(q(h) for h in K.HOOKS) + "], lambda h: contains(content, h)), ',') AS hooks FROM components WHERE language = 'typescript'")
def _(c):
    return c.components.where("language = 'typescript'").select("repo", "path", F.array_join("hooks", ",").alias("hooks"))


@query("m9_endpoint_table", "SELECT repo, path, component, status, a.endpoint AS endpoint, a.method AS method FROM (SELECT repo, path, name AS component, status, unnest(api_calls) AS a FROM components)")
def _(c):
    return components.endpoints(c.components)


@query("m10_component_relations", "SELECT DISTINCT a.repo, a.name AS source, a.i AS target FROM (SELECT repo, name, unnest(imports) AS i FROM components) AS a JOIN components AS b ON b.repo = a.repo AND b.name = a.i")
def _(c):
    return components.relations(c.components)


_ROLL = "CASE WHEN bool_and(status = 'Complete') THEN 'Complete' WHEN bool_or(status IN ('Complete', 'InProgress')) THEN 'InProgress' ELSE 'Todo' END"


@query("m11_status_rollup", f"SELECT repo, component_type, {_ROLL} AS status, count(*) AS n FROM components GROUP BY repo, component_type")
def _(c):
    return components.type_status(c.components)


cte(
    "component_completion",
    f"""SELECT repo, count(*) FILTER (status = 'Complete') AS complete, count(*) FILTER (status = 'InProgress') AS in_progress, count(*) FILTER (status = 'Todo') AS todo, count(*) FILTER (status = 'Incomplete') AS incomplete, count(*) AS total,
        {rnd("count(*) FILTER (status = 'Complete') * 100e0 / count(*)")} AS percent_complete, count(*) FILTER (complexity > 80) AS debt_items FROM components GROUP BY repo""",
)


@query("m12_completion_and_debt", "SELECT * FROM component_completion")
def _(c):
    return components.completion(c.components)


def _named(w):
    return f"(contains(path, '.{w}.') OR contains(lower(name), '{w}'))"


def _score(role, w, ws, folder):
    cond = has_any("lower(name)", ws) + (f" OR contains(lower(path), '{folder}')" if folder else "")
    return f"sum(CASE WHEN {_named(role)} AND ({cond}) THEN {w} ELSE 0 END)"


def _ends(ws):
    return f"sum(CASE WHEN {_named('controller')} THEN 2 * len(list_filter(api_calls, lambda a: {has_any('lower(a.endpoint)', ws)})) ELSE 0 END)"


@query(
    "m13_controller_service_scoring",
    f"""SELECT repo, domain, CAST(score AS BIGINT) AS score, controllers FROM (SELECT repo, controllers, CASE WHEN au > 3 AND us > 2 THEN 'UserManagement' WHEN pe > 3 THEN 'RealEstate' WHEN pr > 3 THEN 'Ecommerce' WHEN au > 2 THEN 'Authentication' WHEN controllers > 0 THEN 'API' END AS domain,
        CASE WHEN au > 3 AND us > 2 THEN au + us WHEN pe > 3 THEN pe WHEN pr > 3 THEN pr WHEN au > 2 THEN au WHEN controllers > 0 THEN controllers END AS score FROM
        (SELECT repo, {_score("controller", 3, ["auth"], "/auth/")} + {_ends(["auth", "login", "register"])} + {_score("service", 2, ["auth", "jwt", "session"], "/auth/")} + {_score("middleware", 2, ["auth", "jwt", "session"], None)} AS au,
         {_score("controller", 3, ["user"], "/user/")} + {_ends(["user", "profile"])} + {_score("service", 2, ["user"], "/user/")} AS us, {_score("controller", 3, ["property"], "/property/")} + {_ends(["property", "listing"])} AS pe,
         {_score("controller", 3, ["product"], "/product/")} + {_ends(["product", "inventory"])} AS pr, count(*) FILTER ({_named("controller")}) AS controllers FROM components GROUP BY repo)) WHERE domain IS NOT NULL""",
)
def _(c):
    return components.domain_decision(c.components)


@query(
    "m14_integration_points",
    f"""SELECT repo, 'config' AS kind, path AS item, {case_map("path", K.CONFIG_FILES)} AS detail FROM files WHERE path IN ({", ".join(q(p) for p in K.CONFIG_FILES)})
        UNION ALL SELECT repo, 'service', 'HTTP API', 'REST API' FROM files WHERE path = 'package.json' AND {has_any("content", ['"axios"', '"fetch"'])}""",
)
def _(c):
    return components.integration_points(c.files)


_GROUP = "CASE " + " ".join(f"WHEN {has_any('lower(name)', ws)}" + (f" OR {has_any(chr(99) + 'oncat(' + q('/') + ', lower(path))', ps)}" if ps else "") + f" THEN '{g}'" for g, ws, ps in K.STORY_GROUPS) + " END"
cte("comp_groups", f"SELECT *, {_GROUP} AS g FROM components")
_G = [g for g, _, _ in K.STORY_GROUPS]
cte("story_has", "SELECT repo, " + ", ".join(f"bool_or(coalesce(g = '{g}', FALSE)) AS has_{g}" for g in _G) + " FROM comp_groups WHERE language = 'typescript' GROUP BY repo")
cte("group_status", f"SELECT repo, g, {_ROLL} AS status FROM comp_groups WHERE language = 'typescript' AND g IS NOT NULL GROUP BY repo, g")
cte(
    "template_stories",
    f"""SELECT h.repo, t.rank, '' AS path, t.title, t.priority, t.complexity, s.status, t.g AS story_group, t.description FROM story_has AS h, {values([(i, g, t, p, x, K.STORY_SENTENCES[i]) for i, (g, t, p, x, _) in enumerate(K.STORIES)], "rank, g, title, priority, complexity, description", "t")}
        JOIN group_status AS s ON s.repo = h.repo AND s.g = t.g WHERE CASE t.g WHEN 'User' THEN has_User WHEN 'Property' THEN has_Property AND NOT has_User WHEN 'Location' THEN has_Location WHEN 'Image' THEN has_Image
          ELSE has_API AND NOT (has_User OR has_Property OR has_Location OR has_Image) END""",
)
cte(
    "named_stories",
    f"""SELECT repo, 100 AS rank, path, CASE WHEN svc AND language = 'python' THEN concat('Access ', name, ' functionality') WHEN svc THEN concat('Use ', name, ' service') WHEN disp THEN concat('View ', name, ' interface') ELSE concat('Use ', name) END AS title, 'Medium' AS priority,
       CASE WHEN svc THEN CASE WHEN complexity > 50 THEN 'Complex' ELSE 'Medium' END WHEN disp THEN CASE WHEN complexity > 40 THEN 'Complex' ELSE 'Simple' END ELSE CASE WHEN complexity > 60 THEN 'Complex' ELSE 'Medium' END END AS complexity, status, name AS story_group,
       CASE WHEN svc THEN replace(CASE language WHEN 'python' THEN {q(K.PYTHON_SERVICE_SENTENCE)} ELSE {q(K.JAVA_SERVICE_SENTENCE)} END, '%s', name) WHEN disp THEN replace({q(K.DISPLAY_SENTENCE)}, '%s', name)
         ELSE concat({", name, ".join(q(x) for x in K.PLAIN_SENTENCE.split("%s")[:2])}, lower(purpose)) END AS description FROM
       (SELECT *, {_PURPOSE} AS purpose, component_type = 'Service' AND language IN ('python', 'java') AS svc, component_type = 'Display' AND language = 'python' AS disp,
        language = 'typescript' AND complexity > 30 AND repo NOT IN (SELECT repo FROM template_stories) AS plain FROM components) WHERE svc OR disp OR plain""",
)
cte(
    "stories",
    "SELECT *, concat('US-', CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END) AS id FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rank, path, title) AS n FROM (SELECT * FROM template_stories UNION ALL SELECT * FROM named_stories))",
)


@query("m15_stories", "SELECT repo, id, title, priority, complexity, status FROM stories")
def _(c):
    return c.stories.select("repo", "id", "title", "priority", "complexity", "status")


cte(
    "tasks",
    """SELECT *, concat('T-', CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END) AS id FROM (SELECT repo, path, concat(CASE WHEN status = 'InProgress' THEN 'Complete ' ELSE 'Implement ' END, name) AS name, status,
       CASE WHEN status = 'InProgress' THEN 'Small' WHEN complexity > 50 THEN 'Large' ELSE 'Medium' END AS effort, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM components WHERE status <> 'Complete')""",
)


@query("m15_story_sentences", "SELECT repo, id, title, description FROM stories")
def _(c):
    return c.stories.select("repo", "id", "title", "description")


@query("m16_tasks", "SELECT repo, id, name, status, effort FROM tasks")
def _(c):
    return c.tasks.select("repo", "id", "name", "status", "effort")


@query(
    "m17_feature_facts",
    f"SELECT repo, component_type, count(*) AS n, {case_map('component_type', {k: v[0] for k, v in K.FEATURES.items()})} AS feature, {case_map('component_type', {k: v[1] for k, v in K.FEATURES.items()})} AS user_value FROM components GROUP BY repo, component_type",
)
def _(c):
    return components.features(c.components)
