"""SQL of the derived corpus for the checking engine."""

from repograin.plans.base import case_map, cte, q, values
from repograin.rules import languages as L
from repograin.sources import code_corpus as C
from repograin.sources.corpus import globs_regex, _doc_path

_KINDS = values([(k, p, h) for k, (p, h) in C.KINDS.items()], "kind, path_t, head_t", "k")
_MARKERS = "[" + ", ".join(q(m) for m in C.MARKERS) + "]"
_TABLE = "[" + ", ".join(q(k) for k in C.KIND_TABLE) + "]"
_ECO = f"{C.REPO_NO_SQL} % {len(C.ECOSYSTEMS)}"
_MANIFESTS = values([(e, p, t) for e, ms in enumerate(C.MANIFESTS) for p, t in ms], "eco, path_t, text_t", "m")
cte(
    "raw_files",
    f"""SELECT {C.REPO_SQL} AS repo, {C.fill_sql("path_t")} AS path, concat({C.fill_sql(f"concat(head_t, {_MARKERS}[doc_id % 7 + 1])")}, text) AS content,
        1700000000 + doc_id * 60 AS modified
        FROM (SELECT *, {_TABLE}[{_ECO} * {C.SLOTS} + doc_id % {C.SLOTS} + 1] AS kind FROM documents) AS d JOIN {_KINDS} USING (kind)
        UNION ALL SELECT {C.REPO_SQL}, {C.fill_sql("path_t")}, {C.fill_sql("text_t")}, 1700000000 + doc_id * 60
        FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY {C.REPO_SQL}) JOIN {_MANIFESTS} ON eco = {_ECO}""",
)
cte(
    "files",
    rf"""SELECT repo, path, ext, {case_map("ext", L.LANGUAGE_BY_EXTENSION)} AS lang, CAST(strlen(content) AS BIGINT) AS length,
        modified, content FROM (SELECT *, regexp_extract(path, '[^/]\.([^./]+)$', 1) AS ext FROM raw_files)""",
)
cte("repos", f"SELECT DISTINCT {C.REPO_SQL} AS repo FROM documents")
cte(
    "all_lines",
    r"""SELECT repo, path, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM
        (SELECT repo, path, string_split_regex(regexp_replace(content, '\r?\n\z', ''), '\r?\n') AS ls FROM files WHERE content <> '')""",
)
cte(
    "marker_files",
    f"""SELECT * FROM files WHERE regexp_matches(path, {q(globs_regex(L.MARKER_INCLUDE))}) AND NOT regexp_matches(path, {q(globs_regex(L.MARKER_EXCLUDE))})""",
)
cte(
    "reality_files",
    f"""SELECT * FROM files WHERE regexp_matches(path, {q(globs_regex(L.REALITY_INCLUDE))}) AND NOT regexp_matches(path, {q(globs_regex(L.REALITY_EXCLUDE))})""",
)
cte(
    "doc_files",
    f"""SELECT * FROM files WHERE regexp_matches(path, {q(_doc_path(L.DOC_PATTERNS))})""",
)
cte("claim_files", f"SELECT * FROM files WHERE regexp_matches(path, {q(_doc_path(L.CLAIM_PATTERNS))})")
IGNORED = "[" + ", ".join(q(d) for d in L.IGNORED_DIRECTORIES) + "]"
cte("pruned_files", f"SELECT * FROM files WHERE NOT list_has_any(string_split(path, '/')[1:-2], {IGNORED})")
