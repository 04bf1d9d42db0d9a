"""Queries on scans, file filters and manifests."""

from pyspark.sql import functions as F

from repograin.functions.text import file_stem
from repograin.plans import corpus_ctes  # noqa: F401
from repograin.plans.base import case_map, cte, frame, q, query, values
from repograin.rules import languages as L
from repograin.sources import corpus, manifests


@frame("deps")
def _(c):
    return manifests.dependencies(c.files)


@frame("metadata")
def _(c):
    return manifests.metadata(c.files)


@query("s1_corpus_scan", "SELECT repo, path, ext, lang, length, md5(content) AS content_md5 FROM files")
def _(c):
    return c.files.select("repo", "path", "ext", "lang", "length", F.md5("content").alias("content_md5"))


@query("s2_files_by_extension", "SELECT repo, ext, count(*) AS n FROM pruned_files WHERE ext <> '' GROUP BY ALL")
def _(c):
    return corpus.prune_directories(c.files).where("ext <> ''").groupBy("repo", "ext").agg(F.count("*").alias("n"))


@query("s3_include_exclude_globs", "SELECT repo, path FROM reality_files")
def _(c):
    return corpus.reality_files(c.files).select("repo", "path")


@query("s4_directory_pruning", "SELECT repo, count(*) AS kept, (SELECT count(*) FROM files AS f WHERE f.repo = p.repo) AS scanned FROM pruned_files AS p GROUP BY repo")
def _(c):
    return c.files.groupBy("repo").agg(F.count_if(corpus.not_ignored(F.col("path"))).alias("kept"), F.count("*").alias("scanned"))


@query(
    "s5_size_and_depth_caps",
    f"""SELECT repo, path, length, length // 1048576 <= {L.MARKER_MAX_MB} AND len(string_split(path, '/')) - 1 <= {L.MARKER_MAX_DEPTH} AS marker_ok,
        length <= {L.REALITY_MAX_KB * 1024} AS reality_ok, length <= {L.DOCUMENT_MAX_KB * 1024} AS document_ok FROM files""",
)
def _(c):
    return corpus.size_flags(c.files)


@query("s6_file_language", "SELECT repo, lang, count(*) AS n, count(*) FILTER (lang IS NULL) AS defaulted, CAST(sum(length) AS BIGINT) AS n_bytes FROM files GROUP BY ALL")
def _(c):
    return c.files.groupBy("repo", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang").isNull()).alias("defaulted"), F.sum("length").alias("n_bytes"))


_FILES = ["package.json", "requirements.txt", "Cargo.toml", "deno.json", "pom.xml", "tsconfig.json"]
_DIRS = ["src/components", "src/controllers", "app", "pages"]


@query(
    "s7_file_and_directory_probes",
    "SELECT repo, " + ", ".join([f"bool_or(path = '{f}') AS has_{i}" for i, f in enumerate(_FILES)] + [f"bool_or(starts_with(path, '{d}/')) AS has_dir_{i}" for i, d in enumerate(_DIRS)]) + " FROM files GROUP BY repo",
)
def _(c):
    return c.files.groupBy("repo").agg(
        *[F.bool_or(F.col("path") == f).alias(f"has_{i}") for i, f in enumerate(_FILES)],
        *[F.bool_or(F.col("path").startswith(d + "/")).alias(f"has_dir_{i}") for i, d in enumerate(_DIRS)],
    )


def _json_deps(path, key, scope):
    return (
        f"SELECT repo, '{path}' AS manifest, name, json_extract_string(content, '$.{key}.\"' || name || '\"') AS version, '{scope}' AS scope FROM "
        f"(SELECT repo, content, unnest(json_keys(content, '$.{key}')) AS name FROM files WHERE path = '{path}')"
    )


_SEP_CASES = lambda part: "CASE " + " ".join(
    f"WHEN contains(t, '{s}') THEN trim({'left(t, strpos(t, ' + q(s) + ') - 1)' if part == 0 else 'substr(t, strpos(t, ' + q(s) + ') + ' + str(len(s)) + ')'})" for s in manifests.SEPARATORS
) + (" ELSE trim(t) END" if part == 0 else " ELSE '*' END")
cte(
    "cargo_deps",
    """SELECT repo, 'Cargo.toml' AS manifest, trim(split_part(t, '=', 1)) AS name,
       CASE WHEN starts_with(v, '"') THEN regexp_extract(v, '^"([^"]*)"', 1) ELSE coalesce(nullif(regexp_extract(v, 'version\\s*=\\s*"([^"]*)"', 1), ''), '*') END AS version, split_part(section, '.', 1) AS scope
       FROM (SELECT *, trim(regexp_replace(t, '^[^=]*=', '')) AS v, last_value(header IGNORE NULLS) OVER (PARTITION BY repo ORDER BY line_no) AS section FROM
             (SELECT repo, line_no, trim(line) AS t, CASE WHEN trim(line) LIKE '[%' THEN regexp_extract(trim(line), '^\\[([^\\]]*)\\]', 1) END AS header FROM all_lines WHERE path = 'Cargo.toml'))
       WHERE t NOT LIKE '[%' AND contains(t, '=') AND (section LIKE 'dependencies%' OR section LIKE 'dev-dependencies%')""",
)
cte(
    "deps",
    _json_deps("package.json", "dependencies", "dependencies") + " UNION ALL " + _json_deps("package.json", "devDependencies", "devDependencies")
    + " UNION ALL " + _json_deps("deno.json", "imports", "imports") + " UNION ALL SELECT * FROM cargo_deps UNION ALL "
    + f"SELECT repo, 'requirements.txt', {_SEP_CASES(0)}, {_SEP_CASES(1)}, 'dependencies' FROM (SELECT repo, trim(line) AS t FROM all_lines WHERE path = 'requirements.txt') WHERE t <> '' AND t NOT LIKE '#%'",
)


@query("s8_package_json", "SELECT repo, name, version, scope FROM deps WHERE manifest = 'package.json'")
def _(c):
    return c.deps.where("manifest = 'package.json'").select("repo", "name", "version", "scope")


@query("s9_cargo_toml", "SELECT repo, name, version, scope FROM deps WHERE manifest = 'Cargo.toml'")
def _(c):
    return manifests.cargo_dependencies(c.files).select("repo", "name", "version", "scope")


@query("s10_python_requirements", "SELECT repo, name, version FROM deps WHERE manifest = 'requirements.txt'")
def _(c):
    return c.deps.where("manifest = 'requirements.txt'").select("repo", "name", "version")


@query(
    "s11_deno_config",
    """SELECT d.repo, name, version, contains(content, 'launch-server') AS has_launch_task, json_exists(content, '$.compilerOptions') AS has_compiler_options
       FROM deps AS d JOIN files AS f ON f.repo = d.repo AND f.path = d.manifest WHERE manifest = 'deno.json'""",
)
def _(c):
    cfg = F.from_json("content", manifests.DENO_SCHEMA)
    return c.files.where("path = 'deno.json'").select(
        "repo", F.explode(cfg["imports"]).alias("name", "version"), F.map_contains_key(cfg["tasks"], "launch-server").alias("has_launch_task"),
        cfg["compilerOptions"].isNotNull().alias("has_compiler_options"),
    )


_TOML = lambda key: f"nullif(regexp_extract(content, '(?m)^{key}\\s*=\\s*\"([^\"]*)\"', 1), '')"
_J = lambda key: f"json_extract_string(CASE WHEN path LIKE '%.json' THEN content ELSE '{{}}' END, '$.{key}')"
cte(
    "metadata",
    f"""SELECT repo, path AS manifest, list_position([{", ".join(q(p) for p in manifests.PRECEDENCE)}], path) AS rank,
        CASE path WHEN 'package.json' THEN coalesce({_J("name")}, 'unknown') WHEN 'deno.json' THEN coalesce({_J("name")}, 'deno-project') WHEN 'Cargo.toml' THEN coalesce({_TOML("name")}, 'rust-project') ELSE repo END AS name,
        CASE path WHEN 'Cargo.toml' THEN {_TOML("version")} WHEN 'requirements.txt' THEN NULL ELSE {_J("version")} END AS version,
        CASE path WHEN 'Cargo.toml' THEN {_TOML("description")} WHEN 'requirements.txt' THEN NULL ELSE {_J("description")} END AS description,
        CASE path WHEN 'package.json' THEN {_J("license")} WHEN 'deno.json' THEN {_J("license")} WHEN 'Cargo.toml' THEN {_TOML("license")} END AS license,
        CASE path WHEN 'package.json' THEN {_J("repository.url")} END AS repository, CASE path WHEN 'package.json' THEN {_J("author")} END AS author,
        {case_map("path", manifests.MANAGERS)} AS package_manager FROM files WHERE path IN ({", ".join(q(p) for p in manifests.PRECEDENCE)})""",
)
cte(
    "preferred",
    """SELECT repo, manifest, coalesce(name, repo) AS name, version, description, license, repository, author, coalesce(package_manager, 'Unknown') AS package_manager FROM repos
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rank) AS k FROM metadata) AS m USING (repo) WHERE coalesce(k, 1) = 1""",
)


@frame("preferred")
def _(c):
    return manifests.preferred(c.repos, c.metadata)


@query("s8_manifest_metadata", "SELECT repo, manifest, name, version, description, license, repository, author, package_manager FROM metadata")
def _(c):
    return c.metadata.select("repo", "manifest", "name", "version", "description", "license", "repository", F.array_join("authors", ",").alias("author"), "package_manager")


@query("s12_manifest_precedence", "SELECT repo, manifest, name, version, package_manager FROM preferred")
def _(c):
    return c.preferred.select("repo", "manifest", "name", "version", "package_manager")


@query(
    "s14_multi_root_union",
    "SELECT repo, path, root FROM (SELECT repo, path, CASE WHEN path LIKE 'docs/%' THEN 'docs' ELSE 'root' END AS root FROM doc_files)",
)
def _(c):
    docs = corpus.documentation_files(c.files).select("repo", "path")
    inner = docs.where("path LIKE 'docs/%'").withColumn("root", F.lit("docs"))
    outer = docs.where("path NOT LIKE 'docs/%'").withColumn("root", F.lit("root"))
    return inner.unionByName(outer).dropDuplicates(["repo", "path"])


@query("s15_documentation_files", "SELECT repo, path, TRUE AS is_doc, list_contains((SELECT list(c.repo || c.path) FROM claim_files AS c), repo || path) AS is_claim_source FROM doc_files")
def _(c):
    is_claim = F.col("path").rlike(corpus._doc_path(L.CLAIM_PATTERNS)) & (F.col("length") <= L.DOCUMENT_MAX_KB * 1024)
    return corpus.documentation_files(c.files).select("repo", "path", F.lit(True).alias("is_doc"), is_claim.alias("is_claim_source"))


_PATTERNS = [("flask", "*.py", "from flask import"), ("react", "*.tsx", "useState("), ("nest", "*.ts", "@Injectable"), ("spring", "*.java", "@RestController"), ("axum", "*.rs", "use axum")]


@query(
    "p1_any_substring_match",
    f"SELECT repo, name, bool_or(ends_with(path, ext_glob[2:]) AND contains(content, pattern)) AS found FROM files, {values(_PATTERNS, 'name, ext_glob, pattern', 'p')} GROUP BY repo, name",
)
def _(c):
    flags = [F.bool_or(F.col("path").endswith(g[1:]) & F.col("content").contains(p)).alias(n) for n, g, p in _PATTERNS]
    wide = c.files.groupBy("repo").agg(*flags)
    return wide.unpivot("repo", [n for n, _, _ in _PATTERNS], "name", "found")


@query("s6_file_stems", "SELECT stem, count(*) AS n FROM (SELECT regexp_replace(string_split(path, '/')[-1], '^(.+)[.][^.]*$', '\\1') AS stem FROM files) GROUP BY stem")
def _(c):
    return c.files.groupBy(file_stem(F.col("path")).alias("stem")).agg(F.count("*").alias("n"))
