"""Readers of dependency manifests: one narrow pass over manifest files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions.text import lines
from repograin.registry import operator

NODE_SCHEMA = (
    "name string, version string, description string, license string, repository struct<url:string>, author string, "
    "authors array<string>, dependencies map<string,string>, devDependencies map<string,string>"
)
DENO_SCHEMA = (
    "name string, version string, description string, license string, imports map<string,string>, tasks map<string,string>, "
    "compilerOptions map<string,string>"
)
# Manifest files in order of precedence, and their defaults.
PRECEDENCE = ["deno.json", "deno.jsonc", "package.json", "Cargo.toml", "pyproject.toml", "requirements.txt"]
MANAGERS = {
    "deno.json": "Deno", "deno.jsonc": "Deno", "package.json": "Npm", "Cargo.toml": "Cargo",
    "pyproject.toml": "Poetry", "requirements.txt": "Pip",
}
# Separators of a requirement, in the order they are tried.
SEPARATORS = [">=", "<=", "==", ">", "<", "~="]

_DEP = "array<struct<name:string,version:string,scope:string>>"


def manifest_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").isin(PRECEDENCE))


def _entries(deps: Column, scope: str) -> Column:
    pairs = F.transform(
        F.map_entries(deps), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(scope).alias("scope"))
    )
    return F.coalesce(pairs, F.array().cast(_DEP))


def requirement(text: Column) -> Column:
    """``struct<name,version>``: split at the first separator of the fixed order that occurs."""
    out = None
    for sep in SEPARATORS:
        at = F.instr(text, sep)
        pair = F.struct(F.trim(F.substring(text, F.lit(1), at - 1)).alias("name"), F.trim(F.substring(text, at + len(sep), F.length(text))).alias("version"))
        out = F.when(at > 0, pair) if out is None else out.when(at > 0, pair)
    return out.otherwise(F.struct(F.trim(text).alias("name"), F.lit("*").alias("version")))


def _requirements(content: Column) -> Column:
    kept = F.filter(F.transform(lines(content), lambda l: F.trim(l)), lambda l: (l != "") & ~l.startswith("#"))
    return F.transform(kept, lambda l: F.struct(requirement(l)["name"].alias("name"), requirement(l)["version"].alias("version"), F.lit("dependencies").alias("scope")))


def toml_value(content: Column, section: str, key: str) -> Column:
    """String value of a key in a TOML section; null if absent."""
    body = F.regexp_extract(content, rf"(?s)(?:^|\n)\[{section}\][ \t]*\n(.*?)(?:\n\[|\z)", 1)
    return F.nullif(F.regexp_extract(body, rf'(?m)^[ \t]*{key}[ \t]*=[ \t]*"([^"]*)"', 1), F.lit(""))


@operator("manifests.cargo_lines")
def cargo_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies inside ``[dependencies…]`` tables, with a forward-filled section name.

    The fold over the lines of one manifest keeps the current section.
    """
    start = F.struct(F.lit("").alias("section"), F.array().cast(_DEP).alias("deps"))

    def step(acc: Column, line: Column) -> Column:
        text = F.trim(line)
        header = F.regexp_extract(text, r"^\[([^\]]*)\]", 1)
        inside = acc["section"].startswith("dependencies") | acc["section"].startswith("dev-dependencies")
        value = F.trim(F.substring_index(text, "=", -1))
        value = F.trim(F.regexp_replace(text, "^[^=]*=", ""))
        version = (
            F.when(value.startswith('"'), F.regexp_extract(value, '^"([^"]*)"', 1))
            .otherwise(F.coalesce(F.nullif(F.regexp_extract(value, r'version\s*=\s*"([^"]*)"', 1), F.lit("")), F.lit("*")))
        )
        dep = F.struct(F.trim(F.substring_index(text, "=", 1)).alias("name"), version.alias("version"), F.regexp_extract(acc["section"], "^[^.]*", 0).alias("scope"))
        return F.struct(
            F.when(text.startswith("["), header).otherwise(acc["section"]).alias("section"),
            F.when(~text.startswith("[") & inside & text.contains("="), F.concat(acc["deps"], F.array(dep))).otherwise(acc["deps"]).alias("deps"),
        )

    found = F.aggregate(lines(F.col("content")), start, step)["deps"]
    return files.where(F.col("path") == "Cargo.toml").select("repo", F.col("path").alias("manifest"), F.explode(found).alias("d")).select("repo", "manifest", "d.*")


@operator("manifests.dependencies")
def dependencies(files: DataFrame) -> DataFrame:
    """``deps(repo, manifest, name, version, scope)`` of every manifest."""
    node = F.from_json("content", NODE_SCHEMA)
    deno = F.from_json("content", DENO_SCHEMA)
    path = F.col("path")
    py_list = F.regexp_extract_all(F.regexp_extract("content", r"(?s)dependencies\s*=\s*\[(.*?)\]", 1), F.lit('"([^"]*)"'), F.lit(1))
    found = (
        F.when(path == "package.json", F.concat(_entries(node["dependencies"], "dependencies"), _entries(node["devDependencies"], "devDependencies")))
        .when(path.isin("deno.json", "deno.jsonc"), _entries(deno["imports"], "imports"))
        .when(path == "requirements.txt", _requirements(F.col("content")))
        .when(path == "pyproject.toml", F.transform(py_list, lambda s: F.struct(requirement(s)["name"].alias("name"), requirement(s)["version"].alias("version"), F.lit("dependencies").alias("scope"))))
    )
    listed = (
        manifest_files(files).where(path != "Cargo.toml")
        .select("repo", path.alias("manifest"), F.explode(found).alias("d")).select("repo", "manifest", "d.*")
    )
    return listed.unionByName(cargo_dependencies(files))


@operator("manifests.metadata")
def metadata(files: DataFrame) -> DataFrame:
    """Name, version, description, licence, repository and authors per manifest."""
    node, deno, path, content = F.from_json("content", NODE_SCHEMA), F.from_json("content", DENO_SCHEMA), F.col("path"), F.col("content")
    none = F.lit(None).cast("string")

    def by_kind(node_v, deno_v, cargo_v, py_v, req_v=none):
        return (
            F.when(path == "package.json", node_v).when(path.isin("deno.json", "deno.jsonc"), deno_v)
            .when(path == "Cargo.toml", cargo_v).when(path == "pyproject.toml", py_v).otherwise(req_v)
        )

    def toml(key):
        return toml_value(content, "package", key), toml_value(content, "project", key)

    names, versions, texts, licences = toml("name"), toml("version"), toml("description"), toml("license")
    return manifest_files(files).select(
        "repo", path.alias("manifest"), F.array_position(F.array(*[F.lit(p) for p in PRECEDENCE]), path).cast("int").alias("rank"),
        by_kind(
            F.coalesce(node["name"], F.lit("unknown")), F.coalesce(deno["name"], F.lit("deno-project")),
            F.coalesce(names[0], F.lit("rust-project")), F.coalesce(names[1], F.lit("python-project")), F.col("repo"),
        ).alias("name"),
        by_kind(node["version"], deno["version"], *versions).alias("version"),
        by_kind(node["description"], deno["description"], *texts).alias("description"),
        by_kind(node["license"], deno["license"], licences[0], none).alias("license"),
        by_kind(node["repository"]["url"], none, toml_value(content, "package", "repository"), toml_value(content, "project.urls", "repository")).alias("repository"),
        F.when(path == "package.json", F.when(node["author"].isNotNull(), F.array(node["author"])).otherwise(node["authors"])).alias("authors"),
        F.element_at(F.create_map(*[F.lit(x) for kv in MANAGERS.items() for x in kv]), path).alias("package_manager"),
    )


@operator("manifests.preferred")
def preferred(repos: DataFrame, meta: DataFrame) -> DataFrame:
    """One manifest per repository by precedence; the repository's name as fallback."""
    first = meta.groupBy("repo").agg(F.min(F.struct("rank", *[c for c in meta.columns if c not in ("repo", "rank")])).alias("m")).select("repo", "m.*")
    return repos.join(first, "repo", "left").select(
        "repo", "manifest", F.coalesce("name", "repo").alias("name"), "version", "description", "license", "repository", "authors",
        F.coalesce("package_manager", F.lit("Unknown")).alias("package_manager"),
    )
