"""Imports resolved to files of the same repository, by the longest path suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions.scores import r6
from repograin.functions.text import let
from repograin.operators.segments import segment_files
from repograin.registry import operator
from repograin.rules import code as K

CODE_SUFFIX = r"\.(py|js|jsx|ts|tsx|java)$"
ROOT_FILES = ["index", "__init__"]  # stand for their folder
NEEDED = 0.5  # of an absolute import's parts must match


def _path_parts(path: Column) -> Column:
    """Parts of a file's path without its extension; a folder's root file is the folder."""
    parts = F.split(F.regexp_replace(path, CODE_SUFFIX, ""), "/")
    rooted = (F.size(parts) > 1) & F.element_at(parts, -1).isin(ROOT_FILES)
    return F.when(rooted, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def _walked(start: Column, steps: Column) -> Column:
    """A folder after steps like ``..`` and names; above the root stays the root."""
    up = lambda at: F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))
    return F.aggregate(steps, start, lambda at, s: F.when(s.isin("", "."), at).when(s == "..", up(at)).otherwise(F.concat(at, F.array(s))))


@operator("imports.specs")
def specs(files: DataFrame) -> DataFrame:
    """(repo, path, spec, relative, parts): each import of each source file once, relative ones from the repository's root."""
    text, lang = F.col("content"), F.col("language")
    all_of = lambda p, g=1: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    python = F.zip_with(all_of(K.PY_IMPORT, 1), all_of(K.PY_IMPORT, 2), lambda a, b: F.when(a != "", a).otherwise(b))
    found = F.array_distinct(F.when(lang == "typescript", all_of(K.TS_IMPORT)).when(lang == "python", python).otherwise(all_of(K.JAVA_IMPORT)))
    each = segment_files(files).select("repo", "path", "language", F.explode(found).alias("spec"))
    script, relative = F.col("language") == "typescript", F.startswith("spec", F.lit("."))
    dots = F.length(F.regexp_extract("spec", r"^\.*", 0))
    dotted = F.filter(F.split(F.regexp_replace("spec", r"^\.+", ""), r"\."), lambda p: p != "")
    slashed = F.split(F.regexp_replace("spec", CODE_SUFFIX, ""), "/")
    package = F.concat(F.transform(F.sequence(F.lit(1), dots), lambda i: F.when(i == 1, ".").otherwise("..")), dotted)
    parts = F.when(relative, let(F.when(script, slashed).otherwise(package), lambda steps: _walked(_folder(F.col("path")), steps))).otherwise(
        F.when(script, F.filter(slashed, lambda p: p != "")).otherwise(dotted))
    return each.select("repo", "path", "spec", relative.alias("relative"), parts.alias("parts")).where(F.size("parts") > 0)


def _last(parts: Column, k: Column) -> Column:
    return F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/")


@operator("imports.resolve")
def resolve(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, path, spec, target, strength): the file an import names, or null.

    Every suffix of a file's path is a key that keeps one file, the one nearest
    to the root (then first by name), so an import meets at most one row per
    part of its own, however many files share a name. The longest suffix wins;
    of an absolute import at least half the parts must match, for packages that
    are not folders. A relative import must match from the root on.
    """
    paths = segment_files(files).select("repo", "path", _path_parts(F.col("path")).alias("parts"))
    near = F.struct(F.size("parts").alias("depth"), F.col("path").alias("path"))
    keys = F.concat(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: _last(F.col("parts"), k)), F.array(F.concat(F.lit("/"), F.array_join("parts", "/"))))
    known = paths.select("repo", near.alias("near"), F.explode(keys).alias("key")).groupBy("repo", "key").agg(F.min("near")["path"].alias("found"))
    whole = F.size("parts")
    own = F.when(F.col("relative"), F.array(F.struct(whole.alias("k"), F.concat(F.lit("/"), F.array_join("parts", "/")).alias("key")))).otherwise(
        F.transform(F.sequence(F.lit(1), whole), lambda k: F.struct(k.alias("k"), _last(F.col("parts"), k).alias("key"))))
    wanted = imports.select("repo", "path", "spec", whole.alias("whole"), F.explode(own).alias("o")).select("repo", "path", "spec", "whole", "o.*")
    met = wanted.where(F.col("k") >= F.col("whole") * NEEDED).join(known, ["repo", "key"], "left")
    best = F.max(F.when(F.col("found").isNotNull(), F.struct("k", "found", "whole")))
    return met.groupBy("repo", "path", "spec").agg(best.alias("b")).select("repo", "path", "spec", F.col("b.found").alias("target"), r6(F.col("b.k") / F.col("b.whole")).alias("strength"))
