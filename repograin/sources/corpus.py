"""Corpus scans: the ``files`` table and the filters every operator starts from."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repograin.functions.text import extension, lookup
from repograin.rules import languages as L


def glob_regex(glob: str) -> str:
    """Anchored regex of a glob; a glob without a slash fits any directory."""
    out = "" if "/" in glob else "(.*/)?"
    i = 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def globs_regex(globs: Sequence[str]) -> str:
    return "|".join(glob_regex(g) for g in globs)


def with_file_columns(df: DataFrame) -> DataFrame:
    """Complete (repo, path, content, modified) to the canonical ``files`` columns; ``length`` is kept where the source has it."""
    ext = extension(F.col("path"))
    length = F.col("length") if "length" in df.columns else F.octet_length("content")
    more = [c for c in ("utf8",) if c in df.columns]
    return df.select(
        "repo", "path", ext.alias("ext"), lookup(ext, L.LANGUAGE_BY_EXTENSION).alias("lang"),
        length.cast("bigint").alias("length"), F.col("modified").cast("bigint").alias("modified"), "content", *more,
    )


def scan_tree(spark: SparkSession, root: str, globs: str | None = None, undecodable: bool = False) -> DataFrame:
    """Text files below ``root/<repo>/``.

    With ``undecodable`` there is also a row for each file that is not UTF-8,
    without content, and a column ``utf8`` that tells them. ``length`` is
    the file's own, so a test of it reaches the file source and the file is
    never opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if globs:
        reader = reader.option("pathGlobFilter", globs)
    base = re.escape(root.rstrip("/"))
    inner = F.regexp_extract("path", f"{base}/(.*)$", 1)
    utf8 = F.is_valid_utf8(F.col("content"))
    found = reader.load(root)
    return with_file_columns(
        (found if undecodable else found.where(utf8)).select(
            F.substring_index(inner, "/", 1).alias("repo"),
            F.regexp_replace(inner, "^[^/]*/", "").alias("path"),
            "length",
            F.when(utf8, F.decode("content", "UTF-8")).alias("content"),
            F.unix_timestamp("modificationTime").alias("modified"),
            *([utf8.alias("utf8")] if undecodable else []),
        )
    )


def source_roots(csv: str) -> list[str]:
    """Distinct roots of a comma-separated list."""
    return list(dict.fromkeys(p.strip().rstrip("/") for p in csv.split(",") if p.strip()))


def scan_roots(spark: SparkSession, csv: str) -> DataFrame:
    """Union of several trees with the rank of their root; a missing one fails the read."""
    out = None
    for rank, root in enumerate(source_roots(csv)):
        one = scan_tree(spark, root).withColumn("source_rank", F.lit(rank))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no documentation root given")
    return out


def keep_globs(files: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    out = files.where(F.col("path").rlike(globs_regex(include)))
    return out.where(~F.col("path").rlike(globs_regex(exclude))) if exclude else out


def not_ignored(path: Column) -> Column:
    """No directory of the path is on the ignore list."""
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in L.IGNORED_DIRECTORIES]))


def prune_directories(files: DataFrame) -> DataFrame:
    return files.where(not_ignored(F.col("path")))


def marker_files(files: DataFrame) -> DataFrame:
    """Files scanned for work markers, of any size and depth."""
    return keep_globs(files, L.MARKER_INCLUDE, L.MARKER_EXCLUDE)


def reality_files(files: DataFrame) -> DataFrame:
    return keep_globs(files, L.REALITY_INCLUDE, L.REALITY_EXCLUDE)


def _doc_path(patterns: Sequence[str]) -> str:
    # Patterns without a slash name files in the root only.
    return "|".join(f"^{re.escape(p)}$" if "/" not in p else glob_regex(p) for p in patterns)


def documentation_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(_doc_path(L.DOC_PATTERNS)))


def claim_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(_doc_path(L.CLAIM_PATTERNS)))


def size_flags(files: DataFrame) -> DataFrame:
    """Which files are larger or deeper than the usual bounds; only a report, nothing is dropped."""
    size = F.col("length")
    return files.select(
        "repo", "path", "length",
        ((F.floor(size / 1048576) <= L.MARKER_MAX_MB) & (F.size(F.split("path", "/")) - 1 <= L.MARKER_MAX_DEPTH)).alias("marker_ok"),
        (size <= L.REALITY_MAX_KB * 1024).alias("reality_ok"), (size <= L.DOCUMENT_MAX_KB * 1024).alias("document_ok"),
    )
