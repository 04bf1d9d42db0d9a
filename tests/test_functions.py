"""Shared helpers against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from repograin.functions.containment import containing
from repograin.functions.facets import facet_counts
from repograin.functions.ranking import running_number
from repograin.functions.similarity import similar_sets
from repograin.functions.text import extension, file_stem, lines
from repograin.sources.corpus import glob_regex


def test_lines_have_no_trailing_empty(spark):
    df = spark.createDataFrame([("a\nb\n",), ("a\r\nb",), ("",), ("\n",), ("a\n\n",)], "t string")
    assert [r[0] for r in df.select(lines(F.col("t"))).collect()] == [["a", "b"], ["a", "b"], [], [""], ["a", ""]]


def test_paths(spark):
    df = spark.createDataFrame([("a/b.c.ts",), ("Dockerfile",), (".gitignore",)], "p string")
    assert [tuple(r) for r in df.select(extension(F.col("p")), file_stem(F.col("p"))).collect()] == [("ts", "b.c"), ("", "Dockerfile"), ("", ".gitignore")]


def test_globs():
    import re

    assert re.match(glob_regex("**/*.java"), "a/b/C.java") and re.match(glob_regex("**/*.java"), "C.java")
    assert re.match(glob_regex("node_modules/**"), "node_modules/x/y.js") and not re.match(glob_regex("node_modules/**"), "src/x.js")
    assert re.match(glob_regex("*.py"), "a/b.py") and not re.match(glob_regex("docs/*.md"), "docs/a/b.md")


def test_running_number_with_a_hot_key(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", i) for i in range(7)]
    random.Random(1).shuffle(rows)
    out = running_number(spark.createDataFrame(rows, "k string, o int").repartition(5), ["k"], ["o"], "n").collect()
    assert all(r["n"] == r["o"] + 1 for r in out) and len(out) == 507


def test_similar_sets_match_brute_force(spark):
    rnd = random.Random(3)
    sets = sorted({tuple(sorted(rnd.sample("abcdefghij", rnd.randint(1, 6)))) for _ in range(120)})
    df = spark.createDataFrame([("r", list(s)) for s in sets], "repo string, tokens array<string>")
    for threshold in (0.3, 0.7, 0.8):
        got = {(tuple(r[1]), tuple(r[2])) for r in similar_sets(df, df, ["repo"], threshold).collect()}
        jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
        assert got == {(a, b) for a, b in itertools.product(sets, sets) if jac(a, b) > threshold}


def test_containing_matches_brute_force(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("ab_1.") for _ in range(n))
    texts = [("r", str(i), word(40)) for i in range(40)]
    names = sorted({word(rnd.randint(1, 5)) for _ in range(60)})
    names = [n for n in names if any(ch.isalnum() for ch in n)]
    got = {(r["id"], r["name"]) for r in containing(
        spark.createDataFrame(texts, "repo string, id string, text string"), spark.createDataFrame([("r", n) for n in names], "repo string, name string"), "repo").collect()}
    assert got == {(i, n) for _, i, t in texts for n in names if n in t}


def test_facets(spark):
    df = spark.createDataFrame([("r", "a", "x"), ("r", "b", None)], "repo string, t string, f string")
    got = {tuple(r) for r in facet_counts(df, "repo", {"type": "t", "file": "f"}, total=True).collect()}
    assert got == {("r", "total", "all", 2), ("r", "type", "a", 1), ("r", "type", "b", 1), ("r", "file", "x", 1)}
