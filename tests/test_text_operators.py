"""Markers, documents, claims and evidence on tiny inputs."""

import random

from pyspark.sql import functions as F

from repograin.operators import claims, documents, markers, reality
from repograin.sources.corpus import claim_files, documentation_files, marker_files, reality_files


def test_marker_priority_topic_and_effort(spark, make_files):
    text = "x = 1\n# TODO: urgent security fix @ann 2024-02-03 #auth\ny\n// NOTE add ui\n/* BUG slow query */\nplain\n"
    rows = {r["line_no"]: r for r in markers.scan(marker_files(make_files([("r", "a.py", text)]))).collect()}
    assert set(rows) == {2, 4, 5}
    first = rows[2]
    assert (first["marker"], first["priority"], first["author"], str(first["date_added"]), first["tags"]) == ("TODO", "Critical", "ann", "2024-02-03", ["auth"])
    assert first["context_lines"] == ["x = 1", "y"] and first["column_no"] == 2
    assert (rows[4]["priority"], rows[5]["marker"], rows[5]["description"], rows[5]["priority"]) == ("Low", "BUG", "slow query", "High")
    topics = {r["line_no"]: (r["category"], r["estimated_effort"]) for r in markers.by_topic(markers.scan(marker_files(make_files([("r", "a.py", text)])))).collect()}
    assert topics[2] == ("Authentication", "Small") and topics[4] == ("Frontend", "Small") and topics[5] == ("Database", "Medium")


def test_excluded_paths_and_repos_without_markers(spark, make_files):
    files = make_files([("r", "node_modules/a.js", "// TODO x\n"), ("r", "b.js", "ok\n"), ("r", "c.min.js", "// TODO y\n")])
    todos = markers.scan(marker_files(files))
    assert todos.count() == 0
    repos = spark.createDataFrame([("r",)], "repo string")
    assert markers.completion(repos, todos).collect()[0]["completion_score"] == 1.0


README = """# Shop
intro
## About
A shop with React and a REST API v1.2.
### Detail
more
## Installation
$ npm install
`pip install x`
## Usage
Run it.
"""


def test_sections_commands_and_coverage(spark, make_files):
    docs = documentation_files(make_files([("r", "README.md", README), ("r", "src/README.md", README)]))
    secs = {(r["section"], r["body"]) for r in documents.sections(docs).collect()}
    assert ("Description", "A shop with React and a REST API v1.2.\n### Detail") in secs and ("Usage", "Run it.") in secs
    assert {r["command"] for r in documents.setup_commands(docs).collect()} == {"npm install", "pip install x"}
    cover = documents.coverage(spark.createDataFrame([("r",)], "repo string"), documents.sections(docs), documents.setup_commands(docs)).collect()[0]
    assert cover["completeness"] == 3 / 8 and cover["suggestions"] == []


def test_versions_and_unicode_windows(spark):
    df = spark.createDataFrame([("uses v1.2.3",), ("pkg@4.5",), ("version: 7",), ("none",)], "c string")
    assert [r[0] for r in df.select(documents.version_in(F.col("c"))).collect()] == ["1.2.3", "4.5", None, None]
    text = "é" * 150 + " react " + "ü" * 150
    got = spark.createDataFrame([(text,)], "c string").select(documents.match_context(F.col("c"), r"(?i)\breact\b")).collect()[0][0]
    assert got == "é" * 99 + " react " + "ü" * 99


def test_claims_keep_the_best_of_equal_ones(spark, make_files):
    text = "Supports OAuth login\nplain\nOAuth again\nEncrypted data, can export.\n"
    found = claims.final(claim_files(make_files([("r", "README.md", text)]))).collect()
    kinds = {(r["claim_type"], r["description"]): (r["points"], r["priority"]) for r in found}
    assert ("Security", "Encrypted") in kinds and kinds[("Security", "Encrypted")] == (60, "Critical")
    assert all(r["points"] >= 60 for r in found)
    raw = claims.extract(claim_files(make_files([("r", "README.md", text)])))
    kept = claims.dedup(raw).where("description = 'OAuth'").collect()
    assert [r["line_no"] for r in kept] == [1]


def test_evidence_scores(spark, make_files):
    text = "import pytest\ndef test_login():\n    assert True\n"
    rows = {r["reality_type"]: r for r in reality.evidence(reality_files(make_files([("r", "tests/test_a.py", text)]))).collect()}
    t = rows["TestingImplemented"]
    assert t["patterns"] == ["Pattern_2", "Pattern_3", "Pattern_1"] and t["line_numbers"] == [1, 2, 3]
    assert (t["points"], t["level"]) == (90, "Complete")
    assert t["description"] == "Testing implementation with import pytest, def test_login():, assert True"


def greedy(rows):
    """Description -> leader; sets of words in the order of the MD5 of their least identity."""
    import hashlib

    first = {}
    for i, d in rows:
        first.setdefault(frozenset(d.split()), i)
    order, leader = [], {}
    for words, i in sorted(first.items(), key=lambda x: hashlib.md5(x[1].encode()).hexdigest()):
        mine = next((k for k, e in order if len(words & e) / len(words | e) > 0.7), None)
        if mine is None:
            order.append((i, words))
            mine = i
        leader[words] = mine
    return {d: leader[frozenset(d.split())] for _, d in rows}


def test_merge_is_greedy_in_hash_order(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(9)]
    rows = [(f"id{i:03}", " ".join(rnd.sample(vocab, 6))) for i in range(60)]
    df = spark.createDataFrame([("r", "T", i, d) for i, d in rows], "repo string, reality_type string, impl_id string, description string")
    assert {r["description"]: r["leader"] for r in reality.leaders(df).collect()} == greedy(rows)


def test_a_chain_of_alike_descriptions_ends(spark):
    rows = [(f"id{i:04}", " ".join(f"w{j}" for j in range(i, i + 12))) for i in range(300)]
    df = spark.createDataFrame([("r", "T", i, d) for i, d in rows], "repo string, reality_type string, impl_id string, description string")
    assert {r["description"]: r["leader"] for r in reality.leaders(df).collect()} == greedy(rows)
