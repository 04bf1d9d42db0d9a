"""Counts of all filter orders against a document-by-document version."""

import itertools
import re
from collections import Counter

import pytest

from repograin.llm import filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    out = []
    for key, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        copy = key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows)
        hits = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), copy)
        out.append({f for f, hit in zip("ABCDE", hits) if hit})
    return out


def plain(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    failing, out = fails(rows), []
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failing) if (r[2] or "") == part]
        shapley, found = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, name in enumerate(order, 1):
                gone = [(k, f) for k, f in left if name in f]
                left = [(k, f) for k, f in left if name not in f]
                redundant = sum(name in f and bool(f & set(order[: step - 1])) for _, f in own)
                found.append([part, order, step, len(left), len(gone), redundant, sum(f == {name} for _, f in own), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)])
                shapley[name] += len(gone)
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


@pytest.fixture
def result(spark):
    def run(rows, labels):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS row", "'x' AS key", "2 AS part", "3 AS words", "'y' AS sha", "5 AS A", "6 AS good")
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS row", "2 AS key", "'z' AS lang")
        df = filter_audit.audit(docs, marks)
        assert df.columns == COLUMNS
        return sorted(map(tuple, df.collect()))

    return run


def words(n, distinct=None, extra=""):
    return " ".join(f"w{i % (distinct or n)}" for i in range(n)) + extra


def test_equals_plain_version(result):
    texts = [words(200), words(199), words(300, 149), words(300, 150), words(210, None, " #"), words(100, 3, " $ %"), "ABC", "", None, words(250, None, " " + "A" * 60),
             words(250, 90, " |" + "Z" * 90), "long " * 60_000, "é" * 97 + "ABC", "é" * 96 + "ABCD", "a&b", "   \t\n"]
    rows = [(i, t, ["de", None, "", "xx"][i % 4]) for i, t in enumerate(texts * 3)]
    rows += [(100, words(200), "de"), (100, words(200), "de"), (100, words(200), "new"), (None, words(200), "de"), (None, words(200), None), (None, "unseen " * 300, "only")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(100, 1, 0), (100, 1, 1), (100, None, None), (None, 1, 1), (3, None, 1)]
    labels = [(k, q, None if t is None else int(t)) for k, q, t in labels]
    assert result(rows, labels) == plain(rows, labels)


def test_a_part_without_a_failure_has_all_its_rows_of_zeros(result):
    rows = [(i, words(200, None, f" u{i}"), "clean") for i in range(3)]
    got = result(rows, [])
    assert len(got) == 600 and {r[3:] for r in got} == {(3, 0, 0, 0, 0, 0, 0)}


def test_empty_tables(result):
    assert result([], []) == []
    assert result([], [(1, 1, 1)]) == []


def test_relations_meet_by_joins_on_ids(spark):
    """No text is left in the tables that the joins read, and no join is a loop."""
    rows = filter_audit.measured(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert "text" not in rows.columns
    plan = filter_audit.later_copies(rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
