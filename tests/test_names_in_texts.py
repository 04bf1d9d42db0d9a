"""Names meet texts without shuffling every token; a segment's text is lowered once for each table of words."""

import pytest

from repograin.functions import containment
from repograin.operators import segments


@pytest.mark.parametrize("bound", [300_000, 0])
def test_containing_is_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch, bound):
    monkeypatch.setattr(containment, "BROADCAST_ROWS", bound)
    texts = [("r", "1", "the userlogin form"), ("r", "2", "cart-item of a"), ("r", "3", ""), ("s", "1", "userlogin")]
    names = [("r", "login"), ("r", "cart-item"), ("r", "a"), ("r", "--"), ("s", "item")]
    got = containment.containing(spark.createDataFrame(texts, "repo string, id string, text string"), spark.createDataFrame(names, "repo string, name string"), "repo")
    want = sorted((k, i, n) for k, i, t in texts for k2, n in names if k == k2 and n in t)
    assert sorted(map(tuple, got.collect())) == want


def test_a_segments_text_is_lowered_once_per_table(spark, make_files):
    files = make_files([("r", "src/a.py", "class User(db.Model):\n    def login(self):\n        return 1\n")])
    assert segments.extract(files)._jdf.queryExecution().optimizedPlan().toString().count("lower(content") <= 2


@pytest.mark.parametrize("few", [256, 3, 0])
def test_keys_with_few_and_with_many_names_give_the_same(spark, few):
    texts = [(r, str(i), t) for r in "rs" for i, t in enumerate(["the userlogin form", "cart-item of a", "", "-- login --"])]
    names = [("r", n) for n in ("login", "cart-item", "a", "--", "item", "")] + [("s", "item"), ("s", "--")]
    got = containment.containing(spark.createDataFrame(texts, "repo string, id string, text string"), spark.createDataFrame([n for n in names if n[1]], "repo string, name string"), "repo", few)
    assert sorted(map(tuple, got.collect())) == sorted((k, i, n) for k, i, t in texts for k2, n in names if n and k == k2 and n in t)


def test_texts_of_few_names_are_not_cut_into_tokens(spark):
    frames = spark.createDataFrame([("r", "1", "a login")], "repo string, id string, text string"), spark.createDataFrame([("r", "login")], "repo string, name string")
    assert "split(text" not in containment.containing(*frames, "repo")._jdf.queryExecution().optimizedPlan().toString()
