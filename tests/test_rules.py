"""Loaded rule tables: one automaton for all patterns, the same results as testing each pattern, no code for a new rule."""

import random
import time

import pytest
from pyspark.sql import functions as F

from repograin.functions import automaton
from repograin.functions.automaton import Automaton, Rule
from repograin.operators import classify, domains
from repograin.sources.configs import load_rules


@pytest.mark.parametrize("plain", [False, True])
def test_finds_what_contains_finds(plain, monkeypatch):
    if plain:
        import sys

        monkeypatch.setitem(sys.modules, "ahocorasick", None)
    rnd = random.Random(2)
    for _ in range(200):
        patterns = ["".join(rnd.choice("abé") for _ in range(rnd.randint(0, 4))) for _ in range(rnd.randint(0, 12))]
        found = Automaton(patterns)
        assert (found.native is None) >= plain
        for _ in range(10):
            text = "".join(rnd.choice("abéc") for _ in range(rnd.randint(0, 15)))
            assert found.find(text) == {i for i, p in enumerate(patterns) if p in text}


def test_work_does_not_grow_with_the_rules():
    text = "no rule of any kind is held by this sentence " * 2000
    took = []
    for n in (100, 100_000):
        found = Automaton([f"pattern{i}!" for i in range(n)])
        at = time.perf_counter()
        assert not found.find(text)
        took.append(time.perf_counter() - at)
    assert took[1] < 20 * took[0] + 0.05


def test_rules_of_a_file_change_scores(spark, tmp_path, make_files):
    (tmp_path / "rules.json").write_text(
        '{"sets":[{"id":"space","name":"Space","indicators":[{"type":"endpoint","patterns":["/Launch","/orbit"],"confidence_weight":70},{"type":"file","patterns":["rocket"],"confidence_weight":30}]}]}')
    items = spark.createDataFrame([("r", "endpoint", "/launch/now"), ("r", "endpoint", "/launch/now"), ("r", "endpoint", "/orbit/launch/orbit"), ("r", "file", "Rocket.py"), ("r", "dependency", "rocket"), ("s", "file", None)], "repo string, kind string, item string")
    rules = automaton.rules_of(load_rules(spark, str(tmp_path / "rules.json"), "sets"))
    assert {tuple(r) for r in domains.config_scores(items, rules).collect()} == {("r", "Space", 240.0)}
    assert domains.config_scores(items).where("domain = 'Space'").count() == 0

    preferred = spark.createDataFrame([("r", "package.json", "rocket-kit")], "repo string, manifest string, name string")
    deps = spark.createDataFrame([("r", "package.json", "orbit", "1", "dependencies")], "repo string, manifest string, name string, version string, scope string")
    files = make_files([("r", "README.md", "# A kit\nto LINT and format rockets\n")])
    texts = classify.type_texts(preferred, deps, files)
    typed = [Rule("spacecraft", ("name", "readme"), ("rocket", "orbit"), 0.4, share=True), Rule("spacecraft", ("dependency",), ("orbit",), 0.2)]
    assert {tuple(r) for r in classify.weighted(preferred, texts, typed).collect()} == {("r", "spacecraft", 0.4)}
    assert {tuple(r) for r in classify.weighted(preferred, texts).collect()} == {("r", "analysis_tool", 0.066667)}


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(automaton, "MAX_BYTES", 3)
    with pytest.raises(ValueError, match="broadcast"):
        automaton.rules_of(spark.sql("SELECT 'a' AS name, 'k' AS kind, 'long' AS pattern, 1.0D AS weight"))
    with pytest.raises(ValueError, match="broadcast"):
        automaton.hits(spark.sql("SELECT 'k' AS scope, 'x' AS text").withColumn("id", F.lit(1)), [Rule("a", ("k",), ("long",), 1)], ["id"])
