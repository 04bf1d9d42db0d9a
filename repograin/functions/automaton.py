"""Rules that are data: all patterns of a loaded rule table meet a text in one pass of an automaton.

The time for a text depends on its length and its hits, not on the number of
rules. Rule tables are read to the driver and broadcast, so their size is
checked; texts stay distributed and only hit numbers leave the Arrow batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

MAX_BYTES = 32 << 20  # of all patterns together, as every executor holds them
_HITS = ArrayType(StructType().add("rule", IntegerType()).add("pattern", IntegerType()))


@dataclass(frozen=True)
class Rule:
    """``weight`` for ``subject`` if a text of one of ``scopes`` holds a pattern; with ``share``, that part of the weight whose patterns are held."""

    subject: str
    scopes: tuple[str, ...]
    patterns: tuple[str, ...]
    weight: float
    share: bool = False


class Automaton:
    """Which patterns a text holds (Aho-Corasick); in plain Python where the library is missing."""

    def __init__(self, patterns: Sequence[str]):
        self.always = [i for i, p in enumerate(patterns) if p == ""]
        places: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            if p:
                places.setdefault(p, []).append(i)
        try:
            import ahocorasick
        except ImportError:
            ahocorasick = None
        self.native = None
        if ahocorasick and places:
            self.native = ahocorasick.Automaton()
            for p, numbers in places.items():
                self.native.add_word(p, numbers)
            self.native.make_automaton()
        elif places:
            self._build(places)
        self.any = bool(places)

    def _build(self, places: dict[str, list[int]]) -> None:
        self.steps: list[dict[str, int]] = [{}]
        self.out: list[list[int]] = [[]]
        for p, numbers in places.items():
            state = 0
            for ch in p:
                if ch not in self.steps[state]:
                    self.steps[state][ch] = len(self.steps)
                    self.steps.append({})
                    self.out.append([])
                state = self.steps[state][ch]
            self.out[state] = list(numbers)
        self.back = [0] * len(self.steps)
        queue = deque(self.steps[0].values())
        while queue:
            state = queue.popleft()
            for ch, after in self.steps[state].items():
                queue.append(after)
                at = self.back[state]
                while at and ch not in self.steps[at]:
                    at = self.back[at]
                self.back[after] = self.steps[at].get(ch, 0)
                self.out[after] = self.out[after] + self.out[self.back[after]]

    def find(self, text: str) -> set[int]:
        found = set(self.always)
        if not self.any:
            return found
        if self.native is not None:
            for _, numbers in self.native.iter(text):
                found.update(numbers)
            return found
        state = 0
        for ch in text:
            while state and ch not in self.steps[state]:
                state = self.back[state]
            state = self.steps[state].get(ch, 0)
            found.update(self.out[state])
        return found


_BUILT: dict[tuple, Automaton] = {}


def _built(patterns: tuple[str, ...]) -> Automaton:
    """One automaton per rule table and worker."""
    if patterns not in _BUILT:
        if len(_BUILT) >= 4:
            _BUILT.clear()
        _BUILT[patterns] = Automaton(patterns)
    return _BUILT[patterns]


def rules_of(table: DataFrame, weight: float = 1.0, share: bool = False) -> list[Rule]:
    """Rules from loaded rows ``name, kind, pattern, weight``: one per name, kind and weight, patterns in lower case."""
    size = table.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()[0]
    if size > MAX_BYTES:
        raise ValueError(f"patterns of {size} bytes are more than the {MAX_BYTES} that may be broadcast")
    found: dict[tuple, list[str]] = {}
    for name, kind, pattern, w in table.select("name", "kind", F.lower("pattern"), F.coalesce("weight", F.lit(weight))).distinct().sort("name", "kind", "lower(pattern)").collect():
        found.setdefault((name, kind, w), []).append(pattern)
    return [Rule(n, (k,), tuple(ps), w, share) for (n, k, w), ps in found.items()]


def hits(texts: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """``keep, rule, pattern``: the rules of a row's ``scope`` and their patterns that its ``text`` holds; nulls hold nothing."""
    size = sum(len(p.encode()) for r in rules for p in r.patterns)
    if size > MAX_BYTES:
        raise ValueError(f"patterns of {size} bytes are more than the {MAX_BYTES} that may be broadcast")
    held = texts.sparkSession.sparkContext.broadcast((
        tuple(p for r in rules for p in r.patterns), [(n, i, frozenset(r.scopes)) for n, r in enumerate(rules) for i in range(len(r.patterns))]))

    @F.pandas_udf(_HITS)
    def found(scope: pd.Series, text: pd.Series) -> pd.Series:
        patterns, places = held.value
        automaton = _built(patterns)
        return pd.Series([
            [] if t is None else [{"rule": places[i][0], "pattern": places[i][1]} for i in sorted(automaton.find(t)) if s in places[i][2]] for s, t in zip(scope, text)])

    return texts.select(*keep, F.explode(found("scope", "text")).alias("_h")).select(*keep, "_h.rule", "_h.pattern")


def scores(found: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """``keys, subject, score``: each rule once per key, by its distinct patterns, summed by subject; the small rule list is a literal table."""
    per = found.select(*keys, "rule", "pattern").distinct().groupBy(*keys, "rule").agg(F.count("*").alias("n"))
    rows = [(n, r.subject, float(r.weight), len(r.patterns) if r.share else 0) for n, r in enumerate(rules)]
    table = found.sparkSession.createDataFrame(rows, "rule int, subject string, weight double, of int")
    value = F.when(F.col("of") > 0, F.col("n") * F.col("weight") / F.col("of")).otherwise(F.col("weight"))
    return per.join(table, "rule").groupBy(*keys, "subject").agg(F.sum(value).alias("score"))
