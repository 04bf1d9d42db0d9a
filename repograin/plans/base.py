"""Query catalogue: name -> Spark query and the SQL an outside engine can check."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[["Context"], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def cte(name: str, sql: str) -> None:
    if name in CTES:
        raise ValueError(f"cte {name!r} is defined twice")
    CTES[name] = sql


def compose(sql: str) -> str:
    """Prefix the statement with the named sub-queries it uses."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if name in CTES and name not in seen:
                seen.add(name)
                visit(CTES[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql
    parts = [f"{n} AS {'' if 'FROM ' + n in CTES[n] else 'MATERIALIZED '}({CTES[n]})" for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql


def frame(name: str):
    """Add a derived frame to :class:`Context`, built once per run."""

    def wrap(fn):
        prop = cached_property(fn)
        prop.__set_name__(Context, name)
        setattr(Context, name, prop)
        return fn

    return wrap


class Context:
    """The input tables of one run and the frames derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        from repograin.sources.code_corpus import files

        return files(self.spark, self.sf_dir)

    @cached_property
    def repos(self) -> DataFrame:
        """One row per repository that has a file; only the keys are read."""
        return self.files.select("repo").distinct()

    @cached_property
    def todos(self) -> DataFrame:
        from repograin.operators import markers
        from repograin.sources.corpus import marker_files

        return markers.scan(marker_files(self.files))


# --- helpers that write the checking SQL -----------------------------------

_ACCENTS = "àâäáãçéèêëíìîïñóòôöõúùûüßÀÂÄÁÃÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜ"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(expr: str) -> str:
    """Accented letters as a plain letter, so that ASCII word boundaries see words."""
    return f"translate({expr}, '{_ACCENTS}', '{'q' * len(_ACCENTS)}')"


def values(rows, cols: str, name: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return q(v)

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS {name}({cols})"


def has_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def case_any(expr: str, cases, default: str | None) -> str:
    body = " ".join(f"WHEN {has_any(expr, ws)} THEN {q(label)}" for label, ws in cases)
    return f"CASE {body} ELSE {'NULL' if default is None else q(default)} END"


def case_map(expr: str, table: dict, default: str = "NULL") -> str:
    def lit(v):
        return q(v) if isinstance(v, str) else repr(v)

    return f"CASE {expr} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def rnd(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 5e-1) / 1e6"


def words_sql(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '\\s+'), lambda w: w <> '')"


def hit_list(tests) -> str:
    """SQL list of the positions of the true tests (constant patterns only)."""
    items = ", ".join(f"CASE WHEN {t} THEN {i} END" for i, t in enumerate(tests))
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def regex_hits(expr: str, patterns) -> str:
    return hit_list([f"regexp_matches({expr}, {q(p)})" for p in patterns])


def by_position(expr: str, items) -> str:
    """CASE over a rule position, for expressions that need a constant pattern."""
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(items)) + " END"
