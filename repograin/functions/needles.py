"""Cheap tests that every match of a pattern must pass.

A case-insensitive pattern is slow on long texts; looking for a plain word in
the lower-cased text is fast. From a rule pattern this derives words of which
every match holds at least one, so a text without them needs no regex.
"""

from __future__ import annotations

import re
from re import _parser as sre

from pyspark.sql import Column
from pyspark.sql import functions as F

from repograin.functions.text import bare, contains_any, rx


def _better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    if a is None or b is None:
        return a if b is None else b
    return a if min(map(len, a)) >= min(map(len, b)) else b


def _required(tree) -> list[str] | None:
    """Words one of which occurs in any match of the sequence; None if unknown."""
    best, run = None, ""
    for op, arg in tree:
        if op == sre.LITERAL:
            run += chr(arg).lower()
            continue
        best, run = _better(best, [run] if run else None), ""
        if op == sre.SUBPATTERN:
            best = _better(best, _required(arg[-1]))
        elif op == sre.BRANCH:
            parts = [_required(branch) for branch in arg[1]]
            if all(parts):
                best = _better(best, [w for part in parts for w in part])
        elif op == sre.MAX_REPEAT or op == sre.MIN_REPEAT:
            if arg[0] >= 1:
                best = _better(best, _required(arg[2]))
    return _better(best, [run] if run else None)


def needles(pattern: str) -> list[str]:
    """Lower-case words for the quick test; empty if the pattern promises none."""
    found = _required(sre.parse(bare(pattern), re.IGNORECASE)) or []
    return sorted(set(found)) if found and min(map(len, found)) >= 2 else []


def folded(text: Column) -> Column:
    """Lower case; the long s and the other i's, which ignoring case takes for an s and an i, become these."""
    return F.lower(F.translate(text, "ſıİ", "sii"))


def quick_match(text: Column, low: Column, pattern: str) -> Column:
    """``text`` matches the pattern; ``low`` is its folded form."""
    words = needles(pattern)
    test = text.rlike(rx(pattern))
    return contains_any(low, words) & test if words else test


def _trie(words: list[str]) -> str:
    """Pattern of the longest word that begins here."""
    branches = []
    for first in sorted({w[0] for w in words if w}):
        branches.append(re.escape(first) + _trie([w[1:] for w in words if w and w[0] == first]))
    rest = "(?:" + "|".join(branches) + ")" if branches else ""
    return rest + "?" if rest and "" in words else rest


def may_match(low: Column, patterns: list[str]) -> Column:
    """Numbers of the patterns that a folded text may match, by one search for the words of all of them.

    At each place the longest word is taken; it stands for all words that it holds.
    """
    of = [needles(p) for p in patterns]
    known = sorted({w for ws in of for w in ws})
    rules = {w: [n for n, ws in enumerate(of) if any(x in w for x in ws)] for w in known}
    table = F.create_map(*[x for w, ns in rules.items() for x in (F.lit(w), F.array(*[F.lit(n) for n in ns]))])
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=({_trie(known)}))"), F.lit(1)))
    always = F.array(*[F.lit(n) for n, ws in enumerate(of) if not ws]).cast("array<int>")
    return F.array_distinct(F.concat(always, F.flatten(F.transform(found, lambda w: F.element_at(table, w)))))
