"""Column helpers for text: lines, keyword tests, ordered labels, rule hits.

Rules are literal columns inside one projection, so a whole rule pack is a
single pass over the text: no join, no row per (file, rule) pair, patterns
compiled once per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(content: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    body = F.regexp_replace(content, r"\r?\n\z", "")
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def bare(pattern: str) -> str:
    """A rule pattern without its leading case flag."""
    return pattern.removeprefix("(?i)")


def rx(pattern: str) -> str:
    """Make word boundaries and classes follow Unicode letters."""
    return ("(?iU)" if pattern.startswith("(?i)") else "(?U)") + bare(pattern)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    test = text.contains(words[0])
    for word in words[1:]:
        test = test | text.contains(word)
    return test


def contains_all(text: Column, words: Sequence[str]) -> Column:
    test = text.contains(words[0])
    for word in words[1:]:
        test = test & text.contains(word)
    return test


def first_label(text: Column, cases: Sequence[tuple], default: Column | str | None) -> Column:
    """Label of the first case one of whose words occurs in the text."""
    out = None
    for label, words in cases:
        test = contains_any(text, words)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def lookup(key: Column, table: dict, default=None) -> Column:
    """CASE over a small fixed table."""
    out = None
    for k, v in table.items():
        test = key == F.lit(k)
        out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def words(text: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """Trim, collapse white space, lower: the key of equal texts."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def hit_structs(tests: Sequence[tuple[Column, dict]]) -> Column:
    """Array of the attribute structs whose test is true, in rule order."""
    return F.array_compact(
        F.array(*[F.when(test, F.struct(*[F.lit(v).alias(k) for k, v in attrs.items()])) for test, attrs in tests])
    )


def line_hits(content: Column, any_pattern: str) -> Column:
    """``array<struct<line_no,line>>`` of the lines matching a pattern."""
    numbered = F.transform(lines(content), lambda l, i: F.struct((i + 1).alias("line_no"), l.alias("line")))
    return F.filter(numbered, lambda x: x["line"].rlike(any_pattern))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; empty if there is none."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def count_of(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of a literal token."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))
    return (gone / F.lit(len(token))).cast("bigint")


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and use it many times inside ``fn``."""
    return F.transform(F.array(value), fn)[0]


def neighbours(all_lines: Column, line_no: Column, before: int, after: int, own: bool) -> Column:
    """Lines around a 1-based line number, with or without the line itself."""
    start = F.greatest(line_no - before, F.lit(1))
    if own:
        return F.slice(all_lines, start, line_no + after - start + 1)
    return F.concat(F.slice(all_lines, start, line_no - start), F.slice(all_lines, line_no + 1, F.lit(after)))


def hit_lines_with_context(content: Column, any_pattern: str, before: int, after: int, own: bool) -> Column:
    """``array<struct<line_no,line,context>>`` of matching lines.

    The file's lines never leave its row: no shuffle, and only matching lines
    are copied out.
    """

    def build(ls: Column) -> Column:
        numbered = F.transform(ls, lambda l, i: F.struct((i + 1).alias("line_no"), l.alias("line")))
        hits = F.filter(numbered, lambda x: x["line"].rlike(any_pattern))
        return F.transform(
            hits,
            lambda h: F.struct(
                h["line_no"].alias("line_no"),
                h["line"].alias("line"),
                neighbours(ls, h["line_no"], before, after, own).alias("context"),
            ),
        )

    return let(lines(content), build)
