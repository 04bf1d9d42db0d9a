"""Where matches lie in a text, and which words stand near them.

Lengths are taken in the JVM and added up by Arrow batches: only numbers leave
it, no text is copied, and the time is linear in the text and its matches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

_INTS = ArrayType(IntegerType())
_NEAR = StructType().add("starts", ArrayType(_INTS)).add("words", ArrayType(StructType().add("place", IntegerType()).add("start", IntegerType())))


def match_lengths(text: Column, pattern: str) -> Column:
    """``struct<between,sizes>`` for a pattern that matches no empty text; ``between`` has one more."""
    return F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("between"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("sizes"),
    )


def _starts(between, sizes) -> np.ndarray:
    """First characters of the matches, counted from 1."""
    sizes = np.asarray(sizes, np.int64)
    return np.cumsum(np.asarray(between, np.int64)[: len(sizes)]) + np.cumsum(sizes) - sizes + 1


def _near(reach: int):
    @F.pandas_udf(_NEAR)
    def near(word_between: pd.Series, word_sizes: pd.Series, between: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        """Starts of the matches of each pattern; and the words that lie partly within ``reach`` of any match."""
        found, words = [], []
        for wb, ws, bs, ss in zip(word_between, word_sizes, between, sizes):
            starts = [_starts(b, s) for b, s in zip(bs, ss)]
            low = np.sort(np.concatenate(starts)) - reach
            high = np.maximum.accumulate((np.concatenate([a + s for a, s in zip(starts, ss)]) + reach)[np.argsort(np.concatenate(starts), kind="stable")])
            first = _starts(wb, ws)
            before = np.searchsorted(low, first + np.asarray(ws, np.int64) - 1, "right") - 1  # the last window that opens before a word ends
            kept = np.flatnonzero((before >= 0) & (high[np.maximum(before, 0)] > first))
            found.append([a.tolist() for a in starts])
            words.append([{"place": int(i), "start": int(first[i])} for i in kept])
        return pd.DataFrame({"starts": found, "words": words})

    return near


def surroundings(df: DataFrame, text: Column, hits: Column, reach: int) -> DataFrame:
    """``repo, path, hits, starts, words`` of the rows that have hits: ``hits`` is an array of structs whose ``lengths`` come from
    :func:`match_lengths`, ``starts`` has the places of each one's matches, ``words`` (word, start) are those near any match."""
    word = r"(?U)\w+"
    found = df.select("repo", "path", text.alias("text"), F.explode(F.array(hits)).alias("hits")).where(F.size("hits") > 0)
    measured = found.select("repo", "path", "hits", F.explode(F.array(F.struct(F.regexp_extract_all("text", F.lit(word), F.lit(0)).alias("all"), match_lengths(F.col("text"), word).alias("l")))).alias("w"))
    part = lambda name: F.transform("hits", lambda h: h["lengths"][name])
    near = measured.select("repo", "path", "hits", "w.all", _near(reach)("w.l.between", "w.l.sizes", part("between"), part("sizes")).alias("near"))
    words = F.transform("near.words", lambda n: F.struct(F.get(F.col("all"), n["place"]).alias("word"), n["start"].alias("start")))
    return near.select("repo", "path", "hits", "near.starts", words.alias("words"))
