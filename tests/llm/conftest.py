"""Helpers of these tests: brute-force versions read plain Python rows."""

import pytest


@pytest.fixture
def docs(spark):
    """``documents`` rows from (doc_id, text[, lang[, source]])."""

    def build(rows, extra=()):
        full = [(*r, *(None, None)[: 4 - len(r)]) for r in rows]
        return spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in full], "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return build
