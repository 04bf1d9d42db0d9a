"""The pipeline's stages, one after the other, against plain Python."""

import re

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from repograin.llm import byte_bpe, exact_dedup
from tests_llm_helpers import mixed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture():
    rng = np.random.default_rng(2)
    words = {"en": "the and of to in that is was for with on as by", "de": "der und die zu den mit von nicht ein sich auf"}
    rows, gone = [], set()
    for i in range(90):
        lang = "en" if i % 3 else "de"
        text = " ".join(f"{rng.choice(words[lang].split())}{rng.choice(words[lang].split())}" for _ in range(rng.integers(40, 120)))
        rows.append((10 * i, text, lang, f"s{i % 4 if i % 7 else 9}"))
        if i % 5 == 0:
            rows.append((10 * i + 1, text.replace(" ", "  ", 3), lang, "copies"))
            gone.add(10 * i + 1)
        if i % 6 == 0:
            edited = text.split()
            edited[10] = "changed"
            rows.append((10 * i + 2, " ".join(edited), lang, None))
            gone.add(10 * i + 2)
    rows += [(5001, None, "en", "s1"), (5002, "123 %%", "en", "s2"), (5003, "", None, None)]
    return rows, gone | {5001, 5002, 5003}


def test_stages_against_plain_python(spark, docs, tmp_path):
    rows, gone = fixture()
    folder = str(tmp_path)
    docs(rows).write.parquet(f"{folder}/documents.parquet")
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    kept = [r for r in rows if r[0] not in gone]
    sizes = {r[0]: len([w for w in re.split("[\x20\x09-\x0d]+", r[1]) if w]) for r in kept}
    copies = mixed([(r[0], r[3], sizes[r[0]]) for r in kept])
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text, _, source in kept:
        ids = library.encode_ordinary(text)
        want += [(doc_id, source, len(ids), ids, True)] * copies[doc_id]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_return_documents(spark, docs):
    rows, _ = fixture()
    df = docs(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == COLUMNS and out.schema.simpleString() == df.schema.simpleString()


def test_empty_table_passes_through(spark, docs):
    df = docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, "").collect() == []


def test_stages_pass_columns_of_any_name(spark, docs):
    rows, _ = fixture()
    df = docs(rows)
    names = ["score", "held_out", "lang_pred", "grams", "rest", "row", "h", "_h", "_w", "_b", "_m", "maybe", "sha", "_sha", "order", "kept", "_gone", "_mark", "key", "mark", "digest",
             "rounds", "_source", "source_size", "target", "copies", "threshold", "closed", "own", "u", "ids", "decoded", "before", "a.b"]
    wide = df.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns and out.schema.simpleString() == wide.schema.simpleString()
        got = out.collect()
        assert got and all(r[n] == f"{n}:{r.doc_id}" for r in got for n in names)
        assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in stage(spark, df, "").collect())
    assert len(corpus_pipeline.encoded(spark, wide, "").collect()) == len(rows)


def test_varied_gibberish_goes_and_short_texts_stay(spark, docs):
    rows, _ = fixture()
    rng = np.random.default_rng(3)
    noise = " ".join("".join(map(chr, rng.integers(0x4E00, 0x9FFF, 6))) for _ in range(80))
    df = docs([*rows, (7001, noise, None, "s1"), (7002, "xq zv", None, "s1"), (7003, "zq " * 500, None, "s1")])
    left = {r.doc_id for r in corpus_pipeline.known_language(spark, df, "").collect()}
    assert left == {r[0] for r in rows if r[0] < 5000} | {7002, 7003}


def test_text_meets_the_filter_by_broadcast_at_any_size(spark, docs, monkeypatch):
    rows, _ = fixture()
    df = docs(rows * 2)
    want = sorted(map(str, exact_dedup.keep_first(df).collect()))
    monkeypatch.setattr(exact_dedup, "FILTER_WORDS", 16)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = exact_dedup.keep_first(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert sorted(map(str, out.collect())) == want
        assert len(exact_dedup.verdicts(df).collect()) == 2 * len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_travel_to_python_in_small_batches(spark, tmp_path):
    from repograin.llm.store import BATCH, small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, wanted in (("10000", BATCH), ("0", BATCH), ("7", 7)):
            spark.conf.set(name, given)
            small_batches(spark)
            assert int(spark.conf.get(name)) == wanted
    finally:
        spark.conf.set(name, before)
