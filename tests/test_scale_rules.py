"""Nothing is cut: sizes, depths, roots, first documents, unusual names."""

import pytest
from pyspark.sql import functions as F

from repograin.functions.containment import containing
from repograin.operators import crossrepo, history
from repograin.sources import corpus


def test_large_and_deep_files_are_scanned(make_files):
    files = make_files([("r", "a/" * 14 + "x.py", "# TODO deep"), ("r", "big.py", "# TODO first\n" + "x = 1\n" * 2_000_000), ("r", "docs/big.md", "# Overview\n" + "word " * 150_000)])
    assert corpus.marker_files(files).count() == 2
    assert corpus.reality_files(files).count() == 2
    assert corpus.documentation_files(files).count() == corpus.claim_files(files).count() == 1
    flags = {r.path: r for r in corpus.size_flags(files).collect()}
    assert not flags["big.py"].marker_ok and not flags["a/" * 14 + "x.py"].marker_ok and not flags["docs/big.md"].document_ok


def test_any_number_of_roots():
    assert len(corpus.source_roots(",".join(f"root{i}" for i in range(30)))) == 30


def test_files_that_are_not_utf8_keep_a_row(spark, tmp_path):
    folder = tmp_path / "r"
    folder.mkdir()
    (folder / "bad.py").write_bytes(b"\xff\xfe# TODO")
    (folder / "good.py").write_bytes("# TODO é".encode())
    rows = {r.path: r for r in corpus.scan_tree(spark, str(tmp_path), undecodable=True).collect()}
    assert rows["bad.py"].content is None and rows["bad.py"].utf8 is False and rows["bad.py"].length == 8
    assert rows["good.py"].content == "# TODO é" and rows["good.py"].utf8 is True


def test_size_tests_reach_the_file_source(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("x")
    plan = corpus.scan_tree(spark, str(tmp_path)).where(F.col("length") < 100)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(length,100)" in plan


def test_repositories_without_their_first_document(spark, tmp_path):
    from repograin.plans.base import Context

    rows = [(i, f"text {i}", "en", "s", 6) for i in range(1, 120) if i % 40]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    context = Context(spark, str(tmp_path))
    assert context.repos.count() == 3
    assert context.files.where("path not like '%/%'").select("repo").distinct().count() == 3


NAMES = ["core", "a", "данные", "@acme/core", "acme.core", "x-y", "--", "ab", "größe"]
TEXTS = {
    "1": "the score of @acme/core and данные here", "2": "acme.core -- plain", "3": "xa-yb x-yz größen", "4": "", "5": "データ ab", "6": "-" * 10_000,
}


def test_containing_equals_a_plain_search(spark):
    texts = spark.createDataFrame([(k, i, t) for k in ("r", "s") for i, t in TEXTS.items()], "repo string, id string, text string")
    names = spark.createDataFrame([("r", n) for n in NAMES], "repo string, name string")
    got = {tuple(r) for r in containing(texts, names, "repo").collect()}
    assert got == {("r", i, n) for i, t in TEXTS.items() for n in NAMES if n in t}


def test_scoped_dotted_and_foreign_project_names(spark):
    body = "We use @acme/core, acme.core, plain-core and данные in the service. " + "-" * 10_000 + " not my@acme/corex or plain-core-two."
    sections = spark.createDataFrame([("docs", "README.md", 1, "Description", body), ("docs", "README.md", 2, "Usage", body)], "repo string, path string, ord int, section string, body string")
    idents = spark.createDataFrame([("p1", "@acme/core"), ("p2", "acme.core"), ("p3", "plain-core"), ("p4", "данные"), ("p5", "absent"), ("docs", "plain-core"), ("p6", "cor")], "repo string, identifier string")
    got = {r.target: r for r in crossrepo.mentions(sections, idents).collect()}
    assert set(got) == {"p1", "p2", "p3", "p4"}
    assert got["p3"].related and not got["p4"].related and got["p4"].component


@pytest.fixture
def commit_tables(spark):
    from datetime import datetime

    day = datetime(2024, 1, 1)
    commits = spark.createDataFrame(
        [(r, i, f"{r}{i}", "a@x" if i else "b@x", f"N{i}", day, "m") for r in ("one", "two") for i in range(3)], "repo string, seq bigint, hash string, author_email string, author_name string, ts timestamp, message string")
    files = spark.createDataFrame([(r, f"{r}{i}", "same.py") for r in ("one", "two") for i in range(3)], "repo string, hash string, path string")
    return commits, files


def test_history_keeps_repositories_apart(commit_tables):
    commits, files = commit_tables
    assert sorted(tuple(r) for r in history.churn(commits, files).collect()) == [("one", "same.py", 2), ("two", "same.py", 2)]
    assert sorted((r.repo, r.seq, r.files_changed) for r in history.recent_commits(commits, files, 2).collect()) == [("one", 1, 1), ("one", 2, 1), ("two", 1, 1), ("two", 2, 1)]
    assert history.contributors(commits).count() == 4


def test_saved_frames_lie_in_the_shared_folder(spark):
    from repograin.session import saved, shared_dir

    df = saved(spark.range(3).withColumn("nothing", F.lit(None)))
    folder = shared_dir(spark).removeprefix("file:").lstrip("/")
    assert df.count() == 3 and all(folder in f for f in df.inputFiles())


def test_export_clusters_keys_and_splits_hot_ones(spark, tmp_path):
    import glob

    from repograin.operators import exports

    df = spark.range(0, 900, 1, 7).select(F.when(F.col("id") < 600, "hot").when(F.col("id") < 890, F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("repo"), "id")
    exports.write(df, f"{tmp_path}/out", rows_per_file=200)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 900 and back.where("repo is null").count() == 10
    assert len(glob.glob(f"{tmp_path}/out/repo=k1/*.parquet")) == 1
    assert len(glob.glob(f"{tmp_path}/out/repo=hot/*.parquet")) >= 3


def test_scorer_gets_whole_chunks_and_reports_errors(spark):
    from repograin.operators import scoring

    df = spark.createDataFrame([("a", i, "bad" if i == 3 else f"p{i}") for i in range(6)], "k string, batch bigint, prompt string").coalesce(1)

    def scorer(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return [f"{t} of {len(texts)}" for t in texts]

    got = {r.batch: r for r in scoring.score(df, "k", scorer).collect()}
    assert got[3].reply is None and got[3].error == "ValueError: refused" and got[0].reply == "p0 of 1"
    assert {r.reply for r in scoring.score(df.where("batch <> 3"), "k", scorer).collect()} == {f"p{i} of 5" for i in (0, 1, 2, 4, 5)}
