"""Ordered reports: written in ranges, read back in order by the manifest."""

import glob
import random

from repograin.operators import reports


def test_a_report_is_read_in_order_from_several_parts(spark, tmp_path):
    rnd = random.Random(6)
    rows = [("hot" if rnd.random() < 0.7 else f"repo{rnd.randint(0, 9)}", rnd.randint(0, 4), f"line {rnd.randint(0, 400):03}") for _ in range(5000)]
    df = spark.createDataFrame(rows, "repo string, section int, line string").repartition(5)
    made = reports.write(df, str(tmp_path / "report"), parts=6)
    want = {}
    for r in sorted(rows):
        want.setdefault(r[0], []).append(r[1:])
    got = {}
    for r in made.numbered(spark).sort("repo", "line_no").collect():
        got.setdefault(r["repo"], []).append((r["section"], r["line"]))
        assert r["line_no"] == len(got[r["repo"]])
    assert got == want
    assert list(made.lines(spark, "hot")) == [line for _, line in want["hot"]] and list(made.lines(spark, "absent")) == []
    parts = {r["part"] for r in made.manifest(spark).where("repo = 'hot'").collect()}
    assert len(parts) > 2  # a repository of any size is in no single task
    held = made.manifest(spark).collect()
    assert sum(r["lines"] for r in held) == 5000 and all(r["last_row"] - r["first_row"] + 1 == r["lines"] for r in held)


def test_files_hold_their_rows_in_order(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.createDataFrame([(f"r{i % 7}", i % 3, f"l{i * 37 % 100:02}") for i in range(300)], "repo string, section int, line string")
    reports.write(df, str(tmp_path / "report"), parts=3)
    files = glob.glob(str(tmp_path / "report/rows/part=*/*.parquet"))
    assert len(files) > 1
    for f in files:
        rows = pq.ParquetFile(f).read().to_pylist()
        assert [r["row"] for r in rows] == list(range(len(rows)))
        assert rows == sorted(rows, key=lambda r: (r["repo"], r["section"], r["line"]))


def test_an_empty_report(spark, tmp_path):
    made = reports.write(spark.createDataFrame([], "repo string, section int, line string"), str(tmp_path / "report"))
    assert made.numbered(spark).collect() == []
