"""Manifests, frameworks, segments, components, graph and history on tiny inputs."""

import itertools
import random

from pyspark.sql import functions as F

from repograin.operators import components, exports, frameworks, graph, history, run_metrics, scoring, segments
from repograin.sources import manifests
from repograin.sources.configs import load_rules
from repograin.sources.corpus import scan_roots, scan_tree, source_roots
from repograin.streaming.incremental import append_results, stream_files


def test_manifest_readers(spark, make_files):
    files = make_files([
        ("n", "package.json", '{"name":"app","version":"1.0","author":"ann","dependencies":{"react":"^18"},"devDependencies":{"jest":"1"}}'),
        ("c", "Cargo.toml", '[package]\nname = "tool"\n[dependencies]\naxum = "0.7"\nredis = { version = "0.23" }\nx = { git = "y" }\n[features]\nfull = []\n'),
        ("p", "requirements.txt", "# c\n\nFlask==2.0\nbcrypt>=4\npandas\n"),
        ("d", "deno.json", '{"imports":{"std/":"https://deno.land/std/"}}'), ("d", "package.json", "{}"),
    ])
    got = {(r["repo"], r["name"], r["version"]) for r in manifests.dependencies(files).collect()}
    assert got == {("n", "react", "^18"), ("n", "jest", "1"), ("c", "axum", "0.7"), ("c", "redis", "0.23"), ("c", "x", "*"),
                   ("p", "Flask", "2.0"), ("p", "bcrypt", "4"), ("p", "pandas", "*"), ("d", "std/", "https://deno.land/std/")}
    repos = spark.createDataFrame([("n",), ("c",), ("p",), ("d",), ("e",)], "repo string")
    pick = {r["repo"]: (r["manifest"], r["name"]) for r in manifests.preferred(repos, manifests.metadata(files)).collect()}
    assert pick == {"n": ("package.json", "app"), "c": ("Cargo.toml", "tool"), "p": ("requirements.txt", "p"), "d": ("deno.json", "deno-project"), "e": (None, "e")}


def test_framework_detection(spark, make_files):
    files = make_files([
        ("f", "requirements.txt", "Flask==2\n"), ("f", "app.py", "from flask import Flask\napp = Flask(__name__)\n@app.route('/')\n"),
        ("d", "deno.json", '{"tasks":{"launch-server":"x"}}'), ("d", "src/controllers/a.ts", 'import { Controller } from "jsr:@danet/core@2.1.0";\n@Controller()\n'),
    ])
    repos = spark.createDataFrame([("f",), ("d",)], "repo string")
    flags = frameworks.flags(repos, files)
    eco = {r["repo"]: r["ecosystem"] for r in frameworks.ecosystem(repos, files, flags).collect()}
    assert eco == {"f": "Python", "d": "Deno"}
    conf = frameworks.confidence(frameworks.raw_scores(frameworks.evidence(flags)), flags)
    got = {(r["repo"], r["framework"]): r["confidence"] for r in frameworks.dispatch(conf, frameworks.ecosystem(repos, files, flags)).collect()}
    assert set(got) == {("f", "Flask"), ("d", "Danet")} and got[("f", "Flask")] == 1.0


def test_segments_routes_and_models(spark, make_files):
    py = "@app.route('/x', methods=['POST', 'PUT'])\ndef f(a: int) -> str:\n    return 1\nclass A(db.Model):\n    __tablename__ = 'as'\n    n = db.Column(db.String)\n    def m(self):\n        pass\n"
    files = make_files([("r", "a.py", py)])
    seg = {r["name"]: r for r in segments.extract(files).collect()}
    assert (seg["f"]["start_line"], seg["f"]["end_line"], seg["A"]["segment_type"], seg["m"]["start_line"]) == (1, 3, "Database", 7)
    assert [tuple(r)[2:] for r in segments.routes(files).collect()] == [(1, "/x", "POST,PUT", "Flask Route Handler")]
    model = segments.models(segments.extract(files)).collect()[0]
    assert (model["table_name"], model["fields"]) == ("as", ["n"])


def test_components(spark, make_files):
    ts = "import axios from 'axios';\ninterface XProps {\n  a: string;\n  b?: number;\n}\nif (x) { useState(); }\naxios.post('/u');\n" + "x" * 100
    row = components.table(make_files([("r", "src/userForm.tsx", ts)])).collect()[0]
    assert (row["component_type"], row["imports"], row["complexity"], row["status"]) == ("Form", ["axios"], 13, "Complete")
    assert [tuple(p) for p in row["props"]] == [("a", "string", True), ("b", "number", False)]
    assert [tuple(a) for a in row["api_calls"]] == [("/u", "POST")]


def test_cycles_match_brute_force(spark):
    rnd = random.Random(11)
    names = [f"n{i}" for i in range(12)]
    edges = {(a, b) for a in names for b in names if a != b and rnd.random() < 0.25}
    df = spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, src string, dst string")
    want = {">".join((a, b)) for a, b in edges if a < b and (b, a) in edges}
    want |= {">".join((a, b, c)) for a, b, c in itertools.permutations(names, 3) if a < b and a < c and (a, b) in edges and (b, c) in edges and (c, a) in edges}
    got = [r["cycle"] for r in graph.short_cycles(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_failing_batches_are_skipped(spark):
    df = spark.createDataFrame([("a", 0, "good"), ("a", 1, "bad")], "k string, batch bigint, prompt string")

    def scorer(texts):
        if texts[0] == "bad":
            raise RuntimeError("no answer")
        return ["ok"]

    assert {r["batch"]: r["reply"] for r in scoring.score(df, "k", scorer).collect()} == {0: "ok", 1: None}


def test_incremental_selection(spark):
    import datetime

    now = datetime.datetime(2024, 1, 2)
    current = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "repo string, fingerprint string")
    state = spark.createDataFrame(
        [("a", "x", "1", now, "v"), ("b", "x", "old", now, "v"), ("c", "x", "3", now - datetime.timedelta(hours=30), "v"), ("d", "x", "4", now, "w")],
        "repo string, analysis string, fingerprint string, ts timestamp, version string",
    )
    kept = history.fresh(state, current, F.lit(now), "v")
    assert [r["repo"] for r in kept.collect()] == ["a"]
    assert sorted(r["repo"] for r in history.stale(current, kept).collect()) == ["b", "c", "d"]


def test_phase_gaps_cross_days(spark):
    rows = [(1, "p", "2024-01-01 23:59:50", 1), (1, "p", "2024-01-02 00:00:10", 2), (1, "p", "2024-01-02 00:00:15", 3)]
    df = spark.createDataFrame(rows, "run int, phase string, t string, seq int").withColumn("ts", F.to_timestamp("t"))
    assert {r["seq"]: r["seconds"] for r in run_metrics.phase_gaps(df).collect()} == {1: 20.0, 2: 5.0}
    assert run_metrics.phase_durations(run_metrics.phase_gaps(df)).collect()[0]["seconds"] == 5.0


def test_tree_scan_roots_export_and_rules(spark, tmp_path):
    root = tmp_path / "src"
    (root / "shop" / "docs").mkdir(parents=True)
    (root / "shop" / "a.py").write_text("x = 1\n")
    (root / "shop" / "docs" / "b.md").write_text("# Über\n")
    (root / "shop" / "bin.py").write_bytes(b"\xff\xfe\x00")
    got = {(r["repo"], r["path"], r["lang"]) for r in scan_tree(spark, str(root)).collect()}
    assert got == {("shop", "a.py", "python"), ("shop", "docs/b.md", "markdown")}
    assert scan_roots(spark, f"{root}, {root}/ ,").count() == 2
    assert source_roots(" a , a/, b,") == ["a", "b"]
    exports.write(scan_tree(spark, str(root)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "rules.json").write_text('{"sets":[{"id":"a","name":"A","indicators":[{"type":"k","patterns":["x","y"]}]}]}')
    assert {tuple(r)[2:] for r in load_rules(spark, str(tmp_path / "rules.json"), "sets").select("id", "name", "kind", "pattern").collect()} == {("k", "x"), ("k", "y")}


def test_stream_appends_each_batch_once(spark, tmp_path, make_files):
    from repograin.operators import markers

    inbox = str(tmp_path / "in")
    make_files([("r", "a.py", "# TODO one\n")]).write.parquet(inbox)
    run = lambda: append_results(stream_files(spark, inbox), markers.scan, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    run()
    make_files([("r", "b.py", "# TODO two\n")]).write.mode("append").parquet(inbox)
    run()
    assert sorted(r["path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.py", "b.py"]
