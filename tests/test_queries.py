"""Catalogue checks, and a sample of queries against their SQL."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
SAMPLE = ["t1_marker_extraction", "d1_section_split", "c6_near_duplicate_claims", "f14_ecosystem_dispatch", "e1_segment_extraction", "m15_stories", "a3_file_churn", "v1_batch_packing"]


def test_every_query_has_sql():
    import __spark_entry__ as entry

    names = {n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}  # training-data queries have tests of their own
    assert names <= set(entry.oracle_sql()) <= set(entry.queries()) and len(names) > 230


def test_everything_else_works_without_the_training_data_operators(tmp_path):
    """A copy without that subpackage still imports and has all other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(copy)}).stdout.split()
    assert int(out[-2]) > 230 and out[-1] == "False"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, name):
    import __spark_entry__ as entry
    from oracle_check import compare, connect

    ok, message = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_no_nested_loop_joins_in_plans(spark):
    import __spark_entry__ as entry

    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    for name in ("t6_marker_summary", "d3_technology_detection", "m10_component_relations", "q2_relation_patterns", "s7_file_and_directory_probes", "o2_lookup_with_default"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
