import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from repograin.session import local_session

    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def make_files(spark):
    """``files`` frame from (repo, path, content) rows."""
    from pyspark.sql import functions as F

    from repograin.sources.corpus import with_file_columns

    def build(rows):
        df = spark.createDataFrame(rows, "repo string, path string, content string")
        return with_file_columns(df.withColumn("modified", F.lit(1)))

    return build
