"""Session helpers that work on a cluster and in local tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCAN_PARTITIONS = "spark.repograin.scanPartitions"  # set where inputs are too few files to keep the cores busy


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("repograin")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config(SCAN_PARTITIONS, cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.maxFields", "400")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a new local folder only where it is unset and everything runs in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, label: str) -> str:
    """A name for a new folder in the shared one; it is deleted when the application ends."""
    home = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{home}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str = "saved", made: list[str] | None = None) -> DataFrame:
    """Write the rows once and read them back: short lineage, fixed contents, no loss with an executor.

    The folder is noted in ``made``, for tables that may go (``drop``) before the application ends.
    """
    spark = df.sparkSession
    df = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})
    path = new_folder(spark, label)
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, made: list[str]) -> None:
    """Delete saved tables that nothing reads any more."""
    for name in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    made.clear()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a saved table, for frames that several questions share."""
    return saved(df, "frame")


def input_state(spark: SparkSession, folder: str) -> tuple[int, int, int]:
    """Bytes, files and time of change of an input folder: another state, other tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = files.getContentSummary(path)
    return size.getLength(), size.getFileCount(), files.getFileStatus(path).getModificationTime()
