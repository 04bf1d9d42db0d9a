"""Incremental runs on a stream of new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES_SCHEMA = "repo string, path string, ext string, lang string, length bigint, modified bigint, content string"


CHANGES_SCHEMA = FILES_SCHEMA + ", deleted boolean"
LOG_SCHEMA = "repo string, path string, modified bigint, fingerprint string, deleted boolean, batch bigint"


def stream_files(spark: SparkSession, folder: str, max_files: int | None = None, schema: str = FILES_SCHEMA) -> DataFrame:
    """``files`` rows arriving as parquet in a folder; with ``CHANGES_SCHEMA``, deletions as well."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(folder)


def append_results(files: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Run a per-file operator on every new batch and append its rows.

    Each batch writes its own folder, overwritten on a retry, so a batch that
    is run twice after a failure leaves its rows once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(log: DataFrame) -> DataFrame:
    """The last logged state of each file; a log row is smaller than a file, and a minimum by file is combined before the shuffle."""
    state = F.struct("batch", "modified", "fingerprint", "deleted")
    return log.groupBy("repo", "path").agg(F.max(state).alias("s")).select("repo", "path", "s.*")


def _read_log(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/log")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    log = spark.read.schema(LOG_SCHEMA).parquet(f"{target}/log")
    return log if before is None else log.where(F.col("batch") < before)


def maintain(changes: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Keep the rows of a per-file operator up to date while files are added, edited and deleted.

    ``changes`` has ``CHANGES_SCHEMA``; ``operator`` must keep ``repo`` and
    ``path``. Each batch meets the log of earlier ones by file: what is older
    than the known state, or has the same content, is passed over; of several
    changes of a file in a batch the newest counts (a deletion after an edit of
    the same time). Rows and log of a batch are folders of its number, rows
    first, overwritten on a retry, so neither a retry nor a replay leaves
    anything twice. :func:`current` reads the rows that hold.
    """
    spark = changes.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        from repograin.session import saved

        columns = batch.columns
        last = batch.groupBy("repo", "path").agg(F.max_by(F.struct(*columns), F.struct("modified", F.coalesce("deleted", F.lit(False)), F.xxhash64("content"))).alias("f")).select("f.*")
        gone = F.coalesce("deleted", F.lit(False))
        last = last.withColumn("deleted", gone).withColumn("fingerprint", F.when(F.col("deleted"), "").otherwise(F.sha2(F.coalesce("content", F.lit("")), 256)))
        log = _read_log(spark, target, batch_id)
        if log is not None:
            known = _newest(log).select("repo", "path", F.col("modified").alias("_modified"), F.col("fingerprint").alias("_fingerprint"))
            newer = F.col("_modified").isNull() | ((F.col("modified") >= F.col("_modified")) & (F.col("fingerprint") != F.col("_fingerprint")))
            last = last.join(known, ["repo", "path"], "left").where(newer).drop("_modified", "_fingerprint")
        last = saved(last, "changes")
        operator(last.where("NOT deleted").drop("deleted", "fingerprint")).write.mode("overwrite").parquet(f"{target}/rows/batch={batch_id}")
        last.select("repo", "path", "modified", "fingerprint", "deleted").write.mode("overwrite").parquet(f"{target}/log/batch={batch_id}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The operator's rows as one run over the present files would give them: each file's rows from its last change."""
    holding = _newest(_read_log(spark, target)).where("NOT deleted").select("repo", "path", "batch")
    rows = spark.read.option("mergeSchema", "true").parquet(f"{target}/rows").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(holding, ["repo", "path", "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, target: str, into: str) -> None:
    """The holding rows and states as the first batch of a new target, so that old versions can go."""
    log = _newest(_read_log(spark, target))
    current(spark, target).write.parquet(f"{into}/rows/batch=-1")
    log.drop("batch").write.parquet(f"{into}/log/batch=-1")
