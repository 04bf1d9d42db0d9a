"""What the operators share: saved tables, bounded broadcasts, and columns made by Python from few rows at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from repograin.session import new_folder, saved

__all__ = ["WHITE", "give_back", "hinted", "made_columns", "new_folder", "saved", "small_batches"]

WHITE = r"[\x20\x09-\x0D]+"  # the white space that separates words here; nothing else does
ROWS = 256  # texts that lie unpacked in a worker
BATCH = 1_024  # texts that travel to a worker at once


def hinted(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Ask for a broadcast only if the counted rows keep to the bound; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if rows <= bound else df


def give_back() -> None:
    """Return memory that a task no longer needs to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession, rows: int = BATCH) -> None:
    """Let at most so many rows go to Python at once: a batch of whole texts lies in the executor and in the worker together."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    set_to = int(spark.conf.get(name, "10000"))
    if set_to <= 0 or set_to > rows:
        spark.conf.set(name, str(rows))


def made_columns(df: DataFrame, source: str, made: dict[str, str], make: Callable[[list], list[pa.Array]], keep_source: bool = True) -> DataFrame:
    """``df`` with columns that ``make`` computes from ``source``'s values, ``ROWS`` at a time; other columns pass by unopened."""
    sent = [c for c in df.columns if c == source or c not in made]
    kept = [c for c in sent if c not in made and (keep_source or c != source)]
    places, read = [sent.index(c) for c in kept], sent.index(source)
    schema = StructType([df.schema[c] for c in kept] + [StructField(n, DataType.fromDDL(t)) for n, t in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *make(part.column(read).to_pylist())], [*kept, *made])
        give_back()  # the worker stays for later tasks

    return df.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, schema)
