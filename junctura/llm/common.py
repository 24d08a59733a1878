"""Staged tables and small column helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from junctura.session import scratch_path, sweep

#: The white space of the word rules, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A staged table that is known to be small is written by few tasks.
ROWS_PER_TASK, LEAST_TASKS = 50_000, 12


def staged(df: DataFrame, name: str, rows: int | None = None, partition_by: str | None = None) -> DataFrame:
    """Write to the shared folder (``spark.checkpoint.dir``) and read back: the copy
    outlives lost executors and ends the lineage. ``rows``, where a bound is known,
    keeps the number of writing tasks in proportion to them. ``partition_by`` names the
    last column, by whose values the files are laid out."""
    path = scratch_path(df.sparkSession, name)
    kept = df if rows is None else df.coalesce(max(LEAST_TASKS, -(-rows // ROWS_PER_TASK)))
    (kept.write.partitionBy(partition_by) if partition_by else kept.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete staged copies that no later step reads."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, for rows that each hold much."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_of(col: str | Column = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)
