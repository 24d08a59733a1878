"""Police reports by street pair, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from junctura.plans.traffic import parse_reports
from junctura.sources.context import REPORT_COLS

SPAN = "30 days"


def report_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """New CSV files of a folder, every value as text."""
    schema = ", ".join(f"{c} string" for c in REPORT_COLS)
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)


def by_pair_and_span(raw: DataFrame, since: str, late: str) -> DataFrame:
    """(pair, start, n_reports, injured, killed, last), a row for each pair and span of
    time. On a stream a span is closed, and its state dropped, once reports are ``late``
    past its end; rows later than that are not counted any more."""
    r = parse_reports(raw, since).withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", late)
    g = r.groupBy("pair", F.window("at", SPAN).alias("span")).agg(F.count("*").alias("n_reports"), F.sum("injured").alias("injured"), F.sum("killed").alias("killed"), F.max("date").alias("last"))
    return g.select("pair", F.col("span.start").alias("start"), "n_reports", "injured", "killed", "last")


def keep_current(stream: DataFrame, table: str, checkpoint: str) -> int | None:
    """The last version written, None if there was nothing new. Fold the updates of ``by_pair_and_span`` into ``table``: version n, a folder of its
    own, is version n - 1 with the changed rows replaced, so a batch that is
    repeated after a failure writes the same version again. Runs until the files at hand are read."""
    written: list[int] = []

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        written.append(n)
        if n:
            old = spark.read.schema(batch.schema).parquet(f"{table}/v{n - 1}")
            batch = old.join(batch, ["pair", "start"], "left_anti").unionByName(batch)
        batch.write.mode("overwrite").parquet(f"{table}/v{n}")

    q = stream.writeStream.outputMode("update").foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return written[-1] if written else None


def current(spark: SparkSession, table: str, version: int) -> DataFrame:
    """Totals by pair of one version."""
    return spark.read.parquet(f"{table}/v{version}").groupBy("pair").agg(
        F.sum("n_reports").alias("n_reports"), F.sum("injured").alias("injured"), F.sum("killed").alias("killed"), F.max("last").alias("last"))
