"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from junctura.session import attach


def write_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Parquet, replaced as a whole; curated events are partitioned by year so later
    windows prune folders."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_feature_lines(lines: DataFrame, path: str) -> None:
    """One feature per line, ordered by rank across files by range partitioning."""
    lines.repartitionByRange("rank").sortWithinPartitions("rank").select("value").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_context(df: DataFrame, path: str, key: str = "point_key") -> None:
    """Per-point context, one keyed record per line: no map over all points."""
    df.select(F.to_json(F.struct(F.col(key), F.struct(*[c for c in df.columns if c != key]).alias("record"))).alias("value")
              ).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append-only log; every file carries the header, readers use header=true."""
    df.write.mode("append").option("header", True).csv(path)


def manifest(spark: SparkSession, pattern: str, source: str, rows: DataFrame | None = None, stats: DataFrame | None = None,
             fetched: str = "user-supplied") -> DataFrame:
    """One row per file behind a table: file, sha256, bytes, source, fetch_timestamp and,
    where ``rows`` (a frame read from the files) is given, its row_count. The one row of
    ``stats``, the coordinate provenance of the load, is attached to every file."""
    name = lambda path: F.regexp_extract(path, r"([^/]+)$", 1)
    f = spark.read.format("binaryFile").load(pattern)
    out = f.select(name("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.lit(source).alias("source"), F.lit(fetched).alias("fetch_timestamp"))
    if rows is not None:
        n = rows.groupBy(name(F.input_file_name()).alias("file")).agg(F.count("*").alias("row_count"))
        out = out.join(n, "file", "left").fillna(0, ["row_count"])
    return out if stats is None else attach(out, stats)


def write_graph_edges(edges: DataFrame, path: str) -> None:
    """GraphML-shaped edge files: one well-formed document per task."""
    keys = [c for c in edges.columns if c not in ("src", "dst")]
    data = F.array(*[F.struct(F.lit(k).alias("_key"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("_VALUE")) for k in keys])
    edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), data.alias("data")).write.mode("overwrite").format("xml").option(
        "rootTag", "graph").option("rowTag", "edge").save(path)
