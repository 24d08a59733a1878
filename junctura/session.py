"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_RUN = f"junctura-{uuid.uuid4().hex}"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "junctura", driver_memory: str | None = None) -> SparkSession:
    """A session with adaptive execution on. On a cluster pass neither argument:
    the master and the shuffle width then come from spark-submit."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Only a local master,
    where all tasks share one disk, falls back to a temporary folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _local:
            _local[sc.applicationId] = tempfile.mkdtemp(prefix="spark-")
        base = _local[sc.applicationId]
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    root = f"{shared_dir(spark).rstrip('/')}/{_RUN}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_drop, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_roots: set[str] = set()
_local: dict[str, str] = {}  # of a local master without the setting, by application


def _drop(spark: SparkSession, root: str) -> None:
    """Best effort: remove only the folder this run made."""
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:
        pass


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write to the shared folder and read back. The copy survives lost
    executors, ends the lineage and gives Catalyst real sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


#: Rows that one task groups at once.
ROWS_PER_PART = 500_000


def dealt(df: DataFrame, *keys: str, rows: int = ROWS_PER_PART) -> DataFrame:
    """Hashed by the keys into parts of about so many rows. Partitions that adaptive execution
    merges by their bytes hold as many rows as compress well; these do not grow with the input."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def discard(df: DataFrame) -> None:
    """Delete a staged copy that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        _drop(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Let go of what finished steps shuffled. Spark deletes those files when the driver's collector
    meets their plans, and a driver that holds little collects seldom."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as a scalar subquery: it is
    computed once and enters the plan as a literal, so there is no join. More than
    one row is an error at run time."""
    value = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return df.withColumn("_s", value).select(*df.columns, "_s.*")
