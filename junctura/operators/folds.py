"""Cross-validation folds as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from junctura.operators.proximity import cell_of
from junctura.operators.ranking import ranked
from junctura.operators.resampling import hash_int


def stratified_folds(df: DataFrame, sid: str, stratum: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    """Rows of each stratum are dealt round-robin in hash order: fold sizes differ
    by at most one per stratum. The order is global (stratum, hash, id), so a
    stratum holding nearly all rows is still spread out."""
    h = df.select(sid, stratum).withColumn("_h", hash_int(F.lit(seed), F.col(sid)))
    r = ranked(h, [(stratum, False), ("_h", False), (sid, False)], "_r")
    first = r.groupBy(stratum).agg(F.min("_r").alias("_f"))
    dealt = r.join(first, stratum).select(sid, ((F.col("_r") - F.col("_f")) % k).cast("int").alias(out))
    return df.join(dealt.hint("merge"), sid)  # a row for each row: not through the driver


def tile_blocks(df: DataFrame, tile: float, x: str = "x", y: str = "y", out: str = "block") -> DataFrame:
    """Grid tile of each row, relabelled 0..n-1 in row-major order."""
    t = df.withColumn("_c", cell_of(F.col(x), tile)).withColumn("_r", cell_of(F.col(y), tile))
    seen = t.select("_r", "_c").distinct()
    lab = ranked(seen, [("_r", False), ("_c", False)], "_k").select("_r", "_c", (F.col("_k") - 1).cast("int").alias(out))
    return t.join(lab, ["_r", "_c"]).drop("_r", "_c")


def block_folds(df: DataFrame, block: str, k: int, seed: int | None = None, out: str = "fold") -> DataFrame:
    """Whole blocks go to folds: blocks by descending size are dealt in a snake
    (0..k-1, k-1..0, ...), which keeps fold sizes close. ``seed`` permutes blocks of
    equal size, so repeats differ. Works for any group key, e.g. the entity id of
    stacked windows."""
    size = df.groupBy(block).agg(F.count("*").alias("_n"))
    size = size.withColumn("_h", hash_int(F.lit(seed), F.col(block)) if seed is not None else F.lit(0).cast("bigint"))
    r = ranked(size, [("_n", True), ("_h", False), (block, False)], "_p")
    p = (F.col("_p") - 1) % (2 * k)
    f = F.when(p < k, p).otherwise(2 * k - 1 - p).cast("int")
    return df.join(r.select(block, f.alias(out)), block)


def fold_positives(df: DataFrame, fold: str, y: str) -> DataFrame:
    """Positives per held-out fold."""
    return df.groupBy(fold).agg(F.sum(y).cast("bigint").alias("n_pos"), F.count("*").alias("n"))


def power_verdict(per_fold: DataFrame, min_pos: int = 6) -> DataFrame:
    """One row: total positives, smallest and largest fold, reportable or not."""
    return per_fold.agg(
        F.sum("n_pos").alias("n_pos"), F.min("n_pos").alias("min_fold"), F.max("n_pos").alias("max_fold"),
    ).withColumn("verdict", F.when(F.col("n_pos") >= min_pos, "REPORTABLE").otherwise("UNDERPOWERED"))
