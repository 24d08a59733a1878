"""Global order without pulling the data into one task.

A window with no partition key runs in a single task. Here rows are
range-partitioned by the full sort key (score, then id, so a score shared by a
third of all rows still splits), written once, numbered inside each range, and
shifted by the totals of the ranges before it. Only one small row per range is
ever looked at globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from junctura.session import attach, stage

Key = tuple[str, bool]  # column, descending


def _order(keys: list[Key]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in keys]


def running_totals(df: DataFrame, keys: list[Key], measures: dict[str, str]) -> DataFrame:
    """Adds, for each ``out: column`` in ``measures``, the inclusive running sum of
    ``column`` over all rows in key order. Keys must identify a row."""
    ranged = stage(df.repartitionByRange(*_order(keys)).withColumn("_part", F.spark_partition_id()), "ordered")
    # One row per range: bounded by the number of ranges, so the window and the
    # broadcast below stay small whatever the data size.
    per = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in measures.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("_part", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}")
                                 for o in measures])
    local = Window.partitionBy("_part").orderBy(*_order(keys)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = ranged
    for o, c in measures.items():
        out = out.withColumn(f"_l_{o}", F.sum(c).over(local))
    out = out.join(F.broadcast(base), "_part")
    for o in measures:
        out = out.withColumn(o, F.col(f"_l_{o}") + F.col(f"_b_{o}"))
    return out.drop("_part", *[f"_l_{o}" for o in measures], *[f"_b_{o}" for o in measures])


def ranked(df: DataFrame, keys: list[Key], out: str = "rank") -> DataFrame:
    """1-based position in key order ("first" method: the id breaks ties)."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(one, keys, {out: "_one"}).drop("_one")


def with_total(df: DataFrame, out: str = "n_total") -> DataFrame:
    """Attach the row count (a one-row broadcast)."""
    return attach(df, df.agg(F.count("*").alias(out)))


def rank_and_percentile(df: DataFrame, score: str, sid: str) -> DataFrame:
    """``rank`` 1..n by score and ``percentile`` = 100 at the top, clipped to 0..100."""
    r = ranked(df, [(score, True), (sid, False)])
    pct = (1 - (F.col("rank") - 1) / F.col("n_total")) * 100
    return with_total(r).withColumn(
        "percentile", F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct))).drop("n_total")


def score_groups(df: DataFrame, score: str, aggs: list[Column], desc: bool = True,
                 totals: dict[str, str] | None = None) -> DataFrame:
    """One row per distinct score with its aggregates and running totals. Ties
    collapse here, before any ordering."""
    g = df.groupBy(score).agg(*aggs)
    return running_totals(g, [(score, desc)], totals or {})


def mid_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Average rank of each distinct value, ascending: (col, out)."""
    g = score_groups(df, col, [F.count("*").alias("_n")], desc=False, totals={"_cum": "_n"})
    return g.select(col, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(out))


def rank_average(df: DataFrame, scores: list[str], sid: str, out: str = "ensemble") -> DataFrame:
    """Mean of 0-based ranks over n, negated so that higher is better."""
    acc = df.select(sid)
    for s in scores:
        r = with_total(ranked(df.select(sid, s), [(s, True), (sid, False)], "_r"), "_n")
        acc = acc.join(r.select(sid, ((F.col("_r") - 1) / F.col("_n")).alias(f"_{s}")).hint("merge"), sid)
    total = sum((F.col(f"_{s}") for s in scores), F.lit(0.0))
    return acc.select(sid, (-total / len(scores)).alias(out))


def top_k(df: DataFrame, score: str, sid: str, k: int) -> DataFrame:
    """The k best rows. k is the feature asked for, so a bounded limit is exact."""
    return df.orderBy(F.col(score).desc(), F.col(sid)).limit(k)


def global_quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    """Linear-interpolated quantile as one row (``q_value``), from distinct values
    and running counts, so no single buffer holds every value."""
    g = score_groups(df.where(F.col(col).isNotNull()), col, [F.count("*").alias("_n")],
                     desc=False, totals={"_cum": "_n"})
    n = g.agg(F.sum("_n").alias("_tot"))
    pos = (F.col("_tot") - 1) * F.lit(float(q))
    x = attach(g, n).withColumn("_lo", F.floor(pos)).withColumn("_hi", F.ceil(pos))
    has = lambda at: (F.col("_cum") - F.col("_n") <= F.col(at)) & (F.col(at) < F.col("_cum"))
    return x.agg(
        F.max(F.when(has("_lo"), F.col(col).cast("double"))).alias("a"),
        F.max(F.when(has("_hi"), F.col(col).cast("double"))).alias("b"),
        F.max(pos - F.floor(pos)).alias("f"),
    ).select((F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("q_value"))


def group_medians(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """Median per key by the same means: values collapse to (key, value, n), the
    rows are ordered once by (key, value), and the middle is read off by position.
    A key with a third of all rows is spread over many ranges."""
    g = df.where(F.col(col).isNotNull()).groupBy(key, col).agg(F.count("*").alias("_n"))
    run = running_totals(g, [(key, False), (col, False)], {"_cum": "_n"})
    start = run.groupBy(key).agg(F.sum("_n").alias("_tot"), F.min(F.col("_cum") - F.col("_n")).alias("_s"))
    x = run.join(start, run[key].eqNullSafe(start[key])).drop(start[key])
    lo = F.floor((F.col("_tot") - 1) / 2) + F.col("_s")
    hi = F.ceil((F.col("_tot") - 1) / 2) + F.col("_s")
    has = lambda at: (F.col("_cum") - F.col("_n") <= at) & (at < F.col("_cum"))
    return x.groupBy(key).agg(
        ((F.max(F.when(has(lo), F.col(col).cast("double"))) + F.max(F.when(has(hi), F.col(col).cast("double")))) / 2)
        .alias(out))
