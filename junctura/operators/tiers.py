"""Tiered lists, catch tables, matched controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from junctura.config import CATCH_KS, STRATA
from junctura.operators.ranking import ranked
from junctura.session import attach

SOURCES = ("known", "screen", "predicted")


def check_tier(df: DataFrame, sid: str, cols: list[str]) -> DataFrame:
    """Rows that break a tier input: duplicated ids. Missing columns raise."""
    missing = [c for c in [sid, *cols] if c not in df.columns]
    if missing:
        raise KeyError(f"input is missing columns {missing}")
    return df.groupBy(sid).count().where("count > 1")


def require_unique(df: DataFrame, sid: str, cols: list[str], name: str) -> DataFrame:
    """``df``, or an error that names some of the ids that it repeats."""
    again = [r[sid] for r in check_tier(df, sid, cols).orderBy(sid).limit(5).collect()]
    if again:
        raise ValueError(f"{name}: ids occur more than once, e.g. {again}")
    return df


def combined_list(known: DataFrame, screen: DataFrame, predicted: DataFrame, n: int, sid: str) -> DataFrame:
    """Known sites, then screened, then predicted; one row per site, cut at n. A
    site takes the highest tier that admits it and keeps the attributes of all."""
    if n < 0:
        raise ValueError("n must be >= 0")
    for df, cols, name in zip((known, screen, predicted), (["ksi_history", "crashes_history"], ["screen_count"], ["model_rank"]), SOURCES):
        require_unique(df, sid, cols, name)
    k = known.select(sid, "ksi_history", "crashes_history", F.lit(True).alias("_k"))
    s = screen.select(sid, "screen_count", F.lit(True).alias("_s"))
    p = predicted.select(sid, F.col("model_rank").cast("bigint").alias("model_rank"))
    a = k.join(s, sid, "full").join(p, sid, "full")
    tier = F.when(F.col("_k"), 0).when(F.col("_s"), 1).otherwise(2)
    a = a.withColumn("_tier", tier)
    # One ascending sort key per tier; the id settles what is left.
    first = F.when(F.col("_tier") == 0, -F.col("ksi_history")).when(F.col("_tier") == 1, -F.col("screen_count")).otherwise(
        F.col("model_rank")).cast("bigint")
    second = F.when(F.col("_tier") == 0, -F.col("crashes_history")).otherwise(0).cast("bigint")
    r = ranked(a.withColumn("_a", first).withColumn("_b", second),
               [("_tier", False), ("_a", False), ("_b", False), (sid, False)], "rank")
    name = F.element_at(F.array(*[F.lit(x) for x in SOURCES]), F.col("_tier") + 1)
    return r.where(F.col("rank") <= n).select(
        sid, "rank", name.alias("source"), "model_rank",
        F.coalesce("ksi_history", F.lit(0)).alias("ksi_history"), F.coalesce("screen_count", F.lit(0)).alias("screen_count"),
        F.coalesce("_s", F.lit(False)).alias("city_screen"))


def composition(combined: DataFrame) -> DataFrame:
    """Rows per tier, zeros included."""
    return combined.agg(*[F.count_if(F.col("source") == s).alias(s) for s in SOURCES]).select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("n")) for s in SOURCES])).alias("r")
    ).select("r.*")


def catch_table(df: DataFrame, rank: str, positive: str, ks=CATCH_KS) -> DataFrame:
    """(k, caught, total) by the model's own rank; rows without one are not scored."""
    pos = F.col(positive) & F.col(rank).isNotNull()
    one = df.agg(F.count_if(pos).alias("total"), *[F.count_if(pos & (F.col(rank) <= k)).alias(f"c{k}") for k in ks])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("caught"), F.col("total")) for k in ks])).alias("r")).select("r.*")


def district_counts(df: DataFrame, rank: str, district: str, ks=CATCH_KS, districts=range(1, 10)) -> DataFrame:
    """Per district, sites within each shortlist; empty districts stay."""
    have = df.groupBy(F.col(district).cast("int").alias("district")).agg(
        *[F.count_if(F.col(rank) <= k).alias(f"top_{k}_count") for k in ks])
    frame = df.sparkSession.createDataFrame([(int(d),) for d in districts], "district int")
    return frame.join(have, "district", "left").select(
        "district", *[F.coalesce(f"top_{k}_count", F.lit(0)).alias(f"top_{k}_count") for k in ks])


def tier_lift(sites: DataFrame, catch: DataFrame, n_candidates: DataFrame, rank: str, min_events: int = 3) -> DataFrame:
    """Each site with its shortlist (smallest k >= rank), the catch there and the
    lift, withheld under ``min_events``. The catch table has one row per shortlist
    size, so it is folded into one broadcast row."""
    one = attach(catch.agg(F.array_sort(F.collect_list(F.struct("k", "caught", "total"))).alias("_t")), n_candidates)
    x = attach(sites, one).withColumn("_p", F.try_element_at(
        F.filter("_t", lambda c: c["k"] >= F.col(rank)), F.lit(1)))
    lift = (F.col("_p.caught") / F.col("_p.k")) / F.nullif(F.col("_p.total") / F.col("n_candidates"), F.lit(0.0))
    return x.select(*sites.columns, F.col("_p.k").alias("k"), F.col("_p.caught").alias("caught"),
                    F.col("_p.total").alias("total"), F.when(F.col("_p.caught") >= min_events, lift).alias("lift"))


def stratum(rank: str):
    """Index of the rank stratum, null outside all."""
    e = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(STRATA):
        e = F.when(F.col(rank).between(lo, hi), i).otherwise(e)
    return e


def matched_controls(treated: DataFrame, pool: DataFrame, used: DataFrame, *, sid: str, n: int = 3) -> DataFrame:
    """Up to n controls per treated site: same rank stratum, same control type when
    known, exposure within half to double when both known, never used before, same
    district first, then by rank. ``reason`` is null; a treated site whose rank is in no
    stratum, or that nothing matches, has one row with a reason and no control.

    Exposure is bucketed by powers of two, so the x0.5..x2 band is an equality on
    neighbouring buckets. A side without exposure takes anyone, so of its partners only the
    n best of each district and control type can be chosen: a treated site without
    exposure meets that short list instead of the whole stratum, and free sites without
    exposure are cut to it as well.
    """
    taken = used.select(sid).union(treated.select(sid)).distinct()
    free = pool.join(taken, sid, "left_anti").withColumn("_st", stratum("rank")).where("_st is not null")
    octave = F.floor(F.log2(F.col("entering").cast("double"))).cast("int")
    known = F.coalesce(F.col("entering") > 0, F.lit(False))
    # the n best by rank of each (stratum, type, district): a bounded window, limited before the shuffle
    short = Window.partitionBy("_st", "control", "council_district").orderBy("rank", sid)
    cut = lambda df: df.withColumn("_k", F.row_number().over(short)).where(F.col("_k") <= n).drop("_k")
    c = free.where(known).withColumn("_b", octave).unionByName(cut(free.where(~known)).withColumn("_b", F.lit(-2))).unionByName(cut(free).withColumn("_b", F.lit(-1)))
    t = treated.withColumn("_st", stratum("rank")).withColumn(
        "_b", F.explode(F.when(known, F.array(octave - 1, octave, octave + 1, F.lit(-2))).otherwise(F.array(F.lit(-1)))))
    tt = t.select(F.col(sid).alias("treated_id"), "_st", "_b", F.col("control").alias("_tc"),
                  F.col("entering").alias("_te"), F.col("council_district").alias("_td"))
    ok = (F.col("_tc").isNull() | F.col("control").eqNullSafe(F.col("_tc"))) & (
        F.col("_te").isNull() | (F.col("_te") == 0) | F.col("entering").isNull() | (F.col("entering") == 0)
        | F.col("entering").between(F.col("_te") / 2, F.col("_te") * 2))
    far = (F.col("council_district") != F.col("_td")).cast("int")
    w = Window.partitionBy("treated_id").orderBy(far, "rank", sid)
    found = (
        tt.join(c, ["_st", "_b"]).where(ok).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
        .select("treated_id", F.col(sid).alias("control_id"), F.col("rank").alias("control_rank"), "pos", F.lit(None).cast("string").alias("reason"))
    )
    reason = F.when(F.col("_st").isNull(), "rank in no stratum").otherwise("no free match")
    left = treated.select(F.col(sid).alias("treated_id"), stratum("rank").alias("_st")).join(found.select("treated_id").distinct(), "treated_id", "left_anti")
    none = left.select("treated_id", F.lit(None).cast(dict(found.dtypes)["control_id"]).alias("control_id"), F.lit(None).cast(dict(found.dtypes)["control_rank"]).alias("control_rank"),
                       F.lit(None).cast("int").alias("pos"), reason.alias("reason"))
    return found.unionByName(none)
