"""History and trend features per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from junctura.config import KSI, INJURY, PDO, Params
from junctura.functions import records as R, series as S


def years_of(p: Params) -> list[int]:
    return list(range(p.windows.feature_start.year, p.windows.cutoff.year))


def conditional_counts(assigned: DataFrame, p: Params, sid: str = "site_id") -> DataFrame:
    """Every count feature and the yearly counts ``y0..`` in one aggregation with
    map-side partials; nothing dated on or after the cutoff enters."""
    w = p.windows
    d = F.col("date")
    ev = assigned.where(d < F.lit(w.cutoff))
    w72, w36 = d >= F.lit(w.feature_start), d >= F.add_months(F.lit(w.cutoff), -36)
    n = lambda cond: F.count_if(w72 & F.coalesce(cond, F.lit(False)))
    sev = F.col("severity").cast("string").try_cast("double")
    aggs = [
        F.count_if(w72).alias("crashes_72mo"), F.count_if(w36).alias("crashes_36mo"),
        n(F.col("ped") == "Y").alias("ped_crashes_72mo"), n(F.col("bike") == "Y").alias("bike_crashes_72mo"),
        n(F.col("collision").isin(*R.BROADSIDE_CODES)).alias("broadside_72mo"),
        n(F.col("is_left_turn")).alias("left_turn_72mo"), n(F.col("alcohol") == "Y").alias("dui_72mo"),
        n(F.col("lighting").isin(*R.NIGHT_CODES)).alias("night_72mo"),
        n(F.trim("pcf") == R.PED_ROW_CATEGORY).alias("ped_row_violation_72mo"),
        (F.count_if(w72 & F.col("pcf").isNotNull()) == 0).cast("int").alias("ped_row_violation_missing"),
        (F.datediff(F.lit(w.cutoff), F.max("date")) / 365.25).alias("years_since_last_crash"),
        F.count_distinct(F.when(w72, d)).alias("distinct_crash_days_72mo"),
        F.coalesce(F.min(F.when(w72, sev)).cast("int"), F.lit(5)).alias("worst_severity_72mo"),
        F.count_if(d >= F.lit(p.pandemic_start)).alias("_period"),
        *[F.count_if(F.year("date") == y).alias(f"y{i}") for i, y in enumerate(years_of(p))],
    ]
    return ev.groupBy(sid).agg(*aggs)


def series_features(counts: DataFrame, p: Params, sid: str = "site_id") -> DataFrame:
    ys = [F.col(f"y{i}") for i in range(len(years_of(p)))]
    return counts.withColumns({
        "crash_trend_slope": S.slope(ys), "emergence_velocity": S.velocity(ys),
        "emergence_acceleration": S.acceleration(ys), "mann_kendall_tau": S.kendall_tau(ys),
        "changepoint_prob": S.changepoint(ys), "ewma_crashes": S.ewma_last(ys, p.ewma_alpha),
        "momentum_ratio": S.momentum(ys),
        "covid_period_share": F.col("_period") / F.greatest(F.col("crashes_72mo"), F.lit(1)),
    }).drop("_period", *[f"y{i}" for i in range(len(ys))])


FEATURES = [
    "crashes_36mo", "crashes_72mo", "ped_crashes_72mo", "bike_crashes_72mo", "broadside_72mo", "left_turn_72mo",
    "dui_72mo", "night_72mo", "ped_row_violation_72mo", "years_since_last_crash", "distinct_crash_days_72mo",
    "worst_severity_72mo", "crash_trend_slope", "emergence_velocity", "emergence_acceleration",
    "mann_kendall_tau", "changepoint_prob", "ewma_crashes", "momentum_ratio", "covid_period_share",
]


def history_features(assigned: DataFrame, candidates: DataFrame, p: Params, sid: str = "site_id") -> DataFrame:
    """Feature row per candidate. Sites without events take the default row; they
    are not run through the formulas, which would give a constant series 0.269."""
    active = series_features(conditional_counts(assigned, p, sid), p, sid)
    w = p.windows
    silent = (w.cutoff - w.burn_in_start).days / 365.25
    defaults = {c: 0.0 for c in FEATURES} | {
        "years_since_last_crash": silent, "worst_severity_72mo": 5, "ped_row_violation_missing": 1}
    return candidates.select(sid).join(active, sid, "left").fillna(defaults)


CHANNELS = ("n_total", "n_ksi", "n_injury", "n_pdo", "n_ped", "n_bike", "n_broadside", "n_night")


def _channels(pdo_code: int) -> list:
    sev = F.col("severity").cast("string").try_cast("int")
    c = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    return [
        F.count("*").alias("n_total"), c(sev.isin(*KSI)).alias("n_ksi"), c(sev.isin(*INJURY)).alias("n_injury"),
        c(sev == pdo_code).alias("n_pdo"), c(F.col("ped") == "Y").alias("n_ped"), c(F.col("bike") == "Y").alias("n_bike"),
        c(F.col("collision").isin(*R.BROADSIDE_CODES)).alias("n_broadside"),
        c(F.col("lighting").isin(*R.NIGHT_CODES)).alias("n_night")]


def densify(ids: DataFrame, first: int, last: int) -> DataFrame:
    """Each id once per year (an explode of a constant range, not a join)."""
    return ids.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))


def yearly_channels(assigned: DataFrame, candidates: DataFrame, p: Params, sid: str = "site_id",
                    pdo_code: int = PDO) -> DataFrame:
    """(site, year, 8 counts), silent years included. ``pdo_code`` defaults to the
    canonical 5; 0 gives the older coding, which never matched that scale."""
    ys = years_of(p)
    ev = assigned.where((F.col("date") >= F.lit(p.windows.feature_start)) & (F.col("date") < F.lit(p.windows.cutoff)))
    have = ev.groupBy(sid, F.year("date").alias("year")).agg(*_channels(pdo_code))
    return densify(candidates.select(sid), ys[0], ys[-1]).join(have, [sid, "year"], "left").fillna(0, list(CHANNELS))


def sequence_arrays(yearly: DataFrame, sid: str = "site_id") -> DataFrame:
    """One row per site with its years in order (bounded by the number of years)."""
    return yearly.groupBy(sid).agg(F.array_sort(F.collect_list(F.struct("year", *CHANNELS))).alias("sequence"))


def year_history(assigned: DataFrame, sites: DataFrame, first: int, last: int, sid: str = "site_id") -> DataFrame:
    """(site, year, ksi, injury, pdo), zeros included."""
    g = R.severity_group(F.col("severity"))
    have = assigned.where(F.year("date").between(first, last)).groupBy(sid, F.year("date").alias("year")).agg(
        *[F.count_if(g == c).alias(c) for c in ("ksi", "injury", "pdo")])
    return densify(sites.select(sid), first, last).join(have, [sid, "year"], "left").fillna(0, ["ksi", "injury", "pdo"])


def nested_history(yearly: DataFrame, sid: str = "site_id") -> DataFrame:
    return yearly.groupBy(sid).agg(
        F.array_sort(F.collect_list(F.struct("year", "ksi", "injury", "pdo"))).alias("crash_history"))


def rates(history, first: int, last: int, recent_from: int) -> dict:
    """Rate and trend columns from the nested history: rising or falling needs both
    a ratio (1.5 / 0.5) and a change of one a year."""
    full = F.filter(history, lambda h: h["year"].between(first, last))
    add = lambda arr, f: F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, h: a + f(h))
    tot = lambda h: h["ksi"] + h["injury"] + h["pdo"]
    inj = lambda h: h["ksi"] + h["injury"]
    rec = F.filter(full, lambda h: h["year"] >= recent_from)
    old = F.filter(full, lambda h: h["year"] < recent_from)
    mean = lambda arr, f: F.coalesce(add(arr, f) / F.nullif(F.size(arr), F.lit(0)), F.lit(0.0))
    r, e = mean(rec, tot), mean(old, tot)
    trend = (F.when((r >= e * 1.5) & (r - e >= 1), "rising").when((r <= e * 0.5) & (e - r >= 1), "falling")
             .otherwise("steady"))
    some = F.size(full) > 0
    return {"years": F.when(some, F.size(full)), "total": F.when(some, add(full, tot)),
            "injuries": F.when(some, add(full, inj)), "injury_per_year": F.when(some, mean(full, inj)),
            "per_year": F.when(some, mean(full, tot)), "recent_per_year": F.when(some, r),
            "earlier_per_year": F.when(some, e), "trend": F.when(some, trend)}


def rate_per_million(per_year, entering):
    return F.when((entering > 0) & (per_year >= 0), per_year / (entering * 365 / 1e6))


def screen_gap(history, year: int, threshold: int):
    """(injury events in the year, how many more the screen needs); null when the
    year is not on record."""
    h = F.try_element_at(F.filter(history, lambda h: h["year"] == year), F.lit(1))
    n = h["injury"] + h["ksi"]
    return n, F.when(n.isNotNull(), F.greatest(F.lit(0), threshold - n))


def feature_dictionary(features: DataFrame, cols: list[str], source: str, window: str, max_date: str,
                       dropped: list[tuple[str, str]] = ()) -> DataFrame:
    """Missing rate and sample variance per feature, plus the dropped features."""
    stats = features.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"n_{c}") for c in cols],
                         *[F.var_samp(F.col(c).cast("double")).alias(f"v_{c}") for c in cols])
    long = stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature_name"), (1 - F.col(f"n_{c}") / F.col("_n")).alias("missing_rate"),
                 F.col(f"v_{c}").alias("variance")) for c in cols])).alias("r")).select("r.*")
    base = long.withColumns({"source_table": F.lit(source), "window_used": F.lit(window), "max_source_date": F.lit(max_date),
                             "drop_reason": F.lit(None).cast("string")})
    if not dropped:
        return base
    gone = features.sparkSession.createDataFrame(
        [(n, None, 0.0 if "zero" in r else None, "N/A", "N/A -- DROPPED", "N/A", r) for n, r in dropped],
        "feature_name string, missing_rate double, variance double, source_table string, window_used string, "
        "max_source_date string, drop_reason string")
    return base.unionByName(gone)


def upsert_dictionary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Later rows win per feature name."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in ("feature_name", "_v")]
    return both.groupBy("feature_name").agg(F.max_by(F.struct(*cols), "_v").alias("s")).select("feature_name", "s.*")
