"""Gates as queries: each returns the violations it finds, or one row of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from junctura.config import Windows
from junctura.functions import records as R
from junctura.session import attach

REQUIRED = ("crash_id", "date", "lat", "lon", "severity")
MIN_COVERAGE, MAX_DUPLICATES, MIN_DECIMALS = 0.80, 0.20, 4


def require_columns(df: DataFrame, cols=REQUIRED, who: str = "input") -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"[{who}] missing required columns: {missing}")
    return df


def require_empty(violations: DataFrame, what: str) -> None:
    """Fail the job when a gate found anything (reads at most one row)."""
    row = violations.head(1)
    if row:
        raise ValueError(f"{what}: {row[0].asDict()}")


def leakage(feature: DataFrame, label: DataFrame, w: Windows, eid: str = "event_id") -> DataFrame:
    """(check, n_bad) for the five window rules; any n_bad > 0 is a violation."""
    d = F.col("date")
    f = feature.agg(F.count_if(d >= F.lit(w.cutoff)).alias("A1"),
                    F.count_if((d < F.lit(w.feature_start)) | (d > F.lit(w.feature_end))).alias("A2"))
    la = label.agg(F.count_if((d < F.lit(w.label_start)) | (d > F.lit(w.label_end))).alias("A3"),
                   F.count_if(d < F.lit(w.cutoff)).alias("A5"))
    both = feature.select(eid).join(label.select(eid), eid, "left_semi").distinct().agg(F.count("*").alias("A4"))
    one = attach(attach(f, la), both)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n_bad"))
                                          for c in ("A1", "A2", "A3", "A4", "A5")])).alias("r")).select("r.*")


def dictionary_violations(dic: DataFrame, cutoff: str) -> DataFrame:
    """An active feature dated on or after the cutoff. A7: a feature dropped for
    zero variance whose variance is not zero."""
    dropped = F.coalesce(F.col("window_used").contains("DROPPED"), F.lit(False))
    day = F.try_to_timestamp("max_source_date", F.lit("yyyy-MM-dd"))
    a6 = dic.where(~dropped & (day >= F.lit(cutoff).cast("timestamp"))).select("feature_name", F.lit("A6").alias("check"))
    zero = F.col("drop_reason").rlike("(?i)zero|constant")
    a7 = dic.where(dropped & zero & (F.coalesce("variance", F.lit(1.0)) != 0)).select("feature_name", F.lit("A7").alias("check"))
    return a6.unionAll(a7)


def volume(events: DataFrame, least: int = 20) -> DataFrame:
    return events.agg(F.count("*").alias("n")).withColumn("ok", F.col("n") >= least)


def vintage_violations(dic: DataFrame, limit: str) -> DataFrame:
    """Endogenous features sourced after the infrastructure wall."""
    day = F.try_to_timestamp("max_source_date", F.lit("yyyy-MM-dd"))
    return dic.where((F.col("vintage") == "endogenous") & (day > F.lit(limit).cast("timestamp"))).select("feature_name", "max_source_date")


def contract_stats(df: DataFrame) -> DataFrame:
    """Coverage, bad dates and severities, and the share of rows whose coordinate is
    shared. Rows collapse to one per coordinate first; a coordinate with a third of
    all rows is one partial sum per task."""
    ok = R.valid_point(F.col("lat"), F.col("lon"))
    base = df.agg(F.count("*").alias("n_raw"), F.count_if(~ok).alias("n_bad_coords"),
                  F.count_if(F.col("date").isNull()).alias("n_bad_dates"),
                  F.count_if(~F.coalesce(R.valid_severity(F.col("severity")), F.lit(False))).alias("n_bad_severity"))
    at = df.where(ok).groupBy("lat", "lon").agg(F.count("*").alias("k"))
    dup = at.agg(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("d"), F.sum("k").alias("g"), F.max("k").alias("max_at_one_coord"))
    x = attach(base, dup)
    cov = F.round(1 - F.col("n_bad_coords") / F.nullif(F.col("n_raw"), F.lit(0)), 4)
    share = F.round(F.coalesce(F.col("d") / F.nullif(F.col("g"), F.lit(0)), F.lit(0.0)), 4)
    return x.select("n_raw", "n_bad_coords", cov.alias("coord_coverage"), "n_bad_dates", "n_bad_severity",
                    share.alias("pct_duplicate_coords"), F.coalesce("max_at_one_coord", F.lit(0)).alias("max_at_one_coord"))


def contract_verdict(stats: DataFrame) -> DataFrame:
    return stats.withColumn("verdict", F.when(F.col("n_raw") == 0, "EMPTY").when(
        (F.col("coord_coverage") < MIN_COVERAGE) | (F.col("pct_duplicate_coords") > MAX_DUPLICATES), "WARN").otherwise("OK"))


def decimals(text: Column) -> Column:
    return F.length(F.coalesce(F.get(F.split(text, r"\."), 1), F.lit("")))


def precision_histogram(df: DataFrame, lat_text: str) -> DataFrame:
    return df.groupBy(decimals(F.col(lat_text)).alias("decimals")).agg(F.count("*").alias("n"))


def place_volume(df: DataFrame, place: str, state: str, least: int) -> DataFrame:
    """Rows per named place and whether the place is viable."""
    named = df.where(F.col(place).isNotNull() & (F.upper(place) != "NOT APPLICABLE"))
    key = F.concat_ws(", ", F.initcap(place), F.col(state))
    return named.groupBy(key.alias("place")).agg(F.count("*").alias("n")).withColumn("viable", F.col("n") >= least)


#: Decimals of a useful coordinate and the least share of rows that has them.
USEFUL_DECIMALS, MIN_USEFUL = 4, 0.5


def source_audit(df: DataFrame, source: str, lat_text: str, place: str, state: str, least: int) -> DataFrame:
    """One row on a source (lat, lon, date, severity, its latitude as text, place, state):
    coverage, share of useful decimals, shared coordinates, places, viable places,
    what speaks against it and the verdict. Places are counted before they are looked at."""
    good = df.where(R.valid_point(F.col("lat"), F.col("lon")))
    sharp = good.agg(F.round(F.avg((decimals(F.col(lat_text)) >= USEFUL_DECIMALS).cast("double")), 4).alias("pct_useful_decimals"))
    places = place_volume(good, place, state, least).agg(F.count("*").alias("n_places"), F.count_if("viable").alias("n_viable"), F.max("n").alias("largest_place"))
    x = attach(attach(contract_stats(df), sharp), places)
    against = F.array_compact(F.array(
        F.when(F.coalesce("coord_coverage", F.lit(0.0)) < MIN_COVERAGE, "coverage"), F.when(F.coalesce("pct_useful_decimals", F.lit(0.0)) < MIN_USEFUL, "decimals"),
        F.when(F.col("pct_duplicate_coords") > MAX_DUPLICATES, "shared coordinates")))
    return x.select(F.lit(source).alias("source"), F.col("n_raw").alias("n_crashes"), "coord_coverage", F.col("n_bad_coords").alias("n_missing_coords"), "pct_useful_decimals",
                    "pct_duplicate_coords", "max_at_one_coord", "n_places", "n_viable", "largest_place", F.array_join(against, "; ").alias("problems"),
                    F.when(F.size(against) == 0, "USABLE").otherwise("REVIEW REQUIRED").alias("verdict"))


def snapshot_profile(df: DataFrame, snap: str) -> DataFrame:
    """Per snapshot: rows, date range, shares with coordinates and on highways, KSI."""
    n = F.count("*")
    return df.groupBy(snap).agg(
        n.alias("total_rows"), F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.round(F.count("x") / n * 100, 2).alias("pct_geocoded"), F.round(F.count_if(F.col("state_hwy") == "Y") / n * 100, 2).alias("pct_freeway"),
        F.count_if(R.is_ksi(F.col("severity"))).alias("ksi_rows"))


def snapshot_years(df: DataFrame, snap: str, years: tuple[int, int]) -> DataFrame:
    """(snapshot, year, ksi_rows) for every year of the range, zeros included."""
    per = df.where(R.is_ksi(F.col("severity"))).groupBy(snap, F.year("date").alias("year")).agg(F.count("*").alias("ksi_rows"))
    grid = df.select(snap).distinct().withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    return grid.join(per, [snap, "year"], "left").fillna(0, ["ksi_rows"])


def snapshot_places(df: DataFrame, snap: str, place: str, k: int = 5) -> DataFrame:
    """(snapshot, pos, place, n): the k places with most rows of each snapshot."""
    per = df.where(F.col(place).isNotNull()).groupBy(snap, place).agg(F.count("*").alias("n"))
    w = Window.partitionBy(snap).orderBy(F.desc("n"), place)
    return per.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select(snap, "pos", F.col(place).alias("place"), "n")


def compare_snapshots(a: DataFrame, b: DataFrame, cid: str, max_pct: float = 2.0) -> DataFrame:
    """Row and id differences of two snapshots with the acceptance decision. Ids are
    made distinct once per side and met in one full join."""
    ia = a.where(F.col(cid).isNotNull()).select(cid).distinct().withColumn("_a", F.lit(1))
    ib = b.where(F.col(cid).isNotNull()).select(cid).distinct().withColumn("_b", F.lit(1))
    d = ia.join(ib, cid, "full").agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))
    x = attach(attach(a.agg(F.count("*").alias("rows_a")), b.agg(F.count("*").alias("rows_b"))), d)
    pct = F.round(F.abs(F.col("rows_a") - F.col("rows_b")) / F.nullif(F.col("rows_a"), F.lit(0)) * 100, 4)
    return x.withColumn("pct_diff", pct).withColumn("decision", F.when(F.col("pct_diff") <= max_pct, "accept").otherwise("defer"))


def rows_by_year(a: DataFrame, b: DataFrame) -> DataFrame:
    ca = a.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n_a"))
    cb = b.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n_b"))
    x = ca.join(cb, "year", "full").fillna(0, ["n_a", "n_b"]).where("year IS NOT NULL")
    return x.withColumn("diff", F.col("n_a") - F.col("n_b")).withColumn(
        "pct_diff", F.round(F.abs(F.col("diff")) / F.nullif(F.col("n_a"), F.lit(0)) * 100, 2))


def expected_counts(actual: DataFrame, expected: DataFrame, tolerance: int) -> DataFrame:
    """(name, n, expected, ok)."""
    return expected.join(actual, "name", "left").withColumn("ok", F.coalesce(F.abs(F.col("n") - F.col("expected")) <= tolerance, F.lit(False)))


def claims(stated: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """YES within tolerance, NO beyond it, REVIEW when nothing was recomputed."""
    return stated.join(found, "claim", "left").withColumn(
        "match", F.when(F.col("found").isNull(), "REVIEW").when(F.abs(F.col("stated") - F.col("found")) <= tolerance, "YES").otherwise("NO"))


def valid_json(c: str) -> Column:
    """One complete JSON value and nothing after it: inside brackets it must parse
    to a list of exactly one item."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(c), F.lit("]")))
    return F.coalesce(F.size(wrapped.cast("array<variant>")) == 1, F.lit(False))


def export_violations(panel: DataFrame, json_cols: list[str], nid: str = "node_id") -> DataFrame:
    """(check, n_bad): district outside 0..9, unreadable JSON, repeated node id."""
    rows = panel.agg(
        F.count_if(~F.coalesce(F.col("council_district").between(0, 9), F.lit(False))).alias("district"),
        *[F.count_if(~valid_json(c)).alias(c) for c in json_cols])
    dup = panel.groupBy(nid).count().agg(F.count_if(F.col("count") > 1).alias("repeated_id"))
    names = ["district", *json_cols, "repeated_id"]
    return attach(rows, dup).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(n).alias("n_bad")) for n in names])).alias("r")).select("r.*")


def coverage(sites: DataFrame, contexts: dict[str, DataFrame], sid: str = "site_id") -> DataFrame:
    """(context, n_sites, n_with) over the listed sites."""
    x = sites.select(sid)
    for name, df in contexts.items():
        x = x.join(df.select(sid).distinct().withColumn(f"_{name}", F.lit(1)), sid, "left")
    one = x.agg(F.count("*").alias("n"), *[F.count(f"_{n}").alias(n) for n in contexts])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("context"), F.col("n").alias("n_sites"), F.col(n).alias("n_with"))
                                          for n in contexts])).alias("r")).select("r.*")


def catch_monotone(catch: DataFrame) -> DataFrame:
    """Catch rows that fall as the shortlist grows (one row per shortlist size)."""
    w = Window.orderBy("k")
    return catch.withColumn("prev", F.lag("caught").over(w)).where(F.col("caught") < F.col("prev"))


def rank_gaps(df: DataFrame, rank: str = "rank") -> DataFrame:
    """One row: ranks are 1..n without holes or repeats."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(rank).alias("n_distinct"), F.min(rank).alias("lo"), F.max(rank).alias("hi")
                  ).withColumn("ok", (F.col("n") == F.col("n_distinct")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n")))


def ksi_guard(df: DataFrame) -> DataFrame:
    """Rows of a fatal-only source; reporting them as KSI is an error."""
    return df.where(F.col("severity_scheme") != "ksi")
