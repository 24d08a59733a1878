"""Facility inspection records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from junctura.functions.records import THEMES, grade_for
from junctura.functions.text import lookup

MONTH_DAYS = 30.44


def inspection_stats(visits: DataFrame, order: list[str], fid: str = "facility_id") -> DataFrame:
    """One row per facility. Windows count back from the facility's own last visit.
    ``order`` lists the columns that order visits (date first). Two aggregations
    by facility, both with map-side partials; no facility's visits are gathered."""
    v = visits.where("date IS NOT NULL").withColumn("_k", F.struct(*order))
    kind = F.coalesce("type", F.lit("routine"))
    rec = F.struct("date", "type", "score", "grade")
    scored = F.col("score").isNotNull() & (kind == "routine")
    a = v.groupBy(fid).agg(
        F.count("*").alias("n_visits"), F.count_if(kind == "routine").alias("n_routine"),
        F.max_by(rec, "_k").alias("last"), F.count_if(F.col("closed")).alias("closures"),
        F.count_if(F.col("type") == "reinspection").alias("reinspections"),
        F.avg(F.when(scored, F.col("score"))).alias("mean_score"), F.count_if(scored).alias("_ns"),
        F.sum(F.when(scored, F.col("score"))).alias("_ss"),
        F.max_by("score", F.when(kind == "routine", F.col("_k"))).alias("_last_routine"),
        F.max_by("score", F.when(scored, F.col("_k"))).alias("_last_scored"))
    recent = v.join(a.select(fid, F.col("last.date").alias("_ld")), fid).where(
        F.datediff("_ld", "date") / MONTH_DAYS <= 36)
    b = recent.groupBy(fid).agg(F.sum(F.coalesce("major", F.lit(0))).alias("majors_36mo"),
                                F.sum(F.coalesce("minor", F.lit(0))).alias("minors_36mo"))
    base = (F.col("_ss") - F.col("_last_scored")) / F.nullif(F.col("_ns") - 1, F.lit(0))
    can = (F.col("_ns") - 1 >= 2) & F.col("_last_routine").isNotNull()
    trend = F.when(can & (F.col("_last_routine") <= base - 5), "worsening").when(
        can & (F.col("_last_routine") >= base + 5), "improving").otherwise("steady")
    return a.join(b, fid, "left").select(
        fid, "n_visits", "n_routine", F.col("last.date").alias("last_date"), F.col("last.type").alias("last_type"),
        F.col("last.score").alias("last_score"), F.coalesce(F.col("last.grade"), grade_for(F.col("last.score"))).alias("last_grade"),
        "majors_36mo", "minors_36mo", "closures", "reinspections", "mean_score", trend.alias("trend"))


def theme_counts(violations: DataFrame, fid: str = "facility_id") -> DataFrame:
    """Violations per facility and theme with the place of each theme, worst first."""
    theme = F.when(F.col("theme").isin(*THEMES), F.col("theme")).otherwise("other")
    g = violations.groupBy(fid, theme.alias("theme")).agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "major").alias("major"), F.max("date").alias("last"))
    w = Window.partitionBy(fid).orderBy(F.col("major").desc(), F.col("n").desc(), F.col("last").desc(), "theme")
    return g.withColumn("label", lookup(THEMES, F.col("theme"))).withColumn("pos", F.row_number().over(w))


# Base priority and short name of each theme's advice.
THEME_ADVICE = {
    "vermin": (98, "Pests"), "temperature": (95, "Food temperatures"), "handwashing": (92, "Hand washing"),
    "hygiene": (85, "Employee hygiene"), "sanitizing": (80, "Cleaning"), "storage": (75, "Food storage"),
    "equipment": (60, "Equipment"), "plumbing": (60, "Plumbing and water"), "labeling": (40, "Labels and records"),
    "other": (30, "Other findings"),
}


def facility_patterns(stats: DataFrame, themes: DataFrame, fid: str = "facility_id") -> DataFrame:
    """(facility, key, pattern, priority) from the record: themes that are major or
    repeated, past closures, a recent B or C, repeated reinspections."""
    pr = lookup({k: v[0] for k, v in THEME_ADVICE.items()}, F.col("theme"))
    nm = lookup({k: v[1] for k, v in THEME_ADVICE.items()}, F.col("theme"))
    a = themes.where("major > 0 OR n >= 2").select(
        fid, F.col("theme").alias("key"), nm.alias("pattern"), (pr + F.least(F.col("major"), F.lit(3))).cast("int").alias("priority"))
    rules = F.array_compact(F.array(
        F.when(F.col("closures") > 0, F.struct(F.lit("closed").alias("key"), F.lit("Closed before").alias("pattern"), F.lit(90).alias("priority"))),
        F.when(F.col("last_grade") != "A", F.struct(F.lit("grade").alias("key"), F.lit("Recent B or C").alias("pattern"), F.lit(70).alias("priority"))),
        F.when(F.col("reinspections") >= 2, F.struct(F.lit("repeat").alias("key"), F.lit("Repeat findings").alias("pattern"), F.lit(65).alias("priority")))))
    b = stats.select(fid, F.explode(rules).alias("r")).select(fid, "r.*")
    return a.unionByName(b)


def lead_pattern(patterns: DataFrame, fid: str = "facility_id") -> DataFrame:
    return patterns.groupBy(fid).agg(F.max_by("pattern", F.struct(F.col("priority"), F.col("key"))).alias("pattern"))


def facility_csv(facilities: DataFrame, stats: DataFrame, themes: DataFrame, patterns: DataFrame,
                 fid: str = "facility_id") -> DataFrame:
    """The spreadsheet row of each facility."""
    top = themes.where("pos = 1").select(fid, F.col("label").alias("top_theme"))
    return facilities.join(stats, fid, "left").join(top, fid, "left").join(lead_pattern(patterns, fid), fid, "left")
