"""From events and sites to the candidate panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from junctura.config import Params
from junctura.functions.records import is_ksi
from junctura.operators.proximity import nearest_within, pairs_within
from junctura.operators.ranking import global_quantile
from junctura.session import attach


def closed(col: str, start, end) -> Column:
    """[start, end], the panel form of a window."""
    return (F.col(col) >= F.lit(start)) & (F.col(col) <= F.lit(end))


def half_open(col: str, start, end) -> Column:
    """[start, end), the form the snap counts use."""
    return (F.col(col) >= F.lit(start)) & (F.col(col) < F.lit(end))


def snap(events: DataFrame, sites: DataFrame, radius: float, mode: str = "nearest_within_buffer",
         sid: str = "site_id") -> DataFrame:
    """Event to site assignment. The site set is the caller's: each stage snaps to
    its own universe, so an assignment is never shared between different sets."""
    if mode == "nearest_within_buffer":
        return nearest_within(events, sites, radius, qid=sid)
    if mode == "all_within_buffer":
        return pairs_within(events, sites, radius, place_cols=[sid])
    raise ValueError(f"unknown assignment mode: {mode!r}")


def surface_only(sites: DataFrame) -> DataFrame:
    return sites.where(F.col("is_surface")) if "is_surface" in sites.columns else sites


def window_counts(assigned: DataFrame, p: Params, sid: str = "site_id") -> DataFrame:
    """KSI_feat, KSI_label, crashes_feat per site from one assignment: the three
    counts share the site set, and an event's assignment does not depend on the
    other events, so one snap serves all."""
    w = p.windows
    feat, lab = closed("date", w.feature_start, w.feature_end), closed("date", w.label_start, w.label_end)
    ksi = is_ksi(F.col("severity"))
    return assigned.groupBy(sid).agg(
        F.count_if(feat & ksi).alias("KSI_feat"), F.count_if(lab & ksi).alias("KSI_label"),
        F.count_if(feat).alias("crashes_feat"))


def eligible(panel: DataFrame, p: Params, mode: str = "city") -> DataFrame:
    """Sites below the screen (city), or the older rule (ksi_legacy)."""
    if mode == "city":
        return panel.where(F.col("crashes_feat") < p.screen_min)
    if mode == "ksi_legacy":
        cut = global_quantile(panel, "KSI_feat", 1 - p.legacy_top_share)
        return (attach(panel, cut)
                .where((F.col("KSI_feat") < p.legacy_max_ksi) & (F.col("KSI_feat") <= F.col("q_value"))).drop("q_value"))
    raise ValueError(f"unknown candidate screen: {mode!r}")


def with_labels(panel: DataFrame) -> DataFrame:
    """Binary readouts; ``y_primary`` is the evaluation operating point (y is a coordinate)."""
    return panel.withColumns({
        "y_ge1": (F.col("KSI_label") >= 1).cast("int"), "y_ge2": (F.col("KSI_label") >= 2).cast("int"),
        "y_primary": (F.col("KSI_label") >= 2).cast("int")})


def full_panel(events: DataFrame, sites: DataFrame, p: Params, sid: str = "site_id",
               mode: str = "nearest_within_buffer") -> DataFrame:
    """All surface sites with their counts (zeros included)."""
    nodes = surface_only(sites)
    counts = window_counts(snap(events, nodes, p.buffer_m, mode, sid), p, sid)
    return nodes.join(counts, sid, "left").fillna(0, ["KSI_feat", "KSI_label", "crashes_feat"])


def candidate_panel(events: DataFrame, sites: DataFrame, p: Params, sid: str = "site_id",
                    screen: str = "city") -> DataFrame:
    return with_labels(eligible(full_panel(events, sites, p, sid), p, screen))


def buffer_sweep(events: DataFrame, sites: DataFrame, p: Params, sid: str = "site_id") -> DataFrame:
    """Label histogram at each radius. One nearest join at the largest radius
    answers all of them: the nearest site within r is the nearest site overall, if
    that one is within r."""
    w = p.windows
    lab = events.where(closed("date", w.label_start, w.label_end) & is_ksi(F.col("severity")))
    near = nearest_within(lab, sites, max(p.sweep_radii_m), qid=sid).select(sid, "dist")
    per = near.groupBy(sid).agg(*[F.count_if(F.col("dist") <= r).alias(f"r{i}") for i, r in enumerate(p.sweep_radii_m)])
    total = sites.agg(F.count("*").alias("n_candidates"))
    one = per.agg(*[F.count_if(F.col(f"r{i}") == v).alias(f"r{i}_{v}") for i in range(len(p.sweep_radii_m)) for v in (1, 2)],
                  *[F.count_if(F.col(f"r{i}") >= 3).alias(f"r{i}_3") for i in range(len(p.sweep_radii_m))])
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(r)).alias("radius_m"), F.lit(round(r / (1200.0 / 3937.0), 2)).alias("buf_ft"),
                 *[F.col(f"r{i}_{v}").alias(f"d{v}") for v in (1, 2, 3)]) for i, r in enumerate(p.sweep_radii_m)])).alias("s")
    return attach(one, total).select("n_candidates", rows).select(
        "s.radius_m", "s.buf_ft", "n_candidates",
        (F.col("s.d1") + F.col("s.d2") + F.col("s.d3")).alias("positives_ge1"),
        (F.col("s.d2") + F.col("s.d3")).alias("positives_ge2"),
        (F.col("n_candidates") - F.col("s.d1") - F.col("s.d2") - F.col("s.d3")).alias("dist_0"),
        F.col("s.d1").alias("dist_1"), F.col("s.d2").alias("dist_2"), F.col("s.d3").alias("dist_3p"))


def scope_summary(panel: DataFrame, candidates: DataFrame, scope: Column, events: DataFrame | None = None) -> DataFrame:
    """One row per scope: nodes by class, events, candidates and label histogram. With
    ``events`` (scope column ``scope``, severity, state_hwy) also KSI and their highway share."""
    a = panel.groupBy(scope.alias("scope")).agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("is_surface")).alias("n_surface"), F.count_if(F.col("is_freeway")).alias("n_freeway"),
        F.count_if(F.col("is_trunk") & ~F.col("is_freeway")).alias("n_trunk"),
        F.sum("crashes_feat").alias("crashes_feat"), F.sum("KSI_feat").alias("KSI_feat"))
    b = candidates.groupBy(scope.alias("scope")).agg(
        F.count("*").alias("n_candidates"), F.count_if(F.col("KSI_label") == 0).alias("label_0"),
        F.count_if(F.col("KSI_label") == 1).alias("label_1"), F.count_if(F.col("KSI_label") >= 2).alias("label_2p"))
    j = a.join(b, "scope", "left").fillna(0)
    if events is not None:
        ksi = is_ksi(F.col("severity"))
        h = events.groupBy("scope").agg(F.count_if(ksi).alias("n_ksi"), F.count_if(ksi & (F.col("state_hwy") == "Y")).alias("_h"))
        j = j.join(h, "scope", "left").fillna(0, ["n_ksi", "_h"]).withColumn("pct_ksi_highway", F.round(F.col("_h") * 100 / F.nullif(F.col("n_ksi"), F.lit(0)), 2)).drop("_h")
    return j.withColumn("decision", F.when(F.col("label_1") + F.col("label_2p") >= 300, "adequate").otherwise("widen"))


def prune_constant(df: DataFrame, wanted: list[str]) -> list[str]:
    """Feature names that exist and vary (sample variance above zero). The driver
    reads one row with one number per column."""
    have = [c for c in wanted if c in df.columns]
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in have]).first()
    return [c for c in have if row[c] is not None and row[c] > 0]


def tier_inputs(events: DataFrame, sites: DataFrame, p: Params, sid: str = "site_id") -> tuple[DataFrame, DataFrame]:
    """(known, screen) tiers over all sites: known has a KSI in the feature window,
    screen reaches the threshold in the last feature year."""
    w = p.windows
    s = snap(events, sites, p.buffer_m, sid=sid)
    last_year = half_open("date", w.cutoff.replace(year=w.cutoff.year - 1), w.cutoff)
    hist = half_open("date", w.feature_start, w.cutoff)
    c = s.groupBy(sid).agg(
        F.count_if(closed("date", w.feature_start, w.feature_end) & is_ksi(F.col("severity"))).alias("ksi_history"),
        F.count_if(hist).alias("crashes_history"), F.count_if(last_year).alias("screen_count"))
    return (c.where("ksi_history >= 1").select(sid, "ksi_history", "crashes_history"),
            c.where(F.col("screen_count") >= p.screen_min).select(sid, "screen_count"))


def screen_overlap(panel: DataFrame, assigned: DataFrame, windows: dict[str, tuple], any_year: tuple[int, int],
                   minimum: int, rank: str, positive: str, ks: tuple[int, ...], sid: str = "site_id") -> DataFrame:
    """Model shortlist against the screen in several windows: how many positives
    the shortlist catches and how many of those each screen would miss."""
    years = range(any_year[0], any_year[1] + 1)
    c = assigned.groupBy(sid).agg(
        *[F.count_if(half_open("date", a, b)).alias(f"c_{n}") for n, (a, b) in windows.items()],
        F.greatest(F.lit(0), *[F.count_if(F.year("date") == y) for y in years]).alias("c_any_single_year"))
    names = [*windows, "any_single_year"]
    x = panel.join(c, sid, "left").fillna(0, [f"c_{n}" for n in names])
    hit = F.col(positive) >= 1
    flags = {n: F.col(f"c_{n}") >= minimum for n in names}
    one = x.agg(*[F.count_if(hit & (F.col(rank) <= k)).alias(f"m_{k}") for k in ks],
                *[F.count_if(hit & (F.col(rank) <= k) & ~flags[n]).alias(f"u_{k}_{n}") for k in ks for n in names],
                *[F.count_if(flags[n]).alias(f"f_{n}") for n in names])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("top_k"), F.lit(n).alias("screen"), F.col(f"m_{k}").alias("model_catches"),
                 F.col(f"u_{k}_{n}").alias("model_unique"), F.col(f"f_{n}").alias("n_flagged"))
        for k in ks for n in names])).alias("r")).select("r.*")
