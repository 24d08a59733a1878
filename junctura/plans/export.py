"""Ranked, nested, enriched export rows and their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from junctura.functions.geo import point_key
from junctura.functions.text import lookup

# Label templates as (format, scale), printf style.
LABELS = {
    "years_since_last_crash": ("%.1f years since last crash", 1.0),
    "changepoint_prob": ("%.0f%% structural break probability", 100.0),
    "distinct_crash_days_72mo": ("%.0f distinct crash days (72 months)", 1.0),
    "crashes_72mo": ("%.0f crashes in last 72 months", 1.0),
    "crashes_36mo": ("%.0f crashes in last 36 months", 1.0),
    "ewma_crashes": ("EWMA crash rate %.1f", 1.0),
    "mann_kendall_tau": ("Mann-Kendall trend tau = %.2f", 1.0),
    "crash_trend_slope": ("Crash trend slope %+.2f/yr", 1.0),
    "emergence_velocity": ("Emergence velocity %+.1f", 1.0),
    "emergence_acceleration": ("Emergence acceleration %+.2f", 1.0),
    "momentum_ratio": ("Late/early crash ratio %.2f", 1.0),
    "ped_crashes_72mo": ("%.0f pedestrian crashes (72 months)", 1.0),
    "bike_crashes_72mo": ("%.0f bicycle crashes (72 months)", 1.0),
    "broadside_72mo": ("%.0f broadside crashes (72 months)", 1.0),
    "left_turn_72mo": ("%.0f left-turn crashes (72 months)", 1.0),
    "dui_72mo": ("%.0f DUI crashes (72 months)", 1.0),
    "night_72mo": ("%.0f night crashes (72 months)", 1.0),
    "worst_severity_72mo": ("Worst severity %.0f", 1.0),
    "covid_period_share": ("COVID-period crash share %.2f", 1.0),
    "ped_row_violation_72mo": ("%.0f ped right-of-way violations", 1.0),
}

# Label patterns and their plain wording, first match wins. {1}, {2}
# are groups, {y2} a month count as years, {n1} a group with singular or plural.
PLAIN = [
    (r"ewma crash rate\s*([\d.]+)", "A steady crash rate, about {1} a year, weighted toward recent years"),
    (r"([\d.]+)\s*years? since last crash", "{since1}"),
    (r"(\d+)\s*distinct crash days \((\d+) months\)", "Crashes on {1} separate days in {y2} years"),
    (r"(\d+)\s*crashes in last (\d+) months", "{1} crashes in the last {y2} years"),
    (r"(\d+)\s*left-turn crashes? \((\d+) months\)", "{n1:left-turn crash} in {y2} years"),
    (r"(\d+)\s*night crashes? \((\d+) months\)", "{n1:crash} after dark in {y2} years"),
    (r"(\d+)\s*bicycle crashes? \((\d+) months\)", "{n1:crash} involving a bike in {y2} years"),
    (r"(\d+)\s*pedestrian crashes? \((\d+) months\)", "{n1:crash} involving someone on foot in {y2} years"),
    (r"(\d+)\s*broadside crashes? \((\d+) months\)", "{n1:side-impact crash} in {y2} years"),
    (r"\bdui\b|alcohol", "Alcohol was involved in crashes here"),
    (r"(\d+)% structural break probability", "The crash rate jumped from its earlier level ({1}% likely)"),
    (r"crash trend slope \+", "Crashes rising year over year"),
    (r"mann.?kendall trend tau = -", "Crashes falling year over year"),
    (r"worst severity\s*([\d.]+)", "Past crashes here caused injuries"),
    (r"covid", "The crash pattern shifted in the pandemic years"),
    (r"last crash under a year ago", "A crash within the past year"),
    (r"last crash ~?\s*([\d.]+)\s*years? ago", "{ago1}"),
    (r"recent crash rate ([\d.]+)/yr", "About {1} crashes a year recently"),
    (r"rising crash-rate trend", "Crash rate rising"),
    (r"accelerating crash trend", "Crashes speeding up"),
    (r"^(\d+)-(?:leg|way) intersection$", "{1} roads meet here"),
    (r"^major arterial$", "On a major arterial, a main through road"),
    (r"^secondary arterial$", "On a secondary arterial, a busy through road"),
    (r"^arterial$", "On an arterial, a through road"),
    (r"~\s*(\d+) lanes", "About {1} lanes across"),
    (r"transit stop (\d+) m away", "{stop1}"),
    (r"stop-controlled", "Stop signs, no signal"),
    (r"(\d+) km/h speed limit", "{mph1} mph speed limit"),
    (r"(\d+) intersections within (\d+) m", "{1} intersections within {2} m, a dense grid"),
    (r"(\d+) crashes within (\d+) m", "{1} crashes within {2} m on nearby roads"),
    (r"(\d+) m to nearest high-crash site", "{1} m from a corner the City already reviews"),
    (r"([\d.]+)% grade", "A {1}% slope"),
    (r"trend|slope|mann.?kendall", "A crash trend over the years"),
]

# Pattern rules (key, label pattern, priority, name, and what of the label's
# number counts: ``per`` it adds to the priority, at most ``cap``; ``least`` and ``most``
# it must reach or not pass; ``mph`` it is converted first). First match wins.
PATTERNS = [
    ("ped", r"(\d+)\s*pedestrian crashes? \((\d+) months\)", 100, "People on foot", {"per": 1}),
    ("bike", r"(\d+)\s*bicycle crashes? \((\d+) months\)", 90, "Bikes", {"per": 1}),
    ("left", r"(\d+)\s*left-turn crashes? \((\d+) months\)", 80, "Left turns", {"per": 1}),
    ("night", r"(\d+)\s*night crashes? \((\d+) months\)", 70, "After dark", {"per": 1}),
    ("broadside", r"(\d+)\s*broadside crashes? \((\d+) months\)", 85, "Side impacts", {"per": 1}),
    ("ped", r"transit stop (\d+) m away", 95, "People on foot", {"most": 250}),
    ("speed", r"(\d+) km/h speed limit", 78, "Fast road", {"mph": True, "least": 40}),
    ("wide", r"~\s*(\d+) lanes", 72, "Wide crossing", {"least": 5}),
    ("stop", r"stop-controlled", 66, "Stop signs, no signal", {}),
    ("complex", r"^(\d+)-(?:leg|way) intersection$", 60, "Complex corner", {"least": 5}),
    ("days", r"(\d+)\s*distinct crash days \((\d+) months\)", 40, "Crashes are routine here", {"per": 1, "cap": 30, "least": 6}),
    ("days", r"recent crash rate ([\d.]+)/yr", 40, "Crashes are routine here", {"per": 4, "cap": 30, "least": 1}),
    ("jump", r"(\d+)% structural break probability", 35, "Crash rate jumped", {"least": 50}),
    ("trend", r"crash trend slope \+([\d.]+)/yr|rising crash-rate trend|accelerating crash trend", 30, "Crashes rising", {}),
    ("cluster", r"(\d+) crashes within (\d+) m", 28, "Crashes along this stretch", {"least": 5}),
    ("hotspot", r"(\d+) m to nearest high-crash site", 26, "Near a corner the City already reviews", {"most": 300}),
    ("recent", r"([\d.]+)\s*years? since last crash|last crash under a year ago", 20, "Recent crash", {"most": 0.999999}),
]
WALK_M = 250
SCHOOL_M = 300
FILTER_KEYS = ("ped", "bike", "left", "night", "speed", "wide", "stop", "complex", "school")

# Measures (key, low cost, high cost, patterns, needs).
MEASURES = [
    ("lpi", 1000, 5000, ("ped", "school"), "signals"),
    ("rrfb", 15000, 40000, ("ped",), "unsignalised"),
    ("refuge", 10000, 40000, ("ped", "wide", "school"), None),
    ("crosswalk", 5000, 30000, ("ped", "night", "wide", "school"), None),
    ("protectedLeft", 10000, 60000, ("left",), "signals"),
    ("turnLane", 20000, 150000, ("left",), None),
    ("backplates", 1000, 5000, ("night", "broadside", "days", "jump", "trend"), "signals"),
    ("yellow", 500, 2000, ("broadside",), "signals"),
    ("lighting", 5000, 30000, ("night",), None),
    ("bike", 5000, 25000, ("bike",), None),
    ("roadDiet", 25000, 200000, ("days", "jump", "trend", "speed", "wide", "cluster"), None),
    ("feedback", 5000, 15000, ("speed", "school"), None),
    ("allway", 2000, 10000, ("stop", "complex"), "unsignalised"),
]
# Fixed value: the measure that closes every list, outside the cost range.
REVIEW = ("review", 2000, 8000)
PATTERN_ORDER = ("ped", "school", "bike", "left", "night", "broadside", "speed", "wide", "stop", "complex", "days",
                 "jump", "trend", "cluster", "hotspot")


def display_label(name: Column, value: Column) -> Column:
    """Label of a feature value; unknown features fall back to "name: value"."""
    fmt = lookup({k: v[0] for k, v in LABELS.items()}, name)
    scale = lookup({k: v[1] for k, v in LABELS.items()}, name)
    return F.coalesce(F.when(fmt.isNotNull(), F.call_function("format_string", fmt, value * scale)), F.format_string("%s: %.2f", name, value))


def top_contributions(df: DataFrame, contributions: dict[str, Column], raw: dict[str, Column], sid: str, k: int = 5) -> DataFrame:
    """The k largest contributions per row by absolute size, labelled, as a nested
    column. The array has one entry per feature, so sorting it is bounded."""
    items = F.array(*[F.struct((-F.abs(contributions[n])).alias("o"), F.lit(n).alias("feature_name"),
                               contributions[n].alias("value"), raw[n].cast("double").alias("raw_value")) for n in contributions])
    top = F.slice(F.array_sort(items), 1, k)
    return df.select(sid, F.transform(top, lambda s: F.struct(
        s["feature_name"].alias("feature_name"), s["value"].alias("value"), s["raw_value"].alias("raw_value"),
        display_label(s["feature_name"], s["raw_value"]).alias("display_label"))).alias("top_features"))


def _render(template: str, label: Column, rx: str) -> Column:
    import re
    g = lambda i: F.regexp_extract(label, f"(?i){rx}", int(i))
    num = lambda i: g(i).try_cast("double")
    y, n = num(1), F.floor(num(1) + 0.5)
    if template == "{ago1}":
        return F.when(n <= 1, "The last crash was about a year ago").otherwise(F.concat(F.lit("The last crash was about "), n.cast("string"), F.lit(" years ago")))
    if template == "{stop1}":
        return F.concat(F.lit("A transit stop "), g(1), F.when(y <= WALK_M, " m away, so people cross here to reach it").otherwise(" m away"))
    if template == "{since1}":
        return F.when(y < 1, "A crash within the past year").when(n <= 1, "The last crash was about a year ago").otherwise(
            F.concat(F.lit("The last crash was about "), n.cast("string"), F.lit(" years ago")))
    parts = []
    for piece in re.split(r"(\{[^}]*\})", template):
        if not piece.startswith("{"):
            parts.append(F.lit(piece))
        elif piece[1] == "y":
            parts.append(F.floor(num(piece[2]) / 12 + 0.5).cast("string"))
        elif piece[1] == "n":
            word = piece[4:-1]  # the plural is a bare "s", as in the published labels
            parts.append(F.concat(g(piece[2]), F.lit(" "), F.when(num(piece[2]) == 1, word).otherwise(word + "s")))
        elif piece.startswith("{mph"):
            parts.append((F.floor(num(piece[4]) * 0.621371 / 5 + 0.5) * 5).cast("string"))
        else:
            parts.append(g(piece[1]))
    return F.concat(*parts)


def plain_language(labels: DataFrame, col: str = "display_label") -> DataFrame:
    """Distinct labels with their plain wording and whether a rule matched. Labels
    repeat across sites, so each is rewritten once and joined back by the caller."""
    d = labels.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n_sites"))
    c = F.col(col)
    text = None
    for rx, tpl in PLAIN:
        hit = c.rlike(f"(?i){rx}")
        text = F.when(hit, _render(tpl, c, rx)) if text is None else text.when(hit, _render(tpl, c, rx))
    return d.withColumn("plain", text.otherwise(c)).withColumn("matched", F.coalesce(text.isNotNull(), F.lit(False)))


def site_patterns(labels: DataFrame, schools: DataFrame | None = None, sid: str = "site_id") -> DataFrame:
    """(site, key, pattern, priority): the first rule a label meets. Of several labels with
    one key the first by ``pos`` counts (without positions the one that matters most)."""
    c = F.col("display_label")
    e = None
    for key, rx, base, name, o in PATTERNS:
        n = F.coalesce(F.regexp_extract(c, f"(?i){rx}", 1).try_cast("double"), F.lit(0.0))
        n = F.floor(n * 0.621371 / 5 + 0.5) * 5 if o.get("mph") else n
        extra = F.floor(n * o["per"] + 0.5) if "per" in o else F.lit(0)
        pr = F.lit(base) + (F.least(extra, F.lit(o["cap"])) if "cap" in o else extra)
        item = F.struct(F.lit(key).alias("key"), F.lit(name).alias("pattern"), pr.cast("int").alias("priority"))
        item = item if "least" not in o else F.when(n >= o["least"], item)
        item = item if "most" not in o else F.when(n <= o["most"], item)
        hit = c.rlike(f"(?i){rx}")
        e = F.when(hit, item) if e is None else e.when(hit, item)
    # Labels repeat across sites: each distinct one is tested against the rules once.
    # A generator, not a filter on the item, which would be pushed below and evaluate all rules again.
    ruled = labels.select("display_label").distinct().select("display_label", F.explode(F.array_compact(F.array(e))).alias("r"))
    place = F.col("pos") if "pos" in labels.columns else F.lit(0)
    one = labels.select(sid, "display_label", place.alias("_pos")).join(ruled, "display_label").select(sid, "_pos", "r.*")
    if schools is not None:
        one = one.unionByName(schools.where(F.col("school_m") <= SCHOOL_M).select(
            sid, F.lit(0).alias("_pos"), F.lit("school").alias("key"), F.lit("Near a school").alias("pattern"), F.lit(98).alias("priority")))
    first = F.min_by(F.struct("pattern", "priority"), F.struct(F.col("_pos"), -F.col("priority")))
    return one.groupBy(sid, "key").agg(first.alias("s")).select(sid, "key", "s.*")


def lead_patterns(patterns: DataFrame, sid: str = "site_id") -> DataFrame:
    return patterns.groupBy(sid).agg(F.max_by(F.struct("key", "pattern"), F.struct("priority", "key")).alias("s")).select(sid, "s.*")


def measures_for(patterns: DataFrame, control: DataFrame, sid: str = "site_id", n: int = 3) -> DataFrame:
    """Up to n measures per site in pattern order, compatible with its control. The
    rule table is a fixed literal; a site has at most one row per pattern."""
    spark = patterns.sparkSession
    rows = [(PATTERN_ORDER.index(p), p, i, k, lo, hi, need) for i, (k, lo, hi, ps, need) in enumerate(MEASURES) for p in ps]
    rules = spark.createDataFrame(rows, "p_ord int, key string, m_ord int, measure string, lo int, hi int, needs string")
    ctl = F.col("control")
    ok = (F.col("needs").isNull() | ctl.isNull()
          | ~(((F.col("needs") == "signals") & ctl.isin("stop", "yield", "none")) | ((F.col("needs") == "unsignalised") & (ctl == "signals"))))
    x = patterns.select(sid, "key").join(F.broadcast(rules), "key").join(control, sid, "left").where(ok)
    best = x.groupBy(sid, "measure", "lo", "hi").agg(F.min(F.struct("p_ord", "m_ord")).alias("o"))
    w = Window.partitionBy(sid).orderBy("o")
    return best.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).select(sid, "pos", "measure", "lo", "hi")


def with_review(measures: DataFrame, sites: DataFrame, sid: str = "site_id") -> DataFrame:
    """Every site's measures and, after them, the review that closes each list."""
    last = measures.groupBy(sid).agg(F.max("pos").alias("_n"))
    kinds = dict(measures.dtypes)
    closing = sites.select(sid).join(last, sid, "left").select(
        sid, (F.coalesce("_n", F.lit(0)) + 1).cast(kinds["pos"]).alias("pos"), F.lit(REVIEW[0]).alias("measure"), F.lit(REVIEW[1]).alias("lo"), F.lit(REVIEW[2]).alias("hi"))
    return measures.unionByName(closing)


def cost_range(measures: DataFrame, sid: str = "site_id") -> DataFrame:
    """Sums of the measures' costs; the review is not part of them."""
    real = measures.where(F.col("measure") != REVIEW[0])
    return real.groupBy(sid).agg(F.sum("lo").alias("cost_lo"), F.sum("hi").alias("cost_hi"), F.count("*").alias("n_measures"))


def export_rows(panel: DataFrame, sid: str = "site_id") -> DataFrame:
    """Casts, flags and rounding of the export panel."""
    return panel.select(
        sid, F.coalesce("osm_id", F.lit(0)).cast("bigint").alias("node_id"), "lon", "lat",
        F.col("score").cast("double").alias("tweedie_score"), "percentile", "rank", "council_district",
        (F.coalesce("KSI_label", F.lit(0)) >= 1).alias("is_known_emergent"), "oof_rank",
        (F.coalesce("crashes_72mo", F.lit(0)) > 0).alias("is_crash_active"),
        F.round(F.coalesce("crashes_72mo", F.lit(0))).cast("bigint").alias("crashes_training"))


def listed(panel: DataFrame, n: int) -> DataFrame:
    """Top n plus every emergent site."""
    return panel.where((F.col("rank") <= n) | F.col("is_known_emergent"))


def feature_lines(rows: DataFrame, props: list[str]) -> DataFrame:
    """One GeoJSON feature per line; absent values are null, never NaN."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if dict(rows.dtypes)[c] in ("double", "float") else F.col(c) for c in props]
    geom = F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 6), F.round("lat", 6)).alias("coordinates"))
    feat = F.struct(F.lit("Feature").alias("type"), geom.alias("geometry"), F.struct(*clean).alias("properties"))
    return rows.select("rank", F.to_json(feat, {"ignoreNullFields": "false"}).alias("value"))


def point_context(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumn("point_key", point_key(F.col(lat), F.col(lon)))


def shown(df: DataFrame, threshold: int, districts: list[int] = (), types: list[str] = (), pattern: str | None = None,
          patterns_col: str = "patterns") -> DataFrame:
    """The one "shown" predicate: rank, districts, types, pattern or rising trend."""
    x = df.where(F.col("rank") <= threshold)
    if districts:
        x = x.where(F.col("council_district").isin(*districts))
    if types:
        x = x.where(F.coalesce("facility_type", F.lit("other")).isin(*types))
    if pattern == "rising":
        x = x.where(F.col("trend") == "rising")
    elif pattern:
        x = x.where(F.array_contains(patterns_col, pattern))
    return x


def facet_counts(df: DataFrame, array_col: str, key: str = "key") -> DataFrame:
    return df.select(F.explode(array_col).alias(key)).groupBy(key).agg(F.count("*").alias("n"))
