"""Tiered list, export rows, labels, patterns, measures, search, shown (W9, T2, T3, K, P15, P16, P21, A21-A23, A33, A34, A40, F14)."""

from pyspark.sql import functions as F

from junctura.catalog import query, views as V
from junctura.catalog.views import sql
from junctura.catalog.q_panel import _CSE, _RATES, candidate_events, rated
from junctura.config import TABLE_PARAMS as P
from junctura.functions import text as T
from junctura.operators import tiers
from junctura.operators.ranking import rank_and_percentile, ranked
from junctura.plans import export as X, history as H, panel as L
from junctura.session import attach, scratch_path, stage
from junctura.sources import sinks

_RA = "row_number() OVER (ORDER BY score_a DESC, site_id)"
_TIERS = """kn AS (SELECT site_id, count(*) FILTER (severity<=2 AND date BETWEEN '1995-01-01' AND '1999-12-31') AS kh, count(*) FILTER (date<'2000-01-01') AS ch FROM se GROUP BY 1 HAVING kh>=1),
  sc AS (SELECT site_id, count(*) AS n FROM se WHERE date>='1999-01-01' AND date<'2000-01-01' GROUP BY 1 HAVING count(*)>=2), pr AS (SELECT site_id, """ + _RA + """ AS mr FROM scored),
  cl AS MATERIALIZED (SELECT site_id, row_number() OVER (ORDER BY t, a, b, site_id) AS rank, ['known','screen','predicted'][t+1] AS source, mr AS model_rank, kh AS ksi_history, n AS screen_count, cs AS city_screen FROM (
   SELECT site_id, CASE WHEN k.site_id IS NOT NULL THEN 0 WHEN s.site_id IS NOT NULL THEN 1 ELSE 2 END AS t, CASE WHEN k.site_id IS NOT NULL THEN -kh WHEN s.site_id IS NOT NULL THEN -s.n ELSE mr END AS a,
   CASE WHEN k.site_id IS NOT NULL THEN -ch ELSE 0 END AS b, mr, coalesce(kh,0) AS kh, coalesce(s.n,0) AS n, s.site_id IS NOT NULL AS cs FROM pr FULL JOIN kn k USING (site_id) FULL JOIN sc s USING (site_id)))"""


def combined(s, d, n=1000):
    from dataclasses import replace
    known, screen = L.tier_inputs(V.events(s, d), V.sites(s, d), replace(P, screen_min=2))
    pred = ranked(V.scored(s, d).select("site_id", "score_a"), [("score_a", True), ("site_id", False)], "model_rank").drop("score_a")
    return tiers.combined_list(known, screen, pred, n, "site_id")


@query("w9_j15_combined_list", sql("se scored", "SELECT * FROM cl WHERE rank<=1000", _TIERS))
def _(s, d):
    return combined(s, d)


@query("a23_composition", sql("se scored", "SELECT source, count(c.site_id) AS n FROM (VALUES ('known'),('screen'),('predicted')) v(source) LEFT JOIN (SELECT * FROM cl WHERE rank<=1000) c USING (source) GROUP BY 1", _TIERS))
def _(s, d):
    return tiers.composition(combined(s, d))


@query("k4_a21_district_counts", sql("scored", f"""SELECT d::INT AS district, {', '.join(f"count(*) FILTER (rank<={k}) AS top_{k}_count" for k in (50, 100, 200, 500, 800, 1000))} FROM range(1,10) g(d) LEFT JOIN
  (SELECT council_district, {_RA} AS rank FROM scored) ON council_district=d GROUP BY 1"""))
def _(s, d):
    r = ranked(V.scored(s, d).select("site_id", "score_a", "council_district"), [("score_a", True), ("site_id", False)])
    return tiers.district_counts(r, "rank", "council_district")


@query("k5_metadata", sql("se scored", """SELECT to_json({'list':'combined','top_n':1000,'candidates':(SELECT count(*) FROM scored),'known':count(*) FILTER (source='known'),'screen':count(*) FILTER (source='screen'),'predicted':count(*) FILTER (source='predicted'),
  'caught_500':(SELECT count(*) FROM pr JOIN scored USING (site_id) WHERE hit=1 AND mr<=500)})::VARCHAR AS meta FROM cl WHERE rank<=1000""", _TIERS))
def _(s, d):
    comp = combined(s, d).agg(*[F.count_if(F.col("source") == t).alias(t) for t in tiers.SOURCES])
    t = V.scored(s, d)
    r = ranked(t.select("site_id", "score_a", (F.col("hit") == 1).alias("pos")), [("score_a", True), ("site_id", False)])
    c = tiers.catch_table(r, "rank", "pos", (500,)).select(F.col("caught").alias("caught_500"))
    n = t.agg(F.count("*").alias("candidates"))
    return attach(attach(n, comp), c).select(F.to_json(F.struct(
        F.lit("combined").alias("list"), F.lit(1000).alias("top_n"), "candidates", "known", "screen", "predicted", "caught_500")).alias("meta"))


def export_panel(s, d):
    t = rank_and_percentile(V.scored(s, d).withColumn("score", F.col("score_a")), "score", "site_id")
    t = t.withColumnsRenamed({"label": "KSI_label"}).withColumn("crashes_72mo", F.when(F.col("site_id") % 3 != 0, F.col("site_id") % 7))
    return X.export_rows(t.withColumn("oof_rank", F.when(F.col("site_id") % 4 != 0, F.col("rank"))))


_EXP = f"""xp AS MATERIALIZED (SELECT site_id, osm_id AS node_id, lon, lat, score_a AS tweedie_score, greatest(0,least(100,(1-(rank-1)/n::DOUBLE)*100)) AS percentile, rank, council_district, label>=1 AS is_known_emergent,
  CASE WHEN site_id%4<>0 THEN rank END AS oof_rank, coalesce(c,0)>0 AS is_crash_active, coalesce(c,0) AS crashes_training FROM (SELECT *, {_RA} AS rank, count(*) OVER () AS n, CASE WHEN site_id%3<>0 THEN site_id%7 END AS c FROM scored))"""


@query("p21_export_rows", sql("scored", "SELECT * REPLACE (round(percentile,6) AS percentile) FROM xp", _EXP))
def _(s, d):
    return export_panel(s, d).withColumn("percentile", F.round("percentile", 6))


@query("k3_p16_feature_lines", sql("scored", """SELECT rank, to_json({'type':'Feature','geometry':{'type':'Point','coordinates':[round(lon,6),round(lat,6)]},'properties':{'rank':rank,'council_district':council_district,'is_known_emergent':is_known_emergent,'oof_rank':oof_rank,'crashes_training':crashes_training}})::VARCHAR AS value
  FROM xp WHERE rank<=500 OR is_known_emergent""", _EXP))
def _(s, d):
    rows = X.listed(export_panel(s, d), 500)
    path = scratch_path(s, "features")
    sinks.write_feature_lines(X.feature_lines(rows, ["rank", "council_district", "is_known_emergent", "oof_rank", "crashes_training"]), path)
    lines = s.read.text(path)
    return lines.select(F.get_json_object("value", "$.properties.rank").cast("bigint").alias("rank"), "value")


def labelled(s, d):
    """Top five features per candidate with labels, the contribution being the
    scaled value."""
    c, ev = candidate_events(s, d)
    f = H.history_features(ev, c, P)
    names = ["crashes_72mo", "crashes_36mo", "ped_crashes_72mo", "bike_crashes_72mo", "broadside_72mo", "left_turn_72mo", "night_72mo", "distinct_crash_days_72mo"]
    contrib = {n: (F.col(n) * (1.0 + 0.01 * i) + 0.001 * (i + 1)) * (-1 if i % 2 else 1) for i, n in enumerate(names)}
    return X.top_contributions(f, contrib, {n: F.col(n) for n in names}, "site_id")


_N8 = ["crashes_72mo", "crashes_36mo", "ped_crashes_72mo", "bike_crashes_72mo", "broadside_72mo", "left_turn_72mo", "night_72mo", "distinct_crash_days_72mo"]
_FMT = ["' crashes in last 72 months'", "' crashes in last 36 months'", "' pedestrian crashes (72 months)'", "' bicycle crashes (72 months)'", "' broadside crashes (72 months)'", "' left-turn crashes (72 months)'", "' night crashes (72 months)'", "' distinct crash days (72 months)'"]
_T2 = _CSE + ", t5 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY abs(c) DESC, feature_name) AS pos FROM (" + " UNION ALL ".join(
    f"SELECT site_id, '{n}' AS feature_name, (coalesce({n},0)*(1.0::DOUBLE+0.01::DOUBLE*{i})+0.001::DOUBLE*{i + 1})*{-1 if i % 2 else 1} AS c, coalesce({n},0)||{f} AS display_label FROM cand LEFT JOIN cnt USING (site_id)"
    for i, (n, f) in enumerate(zip(_N8, _FMT))) + ")) WHERE pos<=5)"


def label_rows(s, d):
    t = stage(labelled(s, d), "labelled")
    return t.select("site_id", F.posexplode("top_features").alias("pos", "f")).select("site_id", (F.col("pos") + 1).alias("pos"), "f.*")


@query("t2_m14_top_contributions", sql("cand ev", "SELECT site_id, pos::INT AS pos, feature_name, round(c,6) AS value, display_label FROM t5", _T2))
def _(s, d):
    return label_rows(s, d).select("site_id", "pos", "feature_name", F.round("value", 6).alias("value"), "display_label")


@query("f14_plain_labels", sql("cand ev", """SELECT display_label, n_sites, CASE WHEN k LIKE 'crashes in last 72%' THEN n||' crashes in the last 6 years' WHEN k LIKE 'crashes in last 36%' THEN n||' crashes in the last 3 years'
  WHEN k LIKE 'pedestrian%' THEN n||CASE WHEN n=1 THEN ' crash' ELSE ' crashs' END||' involving someone on foot in 6 years' WHEN k LIKE 'bicycle%' THEN n||CASE WHEN n=1 THEN ' crash' ELSE ' crashs' END||' involving a bike in 6 years'
  WHEN k LIKE 'broadside%' THEN n||CASE WHEN n=1 THEN ' side-impact crash' ELSE ' side-impact crashs' END||' in 6 years' WHEN k LIKE 'left-turn%' THEN n||CASE WHEN n=1 THEN ' left-turn crash' ELSE ' left-turn crashs' END||' in 6 years'
  WHEN k LIKE 'night%' THEN n||CASE WHEN n=1 THEN ' crash' ELSE ' crashs' END||' after dark in 6 years' ELSE 'Crashes on '||n||' separate days in 6 years' END AS plain, true AS matched FROM (
  SELECT display_label, count(*) AS n_sites, split_part(display_label,' ',1)::INT AS n, substr(display_label, strpos(display_label,' ')+1) AS k FROM t5 GROUP BY 1)""", _T2))
def _(s, d):
    return X.plain_language(label_rows(s, d))


def patterned(s, d):
    schools = V.sites(s, d).select("site_id", (F.col("site_id") % 1000).alias("school_m"))
    return X.site_patterns(label_rows(s, d), schools)


_PAT = _T2 + """, pt AS MATERIALIZED (SELECT site_id, key, pattern, max(pr) AS priority FROM (SELECT site_id, CASE WHEN k LIKE 'pedestrian%' THEN 'ped' WHEN k LIKE 'bicycle%' THEN 'bike' WHEN k LIKE 'left-turn%' THEN 'left' WHEN k LIKE 'night%' THEN 'night'
  WHEN k LIKE 'broadside%' THEN 'broadside' WHEN k LIKE 'distinct%' AND n>=6 THEN 'days' END AS key, CASE WHEN k LIKE 'pedestrian%' THEN 'People on foot' WHEN k LIKE 'bicycle%' THEN 'Bikes' WHEN k LIKE 'left-turn%' THEN 'Left turns' WHEN k LIKE 'night%' THEN 'After dark'
  WHEN k LIKE 'broadside%' THEN 'Side impacts' WHEN k LIKE 'distinct%' AND n>=6 THEN 'Crashes are routine here' END AS pattern, CASE WHEN k LIKE 'pedestrian%' THEN 100+n WHEN k LIKE 'bicycle%' THEN 90+n WHEN k LIKE 'left-turn%' THEN 80+n WHEN k LIKE 'night%' THEN 70+n
  WHEN k LIKE 'broadside%' THEN 85+n WHEN k LIKE 'distinct%' THEN 40+least(n,30) END::INT AS pr FROM (SELECT site_id, split_part(display_label,' ',1)::INT AS n, substr(display_label, strpos(display_label,' ')+1) AS k FROM t5)
  UNION ALL SELECT site_id, 'school', 'Near a school', 98 FROM sites WHERE site_id%1000<=300) WHERE key IS NOT NULL GROUP BY ALL)"""


@query("a40_site_patterns", sql("cand ev sites", "SELECT * FROM pt", _PAT))
def _(s, d):
    return patterned(s, d)


@query("a40_lead_pattern", sql("cand ev sites", "SELECT site_id, key, pattern FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY priority DESC, key DESC) AS rn FROM pt) WHERE rn=1", _PAT))
def _(s, d):
    return X.lead_patterns(patterned(s, d))


@query("a33_pattern_facets", sql("cand ev sites", "SELECT key, count(*) AS n FROM pt GROUP BY 1", _PAT))
def _(s, d):
    arr = patterned(s, d).groupBy("site_id").agg(F.collect_set("key").alias("patterns"))  # at most one row per key
    return X.facet_counts(arr, "patterns")


_MEAS = _PAT + ", ru(measure,lo,hi,key,needs,m) AS (VALUES " + ",".join(
    f"('{k}',{lo},{hi},'{p}',{'NULL' if need is None else repr(need)},{i})" for i, (k, lo, hi, ps, need) in enumerate(X.MEASURES) for p in ps) + "), ord(key,p) AS (VALUES " + ",".join(
    f"('{k}',{i})" for i, k in enumerate(X.PATTERN_ORDER)) + """), ms AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY o) AS pos FROM (SELECT site_id, measure, lo, hi, min((p,m)) AS o FROM (SELECT pt.site_id, pt.key, ctl FROM pt
  JOIN (SELECT site_id, ['signals','stop','none',NULL][(site_id%4+1)::INT] AS ctl FROM sites) USING (site_id)) x JOIN ru USING (key) JOIN ord USING (key) WHERE needs IS NULL OR ctl IS NULL OR NOT ((needs='signals' AND ctl IN ('stop','yield','none')) OR (needs='unsignalised' AND ctl='signals')) GROUP BY ALL)) WHERE pos<=3)"""


def measured(s, d):
    ctl = V.sites(s, d).select("site_id", F.get(F.array(F.lit("signals"), F.lit("stop"), F.lit("none"), F.lit(None)), (F.col("site_id") % 4).cast("int")).alias("control"))
    return X.measures_for(patterned(s, d), ctl)


@query("a34_measures", sql("cand ev sites", "SELECT site_id, pos::INT AS pos, measure, lo, hi FROM ms", _MEAS))
def _(s, d):
    return measured(s, d)


@query("a34_cost_range", sql("cand ev sites", "SELECT site_id, sum(lo)::BIGINT AS cost_lo, sum(hi)::BIGINT AS cost_hi, count(*) AS n_measures FROM ms GROUP BY 1", _MEAS))
def _(s, d):
    return X.cost_range(measured(s, d))


# Labels of every kind (label, key, pattern, priority, condition, plain wording), as expressions of
# the site id that both engines read; a site has five of them.
_CT = lambda v: f"CAST({v} AS STRING)"
_MPH = "CAST(floor((30+site_id*7%60)*0.621371/5+0.5)*5 AS BIGINT)"
_RATE = "concat(CAST(CAST(floor(site_id%40/10) AS BIGINT) AS STRING), '.', CAST(site_id%10 AS STRING))"
_S = lambda v, w: f"concat({_CT(v)}, CASE WHEN {v}=1 THEN ' {w}' ELSE ' {w}s' END"
_KINDS = [
    (f"concat('Transit stop ', {_CT('site_id*37%600')}, ' m away')", "ped", "People on foot", "95", "site_id*37%600<=250", f"concat('A transit stop ', {_CT('site_id*37%600')}, CASE WHEN site_id*37%600<=250 THEN ' m away, so people cross here to reach it' ELSE ' m away' END)"),
    (f"concat({_CT('30+site_id*7%60')}, ' km/h speed limit')", "speed", "Fast road", "78", f"{_MPH}>=40", f"concat({_CT(_MPH)}, ' mph speed limit')"),
    (f"concat('~', {_CT('2+site_id%7')}, ' lanes')", "wide", "Wide crossing", "72", "2+site_id%7>=5", f"concat('About ', {_CT('2+site_id%7')}, ' lanes across')"),
    ("'Stop-controlled'", "stop", "Stop signs, no signal", "66", "true", "'Stop signs, no signal'"),
    (f"concat({_CT('2+site_id%6')}, '-leg intersection')", "complex", "Complex corner", "60", "2+site_id%6>=5", f"concat({_CT('2+site_id%6')}, ' roads meet here')"),
    (f"concat('Recent crash rate ', {_RATE}, '/yr')", "days", "Crashes are routine here", "40+least(CAST(floor((site_id%40)*4/10.0+0.5) AS INT),30)", "site_id%40>=10", f"concat('About ', {_RATE}, ' crashes a year recently')"),
    (f"concat({_CT('site_id*13%700')}, ' m to nearest high-crash site')", "hotspot", "Near a corner the City already reviews", "26", "site_id*13%700<=300", f"concat({_CT('site_id*13%700')}, ' m from a corner the City already reviews')"),
    (f"concat({_CT('site_id%12')}, ' crashes within 150 m')", "cluster", "Crashes along this stretch", "28", "site_id%12>=5", f"concat({_CT('site_id%12')}, ' crashes within 150 m on nearby roads')"),
    (f"concat({_CT('site_id%45')}, ' distinct crash days (72 months)')", "days", "Crashes are routine here", "40+least(site_id%45,30)", "site_id%45>=6", f"concat('Crashes on ', {_CT('site_id%45')}, ' separate days in 6 years')"),
    ("'Last crash under a year ago'", "recent", "Recent crash", "20", "true", "'A crash within the past year'"),
    (f"concat('Last crash ~', {_CT('1+site_id%5')}, ' years ago')", "none", "none", "0", "false", f"CASE WHEN site_id%5=0 THEN 'The last crash was about a year ago' ELSE concat('The last crash was about ', {_CT('1+site_id%5')}, ' years ago') END"),
    ("'Rising crash-rate trend'", "trend", "Crashes rising", "30", "true", "'Crash rate rising'"),
    ("'Accelerating crash trend'", "trend", "Crashes rising", "30", "true", "'Crashes speeding up'"),
    (f"concat({_CT('site_id%101')}, '% structural break probability')", "jump", "Crash rate jumped", "35", "site_id%101>=50", f"concat('The crash rate jumped from its earlier level (', {_CT('site_id%101')}, '% likely)')"),
    (f"concat({_CT('site_id%9')}, '.5% grade')", "none", "none", "0", "false", f"concat('A ', {_CT('site_id%9')}, '.5% slope')"),
    ("'Major arterial'", "none", "none", "0", "false", "'On a major arterial, a main through road'"),
    ("'Secondary arterial'", "none", "none", "0", "false", "'On a secondary arterial, a busy through road'"),
    ("'Arterial'", "none", "none", "0", "false", "'On an arterial, a through road'"),
    (f"concat({_CT('1+site_id%6')}, ' night crashes (72 months)')", "night", "After dark", "70+1+site_id%6", "true", f"{_S('1+site_id%6', 'crash')}, ' after dark in 6 years')"),
    (f"concat({_CT('1+site_id%6')}, ' pedestrian crashes (72 months)')", "ped", "People on foot", "100+1+site_id%6", "true", f"{_S('1+site_id%6', 'crash')}, ' involving someone on foot in 6 years')"),
    (f"concat({_CT('1+site_id%6')}, ' bicycle crashes (72 months)')", "bike", "Bikes", "90+1+site_id%6", "true", f"{_S('1+site_id%6', 'crash')}, ' involving a bike in 6 years')"),
    (f"concat({_CT('1+site_id%6')}, ' left-turn crashes (72 months)')", "left", "Left turns", "80+1+site_id%6", "true", f"{_S('1+site_id%6', 'left-turn crash')}, ' in 6 years')"),
    (f"concat({_CT('1+site_id%6')}, ' broadside crashes (72 months)')", "broadside", "Side impacts", "85+1+site_id%6", "true", f"{_S('1+site_id%6', 'side-impact crash')}, ' in 6 years')"),
    (f"concat({_CT('site_id%30')}, ' intersections within 400 m')", "none", "none", "0", "false", f"concat({_CT('site_id%30')}, ' intersections within 400 m, a dense grid')"),
]
_CTX = "kd AS (SELECT site_id, j+1 AS pos, (site_id+5*j)%24 AS kind FROM sites CROSS JOIN range(5) r(j)), cx AS MATERIALIZED (SELECT site_id, pos, " + ", ".join(
    "CASE kind " + " ".join(f"WHEN {i} THEN {k[c]}" if c not in (1, 2) else f"WHEN {i} THEN '{k[c]}'" for i, k in enumerate(_KINDS)) + f" END AS {n}"
    for c, n in ((0, "label"), (1, "key"), (2, "pattern"), (3, "priority"), (4, "fires"), (5, "plain"))) + " FROM kd), cp AS MATERIALIZED (SELECT site_id, key, arg_min(pattern, pos) AS pattern, arg_min(priority, pos)::INT AS priority FROM cx WHERE fires GROUP BY 1,2)"


def context_labels(s, d):
    """(site_id, pos, display_label): five labels of a site, of every kind that exports know."""
    x = V.sites(s, d).select("site_id", F.posexplode(F.sequence(F.lit(0), F.lit(4))).alias("pos", "_j"))
    x = x.withColumn("kind", (F.col("site_id") + 5 * F.col("pos")) % len(_KINDS))
    label = F.expr("element_at(array(" + ", ".join(k[0] for k in _KINDS) + "), CAST(kind AS INT) + 1)")
    return x.select("site_id", (F.col("pos") + 1).alias("pos"), label.alias("display_label"))


@query("a40_all_rules", sql("sites", "SELECT * FROM cp", _CTX))
def _(s, d):
    return X.site_patterns(context_labels(s, d))


@query("f14_all_labels", sql("sites", "SELECT label AS display_label, count(*) AS n_sites, any_value(plain) AS plain, true AS matched FROM cx GROUP BY 1", _CTX))
def _(s, d):
    return X.plain_language(context_labels(s, d))


@query("a33_all_facets", sql("sites", "SELECT key, count(*) AS n FROM (SELECT site_id, key FROM cp UNION ALL SELECT site_id, 'school' FROM sites WHERE site_id%1000<=300) GROUP BY 1", _CTX))
def _(s, d):
    schools = V.sites(s, d).select("site_id", (F.col("site_id") % 1000).alias("school_m"))
    arr = X.site_patterns(context_labels(s, d), schools).groupBy("site_id").agg(F.collect_set("key").alias("patterns"))  # at most one row per key
    return X.facet_counts(arr, "patterns")


_MEAS_ALL = _CTX + _MEAS[len(_PAT):].replace("FROM pt\n", "FROM cp AS pt\n")


@query("a34_measures_and_review", sql("sites", """SELECT site_id, pos::INT AS pos, measure, lo, hi FROM ms UNION ALL SELECT site_id, coalesce(n,0)::INT+1, 'review', 2000, 8000 FROM sites LEFT JOIN (SELECT site_id, max(pos) AS n FROM ms GROUP BY 1) USING (site_id)""", _MEAS_ALL))
def _(s, d):
    """Up to three measures a site and the review that closes each list, also an empty one."""
    t = V.sites(s, d)
    ctl = t.select("site_id", F.get(F.array(F.lit("signals"), F.lit("stop"), F.lit("none"), F.lit(None)), (F.col("site_id") % 4).cast("int")).alias("control"))
    return X.with_review(X.measures_for(X.site_patterns(context_labels(s, d)), ctl), t)


@query("p15_shown_sites", sql("se scored", f"SELECT r.site_id, rank FROM (SELECT site_id, council_district, {_RA} AS rank FROM scored) r JOIN ({_RATES}) USING (site_id) WHERE rank<=800 AND council_district IN (1,2,3,4) AND trend='rising'"))
def _(s, d):
    r = ranked(V.scored(s, d).select("site_id", "score_a", "council_district"), [("score_a", True), ("site_id", False)])
    return X.shown(r.join(rated(s, d).select("site_id", "trend"), "site_id"), 800, [1, 2, 3, 4], pattern="rising").select("site_id", "rank")


@query("t3_f10_name_search", sql("scored", f"""SELECT site_id, name, score::INT AS score FROM (SELECT *, (CASE WHEN a=1 OR substr(n,a-1,1) IN (' ','&') THEN 0 ELSE 500 END)+a-1+(CASE WHEN b=1 OR substr(n,b-1,1) IN (' ','&') THEN 0 ELSE 500 END)+b-1 AS score FROM (
  SELECT site_id, name, lower(name) AS n, strpos(lower(name),'street') AS a, strpos(lower(name),'third') AS b, {_RA} AS rank FROM scored) WHERE a>0 AND b>0) ORDER BY score, rank LIMIT 8"""))
def _(s, d):
    r = ranked(V.scored(s, d).select("site_id", "name", "score_a"), [("score_a", True), ("site_id", False)])
    toks = T.search_tokens("st. & third")
    sc = T.match_score(F.lower("name"), toks)
    return r.withColumn("score", sc).where("score IS NOT NULL").orderBy("score", "rank").limit(8).select("site_id", "name", F.col("score").cast("int").alias("score"))


@query("k7_site_spreadsheet", sql("se sites scored", f"""SELECT r.site_id, rank, council_district, printf('%.2f',per_year) AS crashes_per_year, trend, injury_crashes, gap, pdo, injury, ksi FROM (SELECT site_id, council_district, {_RA} AS rank FROM scored) r JOIN ({_RATES}) q USING (site_id)
  JOIN (SELECT s.site_id, count(*) FILTER (severity=5) AS pdo, count(*) FILTER (severity IN (3,4)) AS injury, count(*) FILTER (severity<=2) AS ksi FROM sites s LEFT JOIN (SELECT * FROM se WHERE year(date) BETWEEN 1996 AND 2000) e USING (site_id) GROUP BY 1) USING (site_id)"""))
def _(s, d):
    r = ranked(V.scored(s, d).select("site_id", "score_a", "council_district"), [("score_a", True), ("site_id", False)])
    h = F.filter("crash_history", lambda e: e["year"].between(1996, 2000))
    tot = lambda c: F.aggregate(h, F.lit(0).cast("bigint"), lambda a, e: a + e[c]).alias(c)
    x = rated(s, d).select("site_id", F.format_string("%.2f", "per_year").alias("crashes_per_year"), "trend", "injury_crashes", "gap", tot("pdo"), tot("injury"), tot("ksi"))
    return r.select("site_id", "rank", "council_district").join(x, "site_id", "left")


@query("j19_score_spine_join", sql("scored", "SELECT a.site_id, a.score_a, coalesce(CASE WHEN b.site_id%6<>0 THEN b.name END,'Node '||b.osm_id) AS label FROM (SELECT * FROM scored WHERE site_id%9<>2) a JOIN scored b USING (site_id)"))
def _(s, d):
    t = V.scored(s, d)
    names = t.where("site_id % 6 <> 0").select("site_id", F.col("name").alias("nm"))
    x = t.where("site_id % 9 <> 2").select("site_id", "score_a").join(t.select("site_id", "osm_id"), "site_id").join(names, "site_id", "left")
    return x.select("site_id", "score_a", F.coalesce("nm", F.concat(F.lit("Node "), F.col("osm_id").cast("string"))).alias("label"))


@query("a18_nested_history_json", sql("se sites", """SELECT site_id, '['||string_agg('{"year":'||year||',"ksi":'||ksi||',"injury":'||injury||',"pdo":'||pdo||'}', ',' ORDER BY year)||']' AS crash_history FROM (SELECT s.site_id, y.y AS year, count(*) FILTER (severity IN (1,2)) AS ksi,
  count(*) FILTER (severity IN (3,4)) AS injury, count(*) FILTER (severity=5) AS pdo FROM sites s CROSS JOIN range(1995,2002) y(y) LEFT JOIN se e ON e.site_id=s.site_id AND year(e.date)=y.y GROUP BY ALL) GROUP BY 1"""))
def _(s, d):
    from junctura.catalog.q_panel import assigned
    n = H.nested_history(H.year_history(assigned(s, d, False), V.sites(s, d), 1995, 2001))
    return n.select("site_id", F.to_json("crash_history").alias("crash_history"))
