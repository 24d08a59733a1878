"""Panel, history, trend and sequence queries (P, J14-J18, A, W4, W5 rows)."""

from pyspark.sql import functions as F

from junctura.catalog import query, views as V
from junctura.catalog.views import sql
from junctura.config import TABLE_PARAMS as P
from junctura.functions import records as R
from junctura.operators import tiers
from junctura.operators.ranking import ranked
from junctura.plans import history as H, models as M, panel as L
from junctura.session import attach, stage


def assigned(s, d, surface=True):
    sites = V.sites(s, d)
    return L.snap(V.events(s, d), L.surface_only(sites) if surface else sites, P.buffer_m)


def panel(s, d):
    return L.full_panel(V.events(s, d), V.sites(s, d), P)


def candidates(s, d):
    return L.candidate_panel(V.events(s, d), V.sites(s, d), P)


@query("p4_window_filters", sql("ev", """SELECT count(*) FILTER (date BETWEEN '1995-01-01' AND '1999-12-31') AS feature, count(*) FILTER (date BETWEEN '2000-01-01' AND '2001-08-01') AS label,
  count(*) FILTER (date>='1995-01-01' AND date<'2000-01-01') AS burn_in, count(*) FILTER (date>='1997-01-01' AND date<'2000-01-01') AS last36, count(*) FILTER (date>='1999-01-01' AND date<'2000-01-01') AS last_year,
  count(*) FILTER (severity IN (1,2)) AS ksi, count(*) FILTER (state_hwy IS DISTINCT FROM 'Y') AS surface FROM ev"""))
def _(s, d):
    w = P.windows
    return V.events(s, d).agg(
        F.count_if(L.closed("date", w.feature_start, w.feature_end)).alias("feature"), F.count_if(L.closed("date", w.label_start, w.label_end)).alias("label"),
        F.count_if(L.half_open("date", w.burn_in_start, w.cutoff)).alias("burn_in"),
        F.count_if((F.col("date") >= F.add_months(F.lit(w.cutoff), -36)) & (F.col("date") < F.lit(w.cutoff))).alias("last36"),
        F.count_if(L.half_open("date", w.cutoff.replace(year=w.cutoff.year - 1), w.cutoff)).alias("last_year"),
        F.count_if(R.is_ksi(F.col("severity"))).alias("ksi"), F.count_if(R.keeps_unknown(F.col("state_hwy"), "Y")).alias("surface"))


_PANEL = ["site_id", "KSI_feat", "KSI_label", "crashes_feat"]


@query("a1_j14_p9_panel_counts", sql("panel", "SELECT site_id, KSI_feat, KSI_label, crashes_feat FROM panel"))
def _(s, d):
    return panel(s, d).select(*_PANEL)


@query("p10_p11_candidates_city", sql("cand", "SELECT site_id, KSI_feat, KSI_label, crashes_feat, y_ge1, y_ge2, y_primary FROM cand"))
def _(s, d):
    return candidates(s, d).select(*_PANEL, "y_ge1", "y_ge2", "y_primary")


@query("p10_candidates_legacy", sql("panel", """SELECT site_id, KSI_feat, crashes_feat FROM panel WHERE KSI_feat<2 AND KSI_feat<=(SELECT quantile_cont(KSI_feat,0.9) FROM panel)"""))
def _(s, d):
    return L.eligible(stage(panel(s, d), "panel"), P, "ksi_legacy").select("site_id", "KSI_feat", "crashes_feat")


@query("a13_exact_percentile", sql("panel sites", "SELECT round((SELECT quantile_cont(crashes_feat,0.9) FROM panel),6)::DOUBLE AS p90_crashes, round(quantile_cont(acctbal,0.37),6) AS p37_balance FROM sites"))
def _(s, d):
    from junctura.operators.ranking import global_quantile
    a = global_quantile(panel(s, d), "crashes_feat", 0.9).select(F.round("q_value", 6).alias("p90_crashes"))
    return attach(a, global_quantile(V.sites(s, d), "acctbal", 0.37).select(F.round("q_value", 6).alias("p37_balance")))


_COUNTS = """SELECT site_id, count(*) FILTER (w72) AS crashes_72mo, count(*) FILTER (date>='1997-01-01') AS crashes_36mo, count(*) FILTER (w72 AND ped='Y') AS ped_crashes_72mo,
  count(*) FILTER (w72 AND bike='Y') AS bike_crashes_72mo, count(*) FILTER (w72 AND collision='D') AS broadside_72mo, count(*) FILTER (w72 AND is_left_turn) AS left_turn_72mo,
  count(*) FILTER (w72 AND alcohol='Y') AS dui_72mo, count(*) FILTER (w72 AND lighting IN ('B','C','D','E')) AS night_72mo, count(*) FILTER (w72 AND trim(pcf)='09') AS ped_row_violation_72mo,
  coalesce(bool_and(pcf IS NULL) FILTER (w72),true)::INT AS ped_row_violation_missing, round(date_diff('day',max(date),DATE '2000-01-01')/365.25::DOUBLE,6) AS years_since_last_crash,
  count(DISTINCT date) FILTER (w72) AS distinct_crash_days_72mo, coalesce(min(severity) FILTER (w72),5) AS worst_severity_72mo,
  round(count(*) FILTER (date>='1998-03-01')/greatest(count(*) FILTER (w72),1)::DOUBLE,6) AS covid_period_share
  FROM (SELECT *, date>='1995-01-01' AS w72 FROM cse WHERE date<'2000-01-01') GROUP BY 1"""
_CSE = """cse AS MATERIALIZED (SELECT ev.*, site_id FROM (SELECT event_id, site_id FROM (SELECT e.event_id, s.site_id, row_number() OVER (PARTITION BY e.event_id
  ORDER BY (e.x-s.x)*(e.x-s.x)+(e.y-s.y)*(e.y-s.y), s.site_id) AS rn FROM ev e JOIN cand s ON s.x BETWEEN e.x-77 AND e.x+77 AND s.y BETWEEN e.y-77 AND e.y+77
  WHERE (e.x-s.x)*(e.x-s.x)+(e.y-s.y)*(e.y-s.y)<=76.2*76.2) WHERE rn=1) JOIN ev USING (event_id)),
  cnt AS MATERIALIZED (""" + _COUNTS + """),
  yr AS MATERIALIZED (SELECT a.site_id, y.y AS year, y.y-1995 AS i, count(e.event_id) AS n FROM (SELECT DISTINCT site_id FROM cnt) a CROSS JOIN range(1995,2000) y(y)
    LEFT JOIN cse e ON e.site_id=a.site_id AND year(e.date)=y.y AND e.date<'2000-01-01' GROUP BY ALL)"""
_INTS = ["crashes_72mo", "crashes_36mo", "ped_crashes_72mo", "bike_crashes_72mo", "broadside_72mo", "left_turn_72mo", "dui_72mo", "night_72mo",
         "ped_row_violation_72mo", "distinct_crash_days_72mo"]


def candidate_events(s, d):
    """Events snapped to candidates only: an event at a screened-out site may move
    to a candidate nearby."""
    c = stage(candidates(s, d), "candidates")
    return c, L.snap(V.events(s, d), c.select("site_id", "x", "y"), P.buffer_m)


def features(s, d):
    c, ev = candidate_events(s, d)
    return H.history_features(ev, c, P)


def _round(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


_HIST = "SELECT c.site_id, " + ", ".join(f"coalesce({c},0) AS {c}" for c in _INTS) + """, coalesce(ped_row_violation_missing,1) AS ped_row_violation_missing, coalesce(years_since_last_crash, round(1826/365.25::DOUBLE,6)) AS years_since_last_crash,
  coalesce(worst_severity_72mo,5) AS worst_severity_72mo, coalesce(covid_period_share,0) AS covid_period_share FROM cand c LEFT JOIN cnt USING (site_id)"""


@query("a2_a3_a6_j17_history_counts", sql("cand ev", _HIST, _CSE))
def _(s, d):
    f = features(s, d)
    return _round(f.select("site_id", *_INTS, "ped_row_violation_missing", "years_since_last_crash", "worst_severity_72mo", "covid_period_share"),
                  ["years_since_last_crash", "covid_period_share"])


_TREND = """SELECT c.site_id, round(coalesce(slope,0),6) AS crash_trend_slope, round(coalesce(tau,0),6) AS mann_kendall_tau, round(coalesce(cp,0),6) AS changepoint_prob,
  round(coalesce(ewma,0),6) AS ewma_crashes, round(coalesce(mom,0),6) AS momentum_ratio, coalesce(vel,0)::DOUBLE AS emergence_velocity, coalesce(acc,0)::DOUBLE AS emergence_acceleration FROM cand c
  LEFT JOIN (SELECT site_id, regr_slope(n,i) AS slope, sum(n*CASE WHEN i=0 THEN pow(0.6::DOUBLE,4) ELSE 0.4*pow(0.6::DOUBLE,4-i) END) AS ewma,
    CASE WHEN avg(n) FILTER (i<2)=0 THEN avg(n) FILTER (i>=3) ELSE avg(n) FILTER (i>=3)/avg(n) FILTER (i<2) END AS mom,
    sum(CASE i WHEN 4 THEN n WHEN 0 THEN -n ELSE 0 END) AS vel, sum(CASE i WHEN 4 THEN n WHEN 3 THEN -n WHEN 1 THEN -n WHEN 0 THEN n ELSE 0 END) AS acc FROM yr GROUP BY 1) USING (site_id)
  LEFT JOIN (SELECT site_id, sum(sign(b.n-a.n))/nullif(sqrt(count(*)*(count(*)-count(*) FILTER (a.n=b.n))),0) AS tau FROM yr a JOIN yr b USING (site_id) WHERE a.i<b.i GROUP BY 1) USING (site_id)
  LEFT JOIN (SELECT site_id, 1/(1+exp(1-greatest(0,max(ll)))) AS cp FROM (SELECT site_id, k, sum(CASE WHEN i<k THEN n*ln(m1+1e-6)-m1 ELSE n*ln(m2+1e-6)-m2 END)-sum(n*ln(m0+1e-6)-m0) AS ll FROM (
    SELECT y.*, k, avg(n) FILTER (i<k) OVER w AS m1, avg(n) FILTER (i>=k) OVER w AS m2, avg(n) OVER w AS m0 FROM yr y CROSS JOIN range(1,5) r(k) WINDOW w AS (PARTITION BY site_id, k)) GROUP BY 1,2) GROUP BY 1) USING (site_id)"""


@query("a4_a7_a8_a9_w4_w5_trend", sql("cand ev", _TREND, _CSE))
def _(s, d):
    cols = ["crash_trend_slope", "mann_kendall_tau", "changepoint_prob", "ewma_crashes", "momentum_ratio"]
    return _round(features(s, d).select("site_id", *cols, "emergence_velocity", "emergence_acceleration"), cols)


@query("a5_j18_yearly_channels", sql("cand ev", """SELECT c.site_id, y.y::INT AS year, count(e.event_id) AS n_total, count(*) FILTER (severity IN (1,2)) AS n_ksi, count(*) FILTER (severity IN (3,4)) AS n_injury,
  count(*) FILTER (severity=5) AS n_pdo, count(*) FILTER (ped='Y') AS n_ped, count(*) FILTER (bike='Y') AS n_bike, count(*) FILTER (collision='D') AS n_broadside,
  count(*) FILTER (lighting IN ('B','C','D','E')) AS n_night FROM cand c CROSS JOIN range(1995,2000) y(y) LEFT JOIN cse e ON e.site_id=c.site_id AND year(e.date)=y.y AND e.date<'2000-01-01' GROUP BY ALL""", _CSE))
def _(s, d):
    c, ev = candidate_events(s, d)
    return H.yearly_channels(ev, c, P)


@query("a5_sequence_arrays", sql("cand ev", """SELECT site_id, string_agg(year||':'||n_total||'/'||n_ksi, ' ' ORDER BY year) AS seq FROM (SELECT c.site_id, y.y AS year, count(e.event_id) AS n_total,
  count(*) FILTER (severity IN (1,2)) AS n_ksi FROM cand c CROSS JOIN range(1995,2000) y(y) LEFT JOIN cse e ON e.site_id=c.site_id AND year(e.date)=y.y AND e.date<'2000-01-01' GROUP BY ALL) GROUP BY 1""", _CSE))
def _(s, d):
    c, ev = candidate_events(s, d)
    a = H.sequence_arrays(H.yearly_channels(ev, c, P))
    return a.select("site_id", F.array_join(F.transform("sequence", lambda r: F.format_string("%d:%d/%d", r["year"], r["n_total"], r["n_ksi"])), " ").alias("seq"))


@query("a26_buffer_sweep", sql("ev sites", """SELECT r AS radius_m, round(r*3937/1200,2) AS buf_ft, (SELECT count(*) FROM sites) AS n_candidates, count(*) FILTER (n>=1) AS positives_ge1, count(*) FILTER (n>=2) AS positives_ge2,
  (SELECT count(*) FROM sites)-count(*) AS dist_0, count(*) FILTER (n=1) AS dist_1, count(*) FILTER (n=2) AS dist_2, count(*) FILTER (n>=3) AS dist_3p FROM (
  SELECT r, site_id, count(*) AS n FROM (SELECT r.r, e.event_id, s.site_id, row_number() OVER (PARTITION BY r.r, e.event_id ORDER BY (e.x-s.x)*(e.x-s.x)+(e.y-s.y)*(e.y-s.y), s.site_id) AS rn
    FROM (VALUES (30.0::DOUBLE),(50.0),(76.2),(100.0)) r(r) CROSS JOIN ev e JOIN sites s ON abs(s.x-e.x)<=100 AND abs(s.y-e.y)<=100
    WHERE e.severity<=2 AND e.date BETWEEN '2000-01-01' AND '2001-08-01' AND (e.x-s.x)*(e.x-s.x)+(e.y-s.y)*(e.y-s.y)<=r.r*r.r) WHERE rn=1 GROUP BY 1,2) GROUP BY 1"""))
def _(s, d):
    return L.buffer_sweep(V.events(s, d), V.sites(s, d), P)


@query("a28_a44_scope_summary", sql("sse sites cand", """SELECT a.segment AS scope, a.n_nodes, a.n_surface, n_freeway, n_trunk, a.crashes_feat, a.KSI_feat, coalesce(b.n_candidates,0) AS n_candidates, coalesce(label_0,0) AS label_0,
  coalesce(label_1,0) AS label_1, coalesce(label_2p,0) AS label_2p, coalesce(n_ksi,0) AS n_ksi, round(h*100.0/nullif(n_ksi,0),2)::DOUBLE AS pct_ksi_highway, CASE WHEN coalesce(label_1,0)+coalesce(label_2p,0)>=300 THEN 'adequate' ELSE 'widen' END AS decision FROM
  (SELECT s.segment, count(*) AS n_nodes, count(*) FILTER (s.is_surface) AS n_surface, count(*) FILTER (s.is_freeway) AS n_freeway, count(*) FILTER (s.is_trunk AND NOT s.is_freeway) AS n_trunk, sum(coalesce(crashes_feat,0))::BIGINT AS crashes_feat, sum(coalesce(KSI_feat,0))::BIGINT AS KSI_feat
    FROM sites s LEFT JOIN panel p USING (site_id) GROUP BY 1) a LEFT JOIN
  (SELECT segment, count(*) AS n_candidates, count(*) FILTER (KSI_label=0) AS label_0, count(*) FILTER (KSI_label=1) AS label_1, count(*) FILTER (KSI_label>=2) AS label_2p FROM cand GROUP BY 1) b USING (segment) LEFT JOIN
  (SELECT segment, count(*) FILTER (severity<=2) AS n_ksi, count(*) FILTER (severity<=2 AND state_hwy='Y') AS h FROM sse JOIN sites USING (site_id) GROUP BY 1) c USING (segment)"""))
def _(s, d):
    """Scopes over all nodes, of every class, with the events snapped to their surface nodes."""
    p = stage(panel(s, d), "panel")
    sites = V.sites(s, d)
    every = sites.join(p.select("site_id", "crashes_feat", "KSI_feat"), "site_id", "left").fillna(0, ["crashes_feat", "KSI_feat"])
    ev = L.snap(V.events(s, d), L.surface_only(sites), P.buffer_m).join(sites.select("site_id", F.col("segment").alias("scope")), "site_id")
    return L.scope_summary(every, L.with_labels(L.eligible(p, P)), F.col("segment"), ev)


_ALL = f"""fa AS ({_HIST}), fb AS ({_TREND}), ft AS (SELECT * FROM fa JOIN fb USING (site_id)),
  vr AS (SELECT unnest([{", ".join(f"'{c}'" for c in H.FEATURES)}]) AS feature, unnest([{", ".join(f"var_samp({c}::DOUBLE)" for c in H.FEATURES)}]) AS v FROM ft)"""


@query("p12_constant_columns", sql("cand ev", "SELECT feature, v>0 AS kept FROM vr UNION ALL SELECT 'n_zero', false", _CSE + ", " + _ALL))
def _(s, d):
    """All features and a constant one."""
    f = features(s, d).withColumn("n_zero", F.lit(0))
    names = [*H.FEATURES, "n_zero"]
    kept = L.prune_constant(f, names)
    return s.createDataFrame([(n, n in kept) for n in names], "feature string, kept boolean")


@query("p13_missing_indicators", sql("sites", "SELECT site_id, (lanes IS NULL)::INT AS lanes_missing, coalesce(lanes,0) AS lanes FROM (SELECT site_id, CASE WHEN site_id%3=0 THEN site_id%7 END AS lanes FROM sites)"))
def _(s, d):
    t = V.sites(s, d).select("site_id", F.when(F.col("site_id") % 3 == 0, F.col("site_id") % 7).alias("lanes"))
    return t.withColumn("lanes_missing", F.col("lanes").isNull().cast("int")).fillna(0, ["lanes"])


@query("p14_severity_groups", sql("crash_text", "SELECT CASE WHEN try_cast(COLLISION_SEVERITY AS INT) IN (1,2) THEN 'ksi' WHEN try_cast(COLLISION_SEVERITY AS INT) IN (3,4) THEN 'injury' ELSE 'pdo' END AS grp, count(*) AS n FROM crash_text GROUP BY 1"))
def _(s, d):
    return V.crash_text(s, d).groupBy(R.severity_group(F.col("COLLISION_SEVERITY")).alias("grp")).agg(F.count("*").alias("n"))


@query("p22_exposure_proxy", sql("sites", "SELECT site_id, coalesce(v,0)::DOUBLE AS aadt_proxy, (v IS NULL)::INT AS aadt_missing, round(CASE WHEN coalesce(v,0)>-1 THEN ln(1+coalesce(v,0)) END,6) AS log_aadt FROM (SELECT site_id, CASE WHEN site_id%4<>0 THEN acctbal END AS v FROM sites)"))
def _(s, d):
    from junctura.plans.infra import exposure_proxy
    v = V.sites(s, d).select("site_id", F.when(F.col("site_id") % 4 != 0, F.col("acctbal")).alias("speed_limit"))
    v = v.withColumn("speed_limit_missing", F.col("speed_limit").isNull().cast("int"))
    return exposure_proxy(v).withColumn("log_aadt", F.round("log_aadt", 6))


@query("a18_year_history", sql("se sites", """SELECT s.site_id, y.y::INT AS year, count(*) FILTER (severity IN (1,2)) AS ksi, count(*) FILTER (severity IN (3,4)) AS injury, count(*) FILTER (severity=5) AS pdo
  FROM sites s CROSS JOIN range(1995,2002) y(y) LEFT JOIN se e ON e.site_id=s.site_id AND year(e.date)=y.y GROUP BY ALL"""))
def _(s, d):
    return H.year_history(assigned(s, d, False), V.sites(s, d), 1995, 2001)


def rated(s, d):
    n = H.nested_history(H.year_history(assigned(s, d, False), V.sites(s, d), 1995, 2001))
    n = n.withColumns(H.rates(F.col("crash_history"), 1995, 2000, 1998))
    inj, gap = H.screen_gap(F.col("crash_history"), 2000, 5)
    return n.withColumns({"injury_crashes": inj, "gap": gap})


_RATES = """SELECT site_id, years, total, injuries, round(total/years,6) AS per_year, round(injuries/years,6) AS injury_per_year, round(r,6) AS recent_per_year, round(e,6) AS earlier_per_year,
  CASE WHEN r>=e*1.5 AND r-e>=1 THEN 'rising' WHEN r<=e*0.5 AND e-r>=1 THEN 'falling' ELSE 'steady' END AS trend, injury_crashes, greatest(0,5-injury_crashes) AS gap FROM (
  SELECT s.site_id, 6 AS years, count(e.event_id) FILTER (year(date)<=2000) AS total, count(*) FILTER (severity<=4 AND year(date)<=2000) AS injuries,
   count(*) FILTER (year(date) BETWEEN 1998 AND 2000)/3.0::DOUBLE AS r, count(*) FILTER (year(date) BETWEEN 1995 AND 1997)/3.0::DOUBLE AS e,
   count(*) FILTER (year(date)=2000 AND severity<=4) AS injury_crashes FROM sites s LEFT JOIN se e USING (site_id) GROUP BY 1)"""


@query("a29_a30_rates_and_gap", sql("se sites", _RATES))
def _(s, d):
    cols = ["per_year", "injury_per_year", "recent_per_year", "earlier_per_year"]
    return _round(rated(s, d).drop("crash_history"), cols)


@query("a29_rate_per_million", sql("se sites", "SELECT site_id, round(n/6.0/(entering*365/1e6),6) AS per_million FROM (SELECT s.site_id, count(e.event_id) FILTER (year(date)<=2000) AS n, s.site_id%500*100 AS entering FROM sites s LEFT JOIN se e USING (site_id) GROUP BY ALL) WHERE entering>0"))
def _(s, d):
    x = rated(s, d).select("site_id", "per_year", (F.col("site_id") % 500 * 100).alias("entering"))
    return x.select("site_id", F.round(H.rate_per_million(F.col("per_year"), F.col("entering")), 6).alias("per_million")).where("per_million IS NOT NULL")


@query("a43_known_and_screen_tiers", sql("se", """SELECT site_id, 'known' AS tier, ksi_history AS n, crashes_history AS m FROM (SELECT site_id, count(*) FILTER (severity<=2 AND date BETWEEN '1995-01-01' AND '1999-12-31') AS ksi_history,
  count(*) FILTER (date<'2000-01-01') AS crashes_history FROM se GROUP BY 1) WHERE ksi_history>=1
  UNION ALL SELECT site_id, 'screen', n, NULL FROM (SELECT site_id, count(*) AS n FROM se WHERE date>='1999-01-01' AND date<'2000-01-01' GROUP BY 1) WHERE n>=3"""))
def _(s, d):
    from dataclasses import replace
    k, sc = L.tier_inputs(V.events(s, d), V.sites(s, d), replace(P, screen_min=3))
    a = k.select("site_id", F.lit("known").alias("tier"), F.col("ksi_history").alias("n"), F.col("crashes_history").alias("m"))
    return a.unionAll(sc.select("site_id", F.lit("screen").alias("tier"), F.col("screen_count").alias("n"), F.lit(None).cast("bigint").alias("m")))


@query("a41_screen_overlap", sql("scored se", """SELECT k.k::INT AS top_k, w.w AS screen, count(*) FILTER (hit=1 AND rank<=k.k) AS model_catches, count(*) FILTER (hit=1 AND rank<=k.k AND NOT f) AS model_unique,
  count(*) FILTER (f) AS n_flagged FROM (SELECT site_id, hit, rank, 'full' AS w, coalesce(c,0)>=3 AS f FROM r LEFT JOIN (SELECT site_id, count(*) AS c FROM se WHERE date>='1995-01-01' AND date<'2000-01-01' GROUP BY 1) USING (site_id)
  UNION ALL SELECT site_id, hit, rank, 'last', coalesce(c,0)>=3 FROM r LEFT JOIN (SELECT site_id, count(*) AS c FROM se WHERE date>='1999-01-01' AND date<'2000-01-01' GROUP BY 1) USING (site_id)
  UNION ALL SELECT site_id, hit, rank, 'any_single_year', coalesce(c,0)>=3 FROM r LEFT JOIN (SELECT site_id, max(c) AS c FROM (SELECT site_id, year(date), count(*) AS c FROM se WHERE year(date) BETWEEN 1995 AND 1999 GROUP BY 1,2) GROUP BY 1) USING (site_id)) w
  CROSS JOIN (VALUES (50),(200),(500)) k(k) GROUP BY 1,2""", "r AS (SELECT site_id, hit, row_number() OVER (ORDER BY score_a DESC, site_id) AS rank FROM scored)"))
def _(s, d):
    from datetime import date
    r = ranked(V.scored(s, d).select("site_id", "hit", "score_a"), [("score_a", True), ("site_id", False)])
    w = {"full": (date(1995, 1, 1), date(2000, 1, 1)), "last": (date(1999, 1, 1), date(2000, 1, 1))}
    return L.screen_overlap(r, assigned(s, d, False), w, (1995, 1999), 3, "rank", "hit", (50, 200, 500))


@query("flagship_rank_below_screen", sql("cand ev", """SELECT site_id, rank, round(score,6) AS score, KSI_label>=1 AS positive FROM (SELECT c.*, coalesce(crashes_72mo,0)+coalesce(slope,0)/100 AS score,
  row_number() OVER (ORDER BY coalesce(crashes_72mo,0)+coalesce(slope,0)/100 DESC, c.site_id) AS rank FROM cand c LEFT JOIN cnt USING (site_id) LEFT JOIN (SELECT site_id, round(regr_slope(n,i),9) AS slope FROM yr GROUP BY 1) USING (site_id))""", _CSE))
def flagship(s, d):
    """Sites below the screen, ranked by event history."""
    c, ev = candidate_events(s, d)
    f = H.history_features(ev, c, P).select("site_id", M.persistence_score(F.col("crashes_72mo"), F.round("crash_trend_slope", 9)).alias("score"))
    r = ranked(c.select("site_id", "KSI_label").join(f, "site_id"), [("score", True), ("site_id", False)])
    return r.select("site_id", "rank", F.round("score", 6).alias("score"), (F.col("KSI_label") >= 1).alias("positive"))


@query("a22_catch_table", sql("cand ev", """SELECT k::INT AS k, count(*) FILTER (positive AND rank<=k) AS caught, count(*) FILTER (positive) AS total FROM (SELECT KSI_label>=1 AS positive,
  row_number() OVER (ORDER BY coalesce(crashes_72mo,0) DESC, c.site_id) AS rank FROM cand c LEFT JOIN cnt USING (site_id)) CROSS JOIN (VALUES (50),(100),(200),(500),(800),(1000)) k(k) GROUP BY 1""", _CSE))
def _(s, d):
    c, ev = candidate_events(s, d)
    f = H.history_features(ev, c, P).select("site_id", "crashes_72mo")
    r = ranked(c.select("site_id", (F.col("KSI_label") >= 1).alias("positive")).join(f, "site_id"), [("crashes_72mo", True), ("site_id", False)])
    return tiers.catch_table(r, "rank", "positive")


@query("a27_feature_dictionary", sql("cand ev", """SELECT feature AS feature_name, 0.0::DOUBLE AS missing_rate, round(v,4) AS variance, CASE WHEN feature='crashes_72mo' THEN 'history' ELSE 'events' END AS source_table FROM vr
  UNION ALL SELECT 'ksi_72mo', NULL, 0.0, 'N/A'""", _CSE + ", " + _ALL))
def _(s, d):
    """Every history feature, one row of it replaced by a later entry, and a dropped one."""
    f = stage(features(s, d), "features")
    a = H.feature_dictionary(f, H.FEATURES, "events", "feature", "1999-12-31", [("ksi_72mo", "constant-zero by eligibility")])
    b = H.feature_dictionary(f, ["crashes_72mo"], "history", "feature", "1999-12-31")
    return H.upsert_dictionary(a, b).select("feature_name", "missing_rate", F.round("variance", 4).alias("variance"), "source_table")


@query("j30_u4_snapshot_difference", sql("", """SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, (SELECT count(*) FROM (SELECT o_orderkey FROM a EXCEPT SELECT o_orderkey FROM b)) AS only_a,
  (SELECT count(*) FROM (SELECT o_orderkey FROM b EXCEPT SELECT o_orderkey FROM a)) AS only_b, round(abs((SELECT count(*) FROM a)-(SELECT count(*) FROM b))*100.0/(SELECT count(*) FROM a),4)::DOUBLE AS pct_diff,
  CASE WHEN abs((SELECT count(*) FROM a)-(SELECT count(*) FROM b))*100.0/(SELECT count(*) FROM a)<=2 THEN 'accept' ELSE 'defer' END AS decision""").replace("SELECT (SELECT count(*) FROM a)", "WITH a AS (FROM orders WHERE o_orderkey%40<>1), b AS (FROM orders WHERE o_orderkey%50<>3) SELECT (SELECT count(*) FROM a)", 1))
def _(s, d):
    from junctura.plans.audits import compare_snapshots
    o = V.events(s, d)
    return compare_snapshots(o.where("event_id % 40 <> 1"), o.where("event_id % 50 <> 3"), "event_id")
