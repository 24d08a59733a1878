"""Gates and audits (Q rows, A15-A17, T4, U3)."""

from pyspark.sql import functions as F

from junctura.catalog import query, views as V
from junctura.catalog.q_panel import _ALL, _CSE, assigned, candidate_events
from junctura.catalog.views import sql
from junctura.config import TABLE_PARAMS as P, TABLE_WINDOWS as W
from junctura.functions import records as R
from junctura.operators import ranking as K, tiers
from junctura.plans import audits as Q, history as H, panel as L
from junctura.sources import events as E
from junctura.session import attach, stage

_CAN = """cn AS MATERIALIZED (SELECT CASE_ID AS crash_id, try_cast(COLLISION_DATE AS DATE) AS date, POINT_Y::DOUBLE AS lat, POINT_X::DOUBLE AS lon, try_cast(COLLISION_SEVERITY AS INT) AS severity FROM crash_text)"""


def canonical(s, d):
    c = V.crash_text(s, d)
    return c.select(F.col("CASE_ID").alias("crash_id"), R.parsed_date(F.col("COLLISION_DATE")).alias("date"), F.col("POINT_Y").try_cast("double").alias("lat"),
                    F.col("POINT_X").try_cast("double").alias("lon"), F.col("COLLISION_SEVERITY").try_cast("int").alias("severity"))


@query("q1_u3_leakage", sql("ev", """SELECT unnest(['A1','A2','A3','A4','A5']) AS check, unnest([(SELECT count(*) FROM f WHERE date>='2000-01-01'),(SELECT count(*) FROM f WHERE date<'1995-01-01' OR date>'1999-12-31'),
  (SELECT count(*) FROM l WHERE date<'2000-01-01' OR date>'2001-08-01'),(SELECT count(*) FROM (SELECT event_id FROM f INTERSECT SELECT event_id FROM l)),(SELECT count(*) FROM l WHERE date<'2000-01-01')]) AS n_bad""",
  "f AS (SELECT * FROM ev WHERE severity<=2 AND date<='2000-01-15'), l AS (SELECT * FROM ev WHERE severity<=2 AND date>='1999-12-20')"))
def _(s, d):
    ksi = V.events(s, d).where(R.is_ksi(F.col("severity")))
    return Q.leakage(ksi.where("date <= DATE'2000-01-15'"), ksi.where("date >= DATE'1999-12-20'"), W)


@query("q2_dictionary_gate", sql("cand ev", "SELECT 'late' AS feature_name, 'A6' AS \"check\" UNION ALL SELECT 'ksi_72mo', 'A7' UNION ALL SELECT feature, 'A7' FROM vr WHERE feature IN ('dui_72mo','crashes_36mo') AND v<>0", _CSE + ", " + _ALL))
def _(s, d):
    """All history features: one dated too late, one dropped as constant without a variance on
    record, and two dropped as constant that do vary."""
    c, ev = candidate_events(s, d)
    f = stage(H.history_features(ev, c, P), "features")
    gone = ["dui_72mo", "crashes_36mo"]
    dic = H.feature_dictionary(f, [n for n in H.FEATURES if n not in gone], "events", "feature", "1999-12-31", [("ksi_72mo", "constant by design"), ("zero", "constant-zero")])
    said = H.feature_dictionary(f, gone, "events", "N/A -- DROPPED", "1999-12-31").withColumn("drop_reason", F.lit("zero variance"))
    late = H.feature_dictionary(f.withColumn("late", F.col("crashes_36mo")), ["late"], "events", "feature", "2000-03-01")
    return Q.dictionary_violations(dic.unionByName(said).unionByName(late), "2000-01-01")


@query("q3_volume", sql("ev", "SELECT count(*) AS n, count(*)>=20 AS ok FROM ev WHERE severity<=2 AND date BETWEEN '1995-01-01' AND '1999-12-31'"))
def _(s, d):
    return Q.volume(V.events(s, d).where(R.is_ksi(F.col("severity")) & L.closed("date", W.feature_start, W.feature_end)))


@query("q3_vintage", sql("", "SELECT p_name||p_partkey AS feature_name, strftime(DATE '1999-06-01'+(p_size*10)::INT,'%Y-%m-%d') AS max_source_date FROM part WHERE p_type='PROMO' AND DATE '1999-06-01'+(p_size*10)::INT>'1999-12-31'"))
def _(s, d):
    dic = V.table(s, d, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("feature_name"), F.when(F.col("p_type") == "PROMO", "endogenous").otherwise("static").alias("vintage"),
                                       F.date_add(F.lit("1999-06-01").cast("date"), F.col("p_size") * 10).cast("string").alias("max_source_date"))
    return Q.vintage_violations(dic, "1999-12-31")


@query("q4_a15_contract", sql("crash_text", """SELECT *, CASE WHEN n_raw=0 THEN 'EMPTY' WHEN coord_coverage<0.8 OR pct_duplicate_coords>0.2 THEN 'WARN' ELSE 'OK' END AS verdict FROM (SELECT count(*) AS n_raw, count(*) FILTER (lat IS NULL) AS n_bad_coords,
  round(1-count(*) FILTER (lat IS NULL)/count(*)::DOUBLE,4) AS coord_coverage, count(*) FILTER (date IS NULL) AS n_bad_dates, count(*) FILTER (severity IS NULL) AS n_bad_severity,
  (SELECT round(coalesce(sum(k) FILTER (k>1),0)/sum(k)::DOUBLE,4) FROM (SELECT count(*) AS k FROM cn WHERE lat IS NOT NULL GROUP BY lat, lon)) AS pct_duplicate_coords,
  (SELECT max(k) FROM (SELECT count(*) AS k FROM cn WHERE lat IS NOT NULL GROUP BY lat, lon)) AS max_at_one_coord FROM cn)""", _CAN))
def _(s, d):
    return Q.contract_verdict(Q.contract_stats(Q.require_columns(canonical(s, d))))


@query("a16_coordinate_precision", sql("crash_text", "SELECT length(split_part(POINT_Y,'.',2))::INT AS decimals, count(*) AS n FROM (SELECT rtrim(POINT_Y,'0') AS POINT_Y FROM crash_text WHERE POINT_Y IS NOT NULL) GROUP BY 1"))
def _(s, d):
    t = V.crash_text(s, d).where("POINT_Y IS NOT NULL").select(F.rtrim("POINT_Y", F.lit("0")).alias("t"))
    return Q.precision_histogram(t, "t")


@query("a16_t4_place_volume", sql("", "SELECT array_to_string([upper(substr(w,1,1))||substr(w,2) for w in string_split(lower(n_name),' ')],' ')||', '||r_name AS place, count(*) AS n, count(*)>=650 AS viable FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey GROUP BY ALL ORDER BY n DESC, place LIMIT 5"))
def _(s, d):
    o, c, n, r = (V.table(s, d, t) for t in ("orders", "customer", "nation", "region"))
    # Count per customer first: the large table shrinks before it meets the names.
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k")).join(c, "c_custkey").groupBy("c_nationkey").agg(F.sum("k").alias("k"))
    rows = per.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    rows = rows.groupBy(F.concat_ws(", ", F.initcap("n_name"), "r_name").alias("place")).agg(F.sum("k").alias("n"))
    return rows.withColumn("viable", F.col("n") >= 650).orderBy(F.col("n").desc(), "place").limit(5)


@query("a16_named_places", sql("", "SELECT upper(substr(s,1,1))||lower(substr(s,2))||', '||l AS place, count(*) AS n, count(*)>=100 AS viable FROM (SELECT source AS s, lang AS l FROM documents) GROUP BY ALL"))
def _(s, d):
    return Q.place_volume(V.table(s, d, "documents"), "source", "lang", 100)


@query("a17_snapshot_profile", sql("ev", """SELECT year(date)::INT AS snap, count(*) AS total_rows, min(date) AS date_min, max(date) AS date_max, round(count(*) FILTER (event_id%37<>0)*100.0/count(*),2)::DOUBLE AS pct_geocoded,
  round(count(*) FILTER (state_hwy='Y')*100.0/count(*),2)::DOUBLE AS pct_freeway, count(*) FILTER (severity<=2) AS ksi_rows FROM ev GROUP BY 1"""))
def _(s, d):
    e = V.events(s, d).withColumn("snap", F.year("date")).withColumn("x", F.when(F.col("event_id") % 37 != 0, F.col("x")))
    return Q.snapshot_profile(e, "snap")


_PLACED = "pl AS (SELECT e.*, n_name AS place, r_name AS state FROM ev e JOIN orders ON o_orderkey=event_id JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey)"


def placed(s, d):
    """Events with the place and state of their customer."""
    o, c, n, r = (V.table(s, d, t) for t in ("orders", "customer", "nation", "region"))
    where = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("place"), F.col("r_name").alias("state"))
    return V.events(s, d).join(o.select(F.col("o_orderkey").alias("event_id"), "o_custkey").join(where, "o_custkey"), "event_id").drop("o_custkey")


@query("a16_source_audit", sql("ev", """SELECT *, concat_ws('; ', CASE WHEN coord_coverage<0.8 THEN 'coverage' END, CASE WHEN pct_useful_decimals<0.5 THEN 'decimals' END, CASE WHEN pct_duplicate_coords>0.2 THEN 'shared coordinates' END) AS problems,
  CASE WHEN coord_coverage<0.8 OR pct_useful_decimals<0.5 OR pct_duplicate_coords>0.2 THEN 'REVIEW REQUIRED' ELSE 'USABLE' END AS verdict FROM (SELECT 'orders' AS source, count(*) AS n_crashes, round(1-count(*) FILTER (la IS NULL)/count(*)::DOUBLE,4) AS coord_coverage,
  count(*) FILTER (la IS NULL) AS n_missing_coords, round(avg((length(split_part(t,'.',2))>=4)::INT) FILTER (la IS NOT NULL),4) AS pct_useful_decimals, (SELECT round(coalesce(sum(k) FILTER (k>1),0)/sum(k)::DOUBLE,4) FROM ats) AS pct_duplicate_coords, (SELECT max(k) FROM ats) AS max_at_one_coord,
  (SELECT count(*) FROM pv) AS n_places, (SELECT count(*) FILTER (n>=600) FROM pv) AS n_viable, (SELECT max(n) FROM pv) AS largest_place FROM sa)""", _PLACED + """, sa AS (SELECT *, CASE WHEN event_id%37<>0 THEN lat END AS la, rtrim(printf('%.5f',lat),'0') AS t FROM pl),
  ats AS (SELECT count(*) AS k FROM sa WHERE la IS NOT NULL GROUP BY la, lon), pv AS (SELECT place, state, count(*) AS n FROM sa WHERE la IS NOT NULL GROUP BY 1,2)"""))
def _(s, d):
    e = placed(s, d).withColumn("t", F.rtrim(F.format_string("%.5f", "lat"), F.lit("0"))).withColumn("lat", F.when(F.col("event_id") % 37 != 0, F.col("lat")))
    return Q.source_audit(e, "orders", "t", "place", "state", 600)


@query("a17_ksi_by_year", sql("ev", "SELECT snap::INT AS snap, y.y::INT AS year, count(e.severity) AS ksi_rows FROM (SELECT DISTINCT event_id%3 AS snap FROM ev) CROSS JOIN range(1995,2002) y(y) LEFT JOIN ev e ON e.event_id%3=snap AND year(e.date)=y.y AND e.severity<=2 GROUP BY ALL"))
def _(s, d):
    return Q.snapshot_years(V.events(s, d).withColumn("snap", (F.col("event_id") % 3).cast("int")), "snap", (1995, 2001))


@query("a17_t4_top_places", sql("ev", "SELECT snap, pos::INT AS pos, place, n FROM (SELECT *, row_number() OVER (PARTITION BY snap ORDER BY n DESC, place) AS pos FROM (SELECT year(date)::INT AS snap, place, count(*) AS n FROM pl GROUP BY 1,2)) WHERE pos<=5", _PLACED))
def _(s, d):
    return Q.snapshot_places(placed(s, d).withColumn("snap", F.year("date")), "snap", "place")


@query("q9_rows_by_year", sql("ev", """SELECT year(date)::INT AS year, count(*) FILTER (event_id%40<>1) AS n_a, count(*) FILTER (event_id%50<>3) AS n_b, count(*) FILTER (event_id%40<>1)-count(*) FILTER (event_id%50<>3) AS diff,
  round(abs(count(*) FILTER (event_id%40<>1)-count(*) FILTER (event_id%50<>3))*100.0/count(*) FILTER (event_id%40<>1),2)::DOUBLE AS pct_diff FROM ev GROUP BY 1"""))
def _(s, d):
    e = V.events(s, d)
    return Q.rows_by_year(e.where("event_id % 40 <> 1"), e.where("event_id % 50 <> 3"))


@query("q5_export_panel", sql("scored", """SELECT unnest(['district','props','repeated_id']) AS check, unnest([(SELECT count(*) FROM scored WHERE nation>9),(SELECT count(*) FROM scored LEFT JOIN events ON event_id=site_id WHERE site_id%7=0 OR props IS NULL),
  (SELECT count(*) FROM (SELECT site_id//2 FROM scored WHERE site_id%10<2 GROUP BY 1 HAVING count(*)>1))]) AS n_bad"""))
def _(s, d):
    """Every site of the panel; one without properties, or with text after them, is a violation."""
    e = V.table(s, d, "events").select(F.col("event_id").alias("site_id"), F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit("}}"))).otherwise(F.col("props")).alias("props"))
    t = V.scored(s, d).select("site_id", F.col("nation").alias("council_district"), F.when(F.col("site_id") % 10 < 2, F.floor(F.col("site_id") / 2)).otherwise(F.col("site_id") + 10**9).alias("node_id"))
    return Q.export_violations(t.join(e, "site_id", "left"), ["props"])


@query("q6_expected_counts", sql("cand", "SELECT name, n, expected, abs(n-expected)<=5 AS ok FROM (SELECT 'candidates' AS name, count(*) AS n, 1226::BIGINT AS expected FROM cand UNION ALL SELECT 'emergent_ge1', count(*) FILTER (KSI_label>=1), 21 FROM cand)"))
def _(s, d):
    c = L.candidate_panel(V.events(s, d), V.sites(s, d), P).agg(F.count("*").alias("a"), F.count_if(F.col("KSI_label") >= 1).alias("b"))
    act = c.select(F.explode(F.array(F.struct(F.lit("candidates").alias("name"), F.col("a").alias("n")), F.struct(F.lit("emergent_ge1").alias("name"), F.col("b").alias("n")))).alias("r")).select("r.*")
    exp = s.createDataFrame([("candidates", 1226), ("emergent_ge1", 21)], "name string, expected bigint")
    return Q.expected_counts(act, exp, 5)


@query("q7_tier_inputs", sql("", "SELECT l_suppkey AS site_id, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*)>1"))
def _(s, d):
    t = V.table(s, d, "lineitem").select(F.col("l_suppkey").alias("site_id"), F.col("l_quantity").alias("screen_count"))
    return tiers.check_tier(t, "site_id", ["screen_count"])


@query("q8_context_coverage", sql("scored controls", """SELECT unnest(['school','named']) AS context, (SELECT count(*) FROM scored) AS n_sites, unnest([(SELECT count(*) FROM scored WHERE site_id%1000<=300),(SELECT count(*) FROM scored WHERE name LIKE '% & %')]) AS n_with"""))
def _(s, d):
    t = V.scored(s, d)
    return Q.coverage(t, {"school": t.where("site_id % 1000 <= 300"), "named": t.where(F.col("name").contains(" & "))})


@query("q8_rank_and_catch", sql("scored", "SELECT count(*) AS n, count(*) AS n_distinct, 1::BIGINT AS lo, count(*) AS hi, true AS ok, 0::BIGINT AS catch_drops FROM scored"))
def _(s, d):
    r = K.ranked(V.scored(s, d).select("site_id", "score_a", (F.col("hit") == 1).alias("pos")), [("score_a", True), ("site_id", False)])
    drops = Q.catch_monotone(tiers.catch_table(r, "rank", "pos")).agg(F.count("*").alias("catch_drops"))
    return attach(Q.rank_gaps(r), drops)


@query("q10_ksi_guard", sql("ev", "SELECT severity_scheme, count(*) AS n FROM (SELECT CASE WHEN event_id%3=0 THEN 'fatal_only' ELSE 'ksi' END AS severity_scheme FROM ev) WHERE severity_scheme<>'ksi' GROUP BY 1"))
def _(s, d):
    e = V.events(s, d).withColumn("severity_scheme", F.when(F.col("event_id") % 3 == 0, "fatal_only").otherwise("ksi"))
    return Q.ksi_guard(e).groupBy("severity_scheme").agg(F.count("*").alias("n"))


@query("p5_ksi_membership", sql("ev", "SELECT severity, severity IN (1,2) AS ksi, count(*) AS n FROM ev GROUP BY 1"))
def _(s, d):
    return V.events(s, d).groupBy("severity").agg(F.count("*").alias("n")).select("severity", R.is_ksi(F.col("severity")).alias("ksi"), "n")
