"""Inspection records."""

from pyspark.sql import functions as F

from junctura.catalog import query, views as V
from junctura.catalog.views import sql
from junctura.functions import records as R, text as T
from junctura.plans import export as X, inspections as I

ORDER = ["date", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
_K = "(date, l_orderkey, l_linenumber, l_partkey, l_extendedprice)"
_ST = f"""li AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn, coalesce(type,'routine')='routine' AS rt FROM visits),
  ls AS MATERIALIZED (SELECT facility_id, date AS ld, type AS lt, score AS sc FROM li WHERE rn=1),
  lr AS (SELECT facility_id, arg_max(score, -rn) AS lrs FROM (SELECT facility_id, rn, score FROM li WHERE rt QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY rn)=1) GROUP BY 1),
  rs AS (SELECT facility_id, score, row_number() OVER (PARTITION BY facility_id ORDER BY rn) AS p FROM li WHERE rt AND score IS NOT NULL),
  stt AS MATERIALIZED (SELECT a.*, CASE WHEN ne>=2 AND lrs<=base-5 THEN 'worsening' WHEN ne>=2 AND lrs>=base+5 THEN 'improving' ELSE 'steady' END AS trend FROM (SELECT facility_id, count(*) AS n_visits, count(*) FILTER (rt) AS n_routine, max(ld) AS last_date, max(lt) AS last_type,
   max(sc) AS last_score, CASE WHEN max(sc)>=90 THEN 'A' WHEN max(sc)>=80 THEN 'B' WHEN max(sc) IS NOT NULL THEN 'C' END AS last_grade, (sum(major) FILTER (date_diff('day',date,ld)/30.44<=36))::BIGINT AS majors_36mo,
   (sum(minor) FILTER (date_diff('day',date,ld)/30.44<=36))::BIGINT AS minors_36mo, count(*) FILTER (closed) AS closures, count(*) FILTER (type='reinspection') AS reinspections,
   round(avg(score) FILTER (rt),6) AS mean_score FROM li JOIN ls USING (facility_id) GROUP BY 1) a LEFT JOIN lr USING (facility_id) LEFT JOIN (SELECT facility_id, avg(score) AS base, count(*) AS ne FROM rs WHERE p>1 GROUP BY 1) USING (facility_id))"""


def stats(s, d):
    return I.inspection_stats(V.visits(s, d), ORDER)


@query("a31_w6_w7_inspection_stats", sql("visits", "SELECT * FROM stt", _ST))
def _(s, d):
    return stats(s, d).withColumn("mean_score", F.round("mean_score", 6))


_TH = """th AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY major DESC, n DESC, last DESC, theme) AS pos FROM (SELECT facility_id, CASE WHEN theme IN ('parking','noise') THEN 'other' ELSE theme END AS theme,
  count(*) AS n, count(*) FILTER (severity='major') AS major, max(date) AS last FROM violations GROUP BY ALL))"""


@query("a32_theme_counts", sql("violations", "SELECT facility_id, theme, n, major, last, pos::INT AS pos FROM th", _TH))
def _(s, d):
    return I.theme_counts(V.violations(s, d)).drop("label")


_FP = _ST + ", " + _TH + """, fp AS (SELECT facility_id, theme AS key, (CASE theme WHEN 'vermin' THEN 98 WHEN 'temperature' THEN 95 WHEN 'handwashing' THEN 92 WHEN 'hygiene' THEN 85 WHEN 'sanitizing' THEN 80 WHEN 'storage' THEN 75 WHEN 'equipment' THEN 60
  WHEN 'plumbing' THEN 60 WHEN 'labeling' THEN 40 ELSE 30 END+least(major,3))::INT AS priority FROM th WHERE major>0 OR n>=2 UNION ALL SELECT facility_id, 'closed', 90 FROM stt WHERE closures>0
  UNION ALL SELECT facility_id, 'grade', 70 FROM stt WHERE last_grade<>'A' UNION ALL SELECT facility_id, 'repeat', 65 FROM stt WHERE reinspections>=2)"""


@query("a40_facility_patterns", sql("visits violations", "SELECT * FROM fp", _FP))
def _(s, d):
    return I.facility_patterns(stats(s, d), I.theme_counts(V.violations(s, d))).select("facility_id", "key", "priority")


@query("a33_facility_facets", sql("visits violations", "SELECT key, count(*) AS n FROM fp GROUP BY 1", _FP))
def _(s, d):
    p = I.facility_patterns(stats(s, d), I.theme_counts(V.violations(s, d)))
    return X.facet_counts(p.groupBy("facility_id").agg(F.collect_set("key").alias("k")), "k")


@query("k7_facility_spreadsheet", sql("visits violations", f"""SELECT s_suppkey AS facility_id, s_name AS name, last_date, last_score, last_grade, majors_36mo, closures, trend, theme AS top_theme FROM supplier LEFT JOIN stt ON stt.facility_id=s_suppkey
  LEFT JOIN (SELECT * FROM th WHERE pos=1) t ON t.facility_id=s_suppkey""", _FP))
def _(s, d):
    f = V.table(s, d, "supplier").select(F.col("s_suppkey").alias("facility_id"), F.col("s_name").alias("name"))
    th = I.theme_counts(V.violations(s, d))
    st = stats(s, d)
    x = I.facility_csv(f, st, th, I.facility_patterns(st, th))
    inv = {v: k for k, v in R.THEMES.items()}
    return x.select("facility_id", "name", "last_date", "last_score", "last_grade", "majors_36mo", "closures", "trend", T.lookup(inv, F.col("top_theme")).alias("top_theme"))


@query("f15_grades_and_tiers", sql("visits scored", """SELECT score, CASE WHEN score IS NULL THEN NULL WHEN score>=90 THEN 'A' WHEN score>=80 THEN 'B' ELSE 'C' END AS grade, CASE WHEN score<=50 THEN 'Highest risk' WHEN score<=100 THEN 'High risk' WHEN score<=200 THEN 'Elevated risk' ELSE 'Moderate risk' END AS tier, count(*) AS n FROM visits GROUP BY 1"""))
def _(s, d):
    g = V.visits(s, d).groupBy("score").agg(F.count("*").alias("n"))
    return g.select("score", R.grade_for(F.col("score")).alias("grade"), R.tier_for(F.col("score")).alias("tier"), "n")


@query("a33_type_facets", sql("", "SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1"))
def _(s, d):
    return V.table(s, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"))


@query("t3_place_search", sql("places", "SELECT place_id, place_name, (strpos(lower(place_name),'0')-1+CASE WHEN substr(place_name,strpos(place_name,'0')-1,1) IN (' ',',','&') THEN 0 ELSE 500 END)::INT AS score FROM places ORDER BY 3, place_id LIMIT 8"))
def _(s, d):
    toks = T.search_tokens("0", places=True)
    p = V.suppliers(s, d).withColumn("score", T.match_score(T.expand_address(F.col("place_name")), toks, r"[\s,&]")).where("score IS NOT NULL")
    return p.orderBy("score", "place_id").limit(8).select("place_id", "place_name", F.col("score").cast("int").alias("score"))
