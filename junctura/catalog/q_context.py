"""Traffic counts, police reports, matched controls."""

from pyspark.sql import functions as F

from junctura.catalog import query, views as V
from junctura.catalog.views import sql
from junctura.functions import records as R, text as T
from junctura.operators import tiers
from junctura.operators.ranking import ranked
from junctura.plans import traffic as TR
from junctura.session import scratch_path
from junctura.sources import context as C, sinks
from junctura.streaming import reports as SR

_MAP = "MAP {" + ",".join(f"'{k}':'{v}'" for k, v in T.SUFFIXES.items()) + "}"
_DIR = "[" + ",".join(f"'{v}'" for v in T.DIRECTIONALS) + "]"


def key_sql(c):
    return (f"array_to_string(list_transform(list_filter(regexp_extract_all(lower(coalesce({c},'')),'[a-z0-9]+'), lambda t: NOT list_contains({_DIR},t)), "
            f"lambda t: coalesce({_MAP}[t],t)),' ')")


def pair_sql(a, b):
    return f"CASE WHEN {a}<>'' AND {b}<>'' AND {a}<>{b} THEN least({a},{b})||' | '||greatest({a},{b}) END"


_PARSED = """pc AS MATERIALIZED (SELECT trim(CASE WHEN location LIKE '% btwn %' THEN split_part(location,' btwn ',1) WHEN location LIKE '% at %' THEN split_part(location,' at ',1) END) AS street,
  trim(CASE WHEN location LIKE '% btwn %' THEN replace(split_part(location,' btwn ',2),' _ ',' & ') WHEN location LIKE '% at %' THEN split_part(location,' at ',2) END) AS limits,
  coalesce(floor(try_cast(adt_total AS DOUBLE)),0)::BIGINT AS total, date, lat::DOUBLE AS lat, lng::DOUBLE AS lng FROM counts_text)"""


def counts_csv(s, d):
    path = scratch_path(s, "counts")
    sinks.write_csv(V.counts_text(s, d), path)
    return C.read_counts(s, path)


def reports_csv(s, d):
    """Reports with upper-case headers, as some files have them."""
    path = scratch_path(s, "reports")
    sinks.write_csv(V.reports_text(s, d), path)
    return C.read_reports(s, path)


@query("s14_f3_parse_counts", sql("counts_text", "SELECT street, limits, total, date, lat, lng, street IS NOT NULL AS parsed, count(*) AS n FROM pc GROUP BY ALL", _PARSED))
def _(s, d):
    """From CSV files, rows without a readable location counted, not lost."""
    p = TR.parse_counts(counts_csv(s, d))
    return p.groupBy(*p.columns).agg(F.count("*").alias("n"))


@query("f1_f2_f4_street_keys", sql("counts_text", f"""SELECT DISTINCT location, street, {key_sql('street')} AS road, array_to_string(list_transform(string_split(limits,' & '), lambda t: {key_sql('t')}),' / ') AS crosses, year(date::DATE)::INT AS yr
  FROM (SELECT DISTINCT pc.*, location FROM (SELECT DISTINCT location, date FROM counts_text) c JOIN pc0 pc USING (location, date) WHERE street IS NOT NULL)""",
  _PARSED.replace("pc AS", "pc0 AS").replace("coalesce(floor(try_cast(adt_total AS DOUBLE)),0)::BIGINT AS total, date, lat::DOUBLE AS lat, lng::DOUBLE AS lng", "location, date")))
def _(s, d):
    raw = V.counts_text(s, d).select("location", "date").distinct()
    st, li = T.parse_location(F.col("location"))
    return raw.select("location", st.alias("street"), T.road_key(st).alias("road"), F.array_join(T.limits_keys(li), " / ").alias("crosses"),
                      T.year_of(F.col("date")).alias("yr")).where("street IS NOT NULL").distinct()


_LEGS = _PARSED + f""", c AS MATERIALIZED (SELECT *, {key_sql('street')} AS road, list_transform(string_split(limits,' & '), lambda t: {key_sql('t')}) AS crosses, year(date::DATE) AS yr FROM pc WHERE street IS NOT NULL AND total>0),
  st AS MATERIALIZED (SELECT site_id, lat AS slat, lon AS slon, leg, a AS street, {key_sql('a')} AS road, {key_sql('b')} AS crs FROM (SELECT *, 0 AS leg, split_part(name,' & ',1) AS a, split_part(name,' & ',2) AS b FROM sites WHERE name LIKE '% & %'
    UNION ALL SELECT *, 1, split_part(name,' & ',2), split_part(name,' & ',1) FROM sites WHERE name LIKE '% & %')),
  lim AS MATERIALIZED (SELECT site_id, leg, st.street, max(struct_pack(yr:=yr, total:=total, limits:=limits)) AS b FROM st JOIN c ON c.road=st.road AND list_contains(c.crosses, st.crs) GROUP BY ALL),
  nb AS (SELECT site_id, leg, street, b FROM (SELECT st.site_id, st.leg, st.street, struct_pack(yr:=yr, total:=total, limits:=limits) AS b, row_number() OVER (PARTITION BY st.site_id, st.leg ORDER BY sqrt(pow((lng-slon)*111320*cos(radians(slat)),2)+pow((lat-slat)*110540,2)), limits, total) AS rn
    FROM st JOIN c ON c.road=st.road WHERE lat IS NOT NULL AND sqrt(pow((lng-slon)*111320*cos(radians(slat)),2)+pow((lat-slat)*110540,2))<=2500 AND (site_id, leg) NOT IN (SELECT (site_id, leg) FROM lim)) WHERE rn=1),
  lg AS MATERIALIZED (SELECT site_id, leg, street, b.total AS adt, b.yr::INT AS year, b.limits AS limits, 'limits' AS method FROM lim UNION ALL SELECT site_id, leg, street, b.total, b.yr::INT, b.limits, 'nearby' FROM nb)"""


def legs(s, d):
    p = TR.parse_counts(V.counts_text(s, d)).where("parsed")
    return TR.legs(V.sites(s, d), p, max_m=2500.0)


@query("j20_w10_traffic_legs", sql("counts_text sites", "SELECT site_id, leg::INT AS leg, street, adt, year, limits, method FROM lg", _LEGS))
def _(s, d):
    return legs(s, d)


@query("j20_nearby_fallback", sql("counts_text sites", "SELECT site_id, leg::INT AS leg, street, adt, year, limits, method FROM lg",
                                  "other AS (SELECT * REPLACE (CASE WHEN name LIKE '% & %' THEN split_part(name,' & ',1)||' & Ninth Avenue' ELSE name END AS name) FROM sites), " + _LEGS.replace("FROM sites", "FROM other")))
def _(s, d):
    """Sites whose cross street no count names: every count stays, the nearest on the street decides."""
    p = TR.parse_counts(V.counts_text(s, d)).where("parsed")
    other = V.sites(s, d).withColumn("name", F.when(F.col("name").contains(" & "), F.concat(F.substring_index("name", " & ", 1), F.lit(" & Ninth Avenue"))).otherwise(F.col("name")))
    return TR.legs(other, p, max_m=2500.0)


@query("a20_entering_volume", sql("counts_text sites", "SELECT site_id, sum(adt)::BIGINT AS entering, count(*)=2 AS complete FROM lg GROUP BY 1", _LEGS))
def _(s, d):
    return TR.entering(legs(s, d)).select("site_id", "entering", "complete")


_REP = f"""rp AS MATERIALIZED (SELECT {pair_sql('ka','kb')} AS pair, dt::DATE AS date, injured, killed FROM (SELECT {key_sql("road1||' '||sfx1")} AS ka, {key_sql("road2||' '||sfx2")} AS kb, date_time[1:10] AS dt,
  coalesce(try_cast(injured AS DOUBLE)::INT,0) AS injured, coalesce(try_cast(killed AS DOUBLE)::INT,0) AS killed FROM reports_text WHERE road2 IS NOT NULL AND date_time[1:10]>='2000-01-01') WHERE ka<>'' AND kb<>'' AND ka<>kb)"""


@query("s15_f19_parse_reports", sql("reports_text", "SELECT pair, date, injured, killed, count(*) AS n FROM rp GROUP BY ALL", _REP))
def _(s, d):
    p = TR.parse_reports(reports_csv(s, d), "2000-01-01")
    return p.groupBy(*p.columns).agg(F.count("*").alias("n"))


@query("a19_reports_by_pair", sql("reports_text", "SELECT pair, count(*) AS n_reports, sum(injured)::BIGINT AS injured, sum(killed)::BIGINT AS killed, max(date) AS last FROM rp GROUP BY 1", _REP))
def _(s, d):
    return TR.reports_by_pair(TR.parse_reports(V.reports_text(s, d), "2000-01-01"))


@query("a19_reports_as_they_arrive", sql("reports_text", "SELECT pair, count(*) AS n_reports, sum(injured)::BIGINT AS injured, sum(killed)::BIGINT AS killed, max(date) AS last FROM rp GROUP BY 1", _REP))
def _(s, d):
    """The same totals from a stream of files, three increments after one another."""
    root = scratch_path(s, "stream")
    r = V.reports_text(s, d)
    r = r.toDF(*[c.lower() for c in r.columns])
    for i, (lo, hi) in enumerate((("0000", "2000-06"), ("2000-06", "2001-01"), ("2001-01", "9999"))):
        r.where(F.col("date_time").between(lo, hi) & (F.col("date_time") < hi)).coalesce(1).write.mode("append").option("header", True).csv(f"{root}/in")
        last = SR.keep_current(SR.by_pair_and_span(SR.report_stream(s, f"{root}/in"), "2000-01-01", "730 days"), f"{root}/table", f"{root}/state")
    return SR.current(s, f"{root}/table", last)


@query("j21_reports_by_site", sql("reports_text sites", f"""SELECT site_id, pair, n_reports, injured, killed, last FROM (SELECT site_id, {pair_sql('ka','kb')} AS pair FROM (SELECT site_id, {key_sql("split_part(name,' & ',1)")} AS ka,
  {key_sql("split_part(name,' & ',2)")} AS kb FROM sites WHERE name LIKE '% & %')) JOIN (SELECT pair, count(*) AS n_reports, sum(injured)::BIGINT AS injured, sum(killed)::BIGINT AS killed, max(date) AS last FROM rp GROUP BY 1) USING (pair)""", _REP))
def _(s, d):
    return TR.reports_by_site(V.sites(s, d), TR.reports_by_pair(TR.parse_reports(V.reports_text(s, d), "2000-01-01")))


@query("f16_two_figures", sql("", "SELECT o_orderkey, CASE WHEN o_totalprice IS NULL OR n=0 THEN 0 ELSE (floor(n/pow(10,greatest(0,floor(log10(n))-1))+0.5)*pow(10,greatest(0,floor(log10(n))-1)))::BIGINT END AS rounded FROM (SELECT *, floor(o_totalprice) AS n FROM orders)"))
def _(s, d):
    return V.table(s, d, "orders").select("o_orderkey", R.two_figures(F.floor("o_totalprice")).alias("rounded"))


def treated_and_pool(s, d):
    r = ranked(V.scored(s, d).select("site_id", "score_a", "council_district", "segment"), [("score_a", True), ("site_id", False)])
    far = F.when(F.col("site_id") % 350 == 7, 10_000).otherwise(0)
    r = r.select("site_id", (F.col("rank") + far).alias("rank"), "council_district", F.when(F.col("segment") != "MACHINERY", F.col("segment")).alias("control"),
                 F.when(F.col("site_id") % 5 != 0, F.col("site_id") % 40 * 1000 + 500).alias("entering"))
    return r.where("site_id % 50 = 7"), r, r.where("site_id % 50 = 9")


@query("j29_f15_matched_controls", sql("scored", """SELECT treated_id, control_id, control_rank, pos::INT AS pos, NULL::VARCHAR AS reason FROM mt UNION ALL
  SELECT site_id, NULL, NULL, NULL, CASE WHEN st IS NULL THEN 'rank in no stratum' ELSE 'no free match' END FROM r WHERE site_id%50=7 AND site_id NOT IN (SELECT treated_id FROM mt)""", """r AS (SELECT *, CASE WHEN rank<=100 THEN 0 WHEN rank<=300 THEN 1 WHEN rank<=800 THEN 2 WHEN rank<=10000 THEN 3 END AS st FROM (SELECT site_id, council_district,
  CASE WHEN segment<>'MACHINERY' THEN segment END AS control, CASE WHEN site_id%5<>0 THEN site_id%40*1000+500 END AS entering, row_number() OVER (ORDER BY score_a DESC, site_id)+CASE WHEN site_id%350=7 THEN 10000 ELSE 0 END AS rank FROM scored)),
  mt AS MATERIALIZED (SELECT * FROM (SELECT t.site_id AS treated_id, c.site_id AS control_id, c.rank AS control_rank, row_number() OVER (PARTITION BY t.site_id
  ORDER BY (c.council_district<>t.council_district)::INT, c.rank, c.site_id) AS pos FROM r t JOIN r c ON t.st=c.st WHERE t.site_id%50=7 AND c.site_id%50 NOT IN (7,9) AND (t.control IS NULL OR t.control=c.control)
  AND (t.entering IS NULL OR c.entering IS NULL OR c.entering BETWEEN t.entering/2.0 AND t.entering*2)) WHERE pos<=3)"""))
def _(s, d):
    """Every treated site has rows, also those whose rank lies outside all strata (one in seven is put there)."""
    t, pool, used = treated_and_pool(s, d)
    return tiers.matched_controls(t, pool, used, sid="site_id")


@query("k8_point_context", sql("reports_text sites", f"""SELECT printf('%.6f,%.6f',lat,lon) AS point_key, n_reports, last FROM (SELECT lat, lon, {pair_sql('ka','kb')} AS pair FROM (SELECT lat, lon, {key_sql("split_part(name,' & ',1)")} AS ka,
  {key_sql("split_part(name,' & ',2)")} AS kb FROM sites WHERE name LIKE '% & %')) JOIN (SELECT pair, count(*) AS n_reports, max(date) AS last FROM rp GROUP BY 1) USING (pair)""", _REP))
def _(s, d):
    from junctura.plans.export import point_context
    t = V.sites(s, d)
    r = TR.reports_by_site(t, TR.reports_by_pair(TR.parse_reports(V.reports_text(s, d), "2000-01-01")))
    return point_context(t.select("site_id", "lat", "lon").join(r, "site_id")).select("point_key", "n_reports", "last")
