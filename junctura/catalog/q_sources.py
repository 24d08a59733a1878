"""Sources (S rows), filters and flags (P1-P8), unions (U rows), sinks (K rows).

File sources are exercised on files that the query writes from the tables into the
shared scratch folder and reads back with the real reader."""

from pyspark.sql import functions as F

from junctura.catalog import query, views as V
from junctura.catalog.views import sql
from junctura.functions import records as R
from junctura.session import scratch_path
from junctura.plans import audits as Q
from junctura.sources import context as C, events as E, sinks
from junctura.sources.bundles import write_bundles
from junctura.sources.schemas import CRASH_TEXT_COLS

_LOAD = """ld AS (SELECT CASE_ID AS id, try_cast(COLLISION_DATE AS DATE) AS date, try_cast(COLLISION_SEVERITY AS INT) AS severity, POINT_X::DOUBLE AS lon, POINT_Y::DOUBLE AS lat, STATE_HWY_IND FROM crash_text
  WHERE STATE_HWY_IND IS DISTINCT FROM 'Y' AND try_cast(COLLISION_DATE AS DATE) IS NOT NULL AND try_cast(COLLISION_SEVERITY AS INT) IS NOT NULL AND POINT_X IS NOT NULL)"""


def crash_csv(s, d):
    """The text extract written as CSV and read back."""
    path = scratch_path(s, "crashes")
    sinks.write_csv(V.crash_text(s, d), path)
    return E.read_text_csv(s, path, CRASH_TEXT_COLS)


@query("s1_p2_p3_k2_crash_csv", sql("crash_text", "SELECT * FROM ld", _LOAD))
def _(s, d):
    return E.load_crashes(crash_csv(s, d))


@query("s1_extracts_with_other_headers", sql("crash_text", "SELECT * FROM ld", _LOAD))
def _(s, d):
    # two extracts of one layout: the second has its columns in reverse and lacks none
    path, t = scratch_path(s, "extracts"), V.crash_text(s, d)
    old = F.substring("COLLISION_DATE", 1, 4) < "1998"
    sinks.write_csv(t.where(old), f"{path}/a")
    sinks.write_csv(t.where(~F.coalesce(old, F.lit(False))).select(*reversed(t.columns)), f"{path}/b")
    return E.load_crashes(E.read_text_csv(s, [f"{path}/a", f"{path}/b"], CRASH_TEXT_COLS))


@query("s10_geojson_multipolygons", sql("region_edges", """SELECT g::BIGINT AS poly, count(*) AS n_vertices, count(DISTINCT poly) AS n_parts, round(min(least(x1,x2)),3) AS x0, round(max(greatest(y1,y2)),3) AS y1
  FROM (SELECT *, poly//5 AS g FROM region_edges) GROUP BY g"""))
def _(s, d):
    # five regions each as the parts of one feature
    v = V.regions(s, d)
    ring = v.groupBy("poly").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("pts"))
    parts = ring.groupBy(F.floor(F.col("poly") / 5).alias("g")).agg(F.collect_list(F.array("pts")).alias("parts"))
    feat = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiPolygon").alias("type"), F.col("parts").alias("coordinates")).alias("geometry"),
                    F.struct(F.col("g").cast("string").alias("poly")).alias("properties"))
    path = scratch_path(s, "multipolygons")
    parts.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feat).alias("features"))).alias("value")).write.text(path)
    r = C.read_polygons_geojson(s, path, "poly", multi_line=False)
    return r.groupBy("poly").agg(F.count("*").alias("n_vertices"), F.count_distinct("ring").alias("n_parts"), F.round(F.min("x"), 3).alias("x0"), F.round(F.max("y"), 3).alias("y1"))


@query("s1_coordinate_provenance", sql("crash_text", "SELECT count(*) AS n_raw, count(POINT_X) AS n_point_xy, count(LATITUDE) AS n_lat_lon, count(*) FILTER (STATE_HWY_IND='Y') AS n_state_hwy FROM crash_text"))
def _(s, d):
    return E.provenance(V.crash_text(s, d))


@query("s1_history_rows", sql("crash_text", "SELECT CASE_ID, COLLISION_DATE::DATE AS date, COLLISION_SEVERITY AS severity FROM crash_text WHERE STATE_HWY_IND IS DISTINCT FROM 'Y' AND try_cast(COLLISION_DATE AS DATE) IS NOT NULL AND POINT_X IS NOT NULL"))
def _(s, d):
    return E.history_rows(V.crash_text(s, d)).select("CASE_ID", "date", "severity")


@query("s2_latest_snapshot", sql("", "SELECT event_id, user_id, ts::DATE AS snap FROM events WHERE ts::DATE=(SELECT max(ts::DATE) FROM events)"))
def _(s, d):
    e = V.table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("snap"))
    return E.latest(e, "snap")


@query("s2_snapshot_folders", sql("", "SELECT max(strftime(o_orderdate,'%Y')||'0101') AS newest, count(DISTINCT year(o_orderdate)) AS n_snapshots FROM orders"))
def _(s, d):
    path = scratch_path(s, "snapshots")
    o = V.table(s, d, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("0101")).alias("snap"))
    sinks.write_table(o, path, ["snap"])
    f = E.snapshot_paths(s, f"{path}/*/*.parquet")
    return f.agg(F.max("snap").alias("newest"), F.count_distinct("snap").alias("n_snapshots"))


@query("s3_u1_merge_snapshots", sql("", """SELECT o_orderkey AS id, arg_min(o_totalprice, p) AS price, min(p)::INT AS origin FROM (SELECT o_orderkey, o_totalprice, 0 AS p FROM orders WHERE o_orderkey%3<>0 UNION ALL
  SELECT o_orderkey, o_totalprice+1, 1 FROM orders WHERE o_orderkey%5<>1) GROUP BY 1"""))
def _(s, d):
    o = V.table(s, d, "orders")
    a = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit(0).alias("origin"))
    b = o.where("o_orderkey % 5 <> 1").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") + 1).alias("price"), F.lit(1).alias("origin"))
    return E.merge_snapshots([a, b], "id")


@query("u2_distinct_keep_last", sql("", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts)::DATE AS day FROM events GROUP BY 1"))
def _(s, d):
    e = V.table(s, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").cast("date").alias("day"))


@query("s5_p1_p8_state_extract", sql("crash_text parties", """SELECT l.id AS crash_id, l.date, l.lat, l.lon, l.severity, coalesce(PEDESTRIAN_ACCIDENT='Y',false) AS is_ped, BICYCLE_ACCIDENT='Y' AS is_bike, coalesce(TYPE_OF_COLLISION='D',false) AS is_broadside,
  l.id IN (SELECT CASE_ID FROM parties WHERE MOVE_PRE_ACC='E') AS is_left_turn, coalesce(ALCOHOL_INVOLVED='Y',false) AS is_dui, LIGHTING IN ('B','C','D','E') AS is_night, coalesce(trim(PCF_VIOL_CATEGORY)='09',false) AS is_ped_row_violation,
  NULL::BOOLEAN AS at_intersection, false AS is_state_highway, NULL::VARCHAR AS functional_class, NULL::VARCHAR AS place_name, 'California' AS state_name, 'ksi' AS severity_scheme FROM ld l JOIN crash_text c ON c.CASE_ID=l.id""", _LOAD))
def _(s, d):
    return E.get_adapter("state_extract")(V.crash_text(s, d), V.parties(s, d))


@query("s6_j16_left_turn_cases", sql("parties", "SELECT DISTINCT CASE_ID FROM parties WHERE MOVE_PRE_ACC='E'"))
def _(s, d):
    return E.left_turn_ids(V.parties(s, d))


def census(s, d):
    """Orders as annual bundles of the national layout (numeric codes and decoded text)."""
    o, k = V.table(s, d, "orders"), F.col("o_orderkey")
    return o.select(
        F.year("o_orderdate").alias("bundle_year"), k.cast("string").alias("ST_CASE"), F.month("o_orderdate").cast("string").alias("MONTH"),
        F.when(k % 41 == 0, "99").otherwise(F.dayofmonth("o_orderdate").cast("string")).alias("DAY"),
        F.when(k % 43 == 0, "77.7777").otherwise((k % 30 + 20).cast("string")).alias("LATITUDE"), F.when(k % 47 == 0, "777.7").otherwise((-(k % 50) - 70).cast("string")).alias("LONGITUD"),
        F.when(k % 2 == 0, "Intersection").otherwise("Non-Junction").alias("RELJCT2NAME"),
        F.when(F.col("o_orderstatus") == "P", "Principal Arterial - Interstate").otherwise("Minor Arterial").alias("FUNC_SYSNAME"),
        F.when(k % 3 == 0, "Angle").otherwise("Front-to-Rear").alias("MAN_COLLNAME"), F.when(k % 4 == 0, "Dark - Lighted").otherwise("Daylight").alias("LGT_CONDNAME"),
        F.when(k % 5 == 0, "SPRINGFIELD").otherwise("Not Applicable").alias("CITYNAME"), F.when(k % 7 == 0, "Ohio").otherwise("Utah").alias("STATENAME"))


def zipped(s, rows, written, member):
    """Rows as annual zip bundles in the shared folder, read back through the data source."""
    path = scratch_path(s, "bundles")
    write_bundles(rows, path, written, "bundle_year")
    return E.map_columns(E.read_zipped_csv(s, f"{path}/*.zip", member), [c for c in rows.columns if c != "bundle_year"])


def census_people(s, d):
    li = V.table(s, d, "lineitem").join(V.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(F.year("o_orderdate").alias("bundle_year"), F.col("l_orderkey").cast("string").alias("ST_CASE"),
                     F.when(F.col("l_linenumber") == 1, "Pedestrian").when(F.col("l_linenumber") == 2, "Bicyclist").otherwise("Other").alias("PBPTYPENAME"))


@query("s4_p6_p7_fatal_census", sql("", """SELECT year(o_orderdate)||'-'||o_orderkey AS crash_id, o_orderdate::DATE AS date, (o_orderkey%30+20)::DOUBLE AS lat, (-(o_orderkey%50)-70)::DOUBLE AS lon, 1 AS severity,
  o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber=1) AS is_ped, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber=2) AS is_bike, o_orderkey%3=0 AS is_broadside, NULL::BOOLEAN AS is_left_turn,
  NULL::BOOLEAN AS is_dui, o_orderkey%4=0 AS is_night, NULL::BOOLEAN AS is_ped_row_violation, o_orderkey%2=0 AS at_intersection, false AS is_state_highway, 'Minor Arterial' AS functional_class,
  CASE WHEN o_orderkey%5=0 THEN 'SPRINGFIELD' ELSE 'Not Applicable' END AS place_name, 'Ohio' AS state_name, 'fatal_only' AS severity_scheme
  FROM orders WHERE o_orderkey%41<>0 AND o_orderkey%43<>0 AND o_orderkey%47<>0 AND o_orderstatus<>'P' AND o_orderkey%7=0"""))
def _(s, d):
    return E.fatal_census(zipped(s, census(s, d), "ACCIDENT.CSV", "accident.csv"), zipped(s, census_people(s, d), "PbType.csv", "pbtype.csv"), state="OHIO")


@query("s4_zipped_member_rows", sql("", """SELECT year(o_orderdate)::INT AS bundle_year, o_orderkey::VARCHAR AS "CASE", 'Peñasco' AS place, o_orderstatus AS status FROM orders"""))
def _(s, d):
    o = V.table(s, d, "orders").select(F.year("o_orderdate").alias("bundle_year"), F.col("o_orderkey").alias("CASE"), F.lit("Peñasco").alias("place"), F.col("o_orderstatus").alias("status"))
    return zipped(s, o, "Data/Cases.CSV", "cases.csv")


@query("s13_transit_stops", sql("places", "SELECT place_id::VARCHAR AS stop_id, y AS stop_lat, x AS stop_lon FROM places WHERE place_id%7<>0"))
def _(s, d):
    """Stops of zipped feeds, a feed for each kind of place; stops without a readable position drop out."""
    p = V.suppliers(s, d)
    t = p.select("amenity", F.col("place_id").alias("stop_id"), F.when(F.col("place_id") % 7 != 0, F.col("y")).alias("stop_lat"), F.col("x").alias("stop_lon"))
    path = scratch_path(s, "feeds")
    write_bundles(t, path, "stops.txt", "amenity", encoding="utf-8-sig")
    return C.transit_stops(s, f"{path}/*.zip")


@query("s8_open_data_crashes", sql("ev", "SELECT date, severity, lat, lon, true AS has_id FROM ev"))
def _(s, d):
    e = V.events(s, d).select(F.col("date").cast("string").alias("date_time"), F.col("severity").cast("string").alias("severity"), F.col("lat").cast("string").alias("latitude"), F.col("lon").cast("string").alias("longitude"))
    return E.open_data_crashes(e).select("date", "severity", "lat", "lon", (F.length("id") > 60).alias("has_id"))


@query("s9_k1_partitioned_parquet", sql("ev", "SELECT event_id, severity FROM ev WHERE year(date)=1997"))
def _(s, d):
    path = scratch_path(s, "curated")
    sinks.write_table(V.events(s, d).withColumn("year", F.year("date")), path, ["year"])
    return s.read.parquet(path).where("year = 1997").select("event_id", "severity")


def _pieces(df, key):
    """One JSON document per bucket of rows, so no document holds the whole table."""
    return df.groupBy(F.floor(F.col(key) / 500).alias("_b"))


@query("s10_geojson_points", sql("sites", "SELECT site_id::VARCHAR AS id, round(lon,6) AS lon, round(lat,6) AS lat FROM sites"))
def _(s, d):
    t = V.sites(s, d)
    feat = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
                    F.struct(F.col("site_id").cast("string").alias("id")).alias("properties"))
    path = scratch_path(s, "geojson")
    _pieces(t, "site_id").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feat).alias("features"))).alias("value")).select("value").write.option("lineSep", "\n").text(path)
    r = C.read_points_geojson(s, path, multi_line=False)
    return r.select(F.try_element_at("props", F.lit("id")).alias("id"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("s10_geojson_polygons", sql("region_edges", "SELECT poly, count(*) AS n_vertices, round(min(least(x1,x2)),3) AS x0, round(max(greatest(y1,y2)),3) AS y1 FROM region_edges GROUP BY 1"))
def _(s, d):
    v = V.regions(s, d)
    ring = v.groupBy("poly").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("pts"))
    feat = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array("pts").alias("coordinates")).alias("geometry"),
                    F.struct(F.col("poly").cast("string").alias("poly")).alias("properties"))
    path = scratch_path(s, "polygons")
    ring.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feat).alias("features"))).alias("value")).write.text(path)
    r = C.read_polygons_geojson(s, path, "poly", multi_line=False)
    return r.groupBy("poly").agg(F.count("*").alias("n_vertices"), F.round(F.min("x"), 3).alias("x0"), F.round(F.max("y"), 3).alias("y1"))


@query("s11_osm_elements", sql("sites", "SELECT CASE WHEN site_id%3=0 THEN 'way' ELSE 'node' END AS type, site_id AS id, round(lon,6) AS lon, round(lat,6) AS lat FROM sites WHERE site_id%5<>0 OR site_id%3<>0"))
def _(s, d):
    t, k = V.sites(s, d), F.col("site_id")
    way = k % 3 == 0
    el = F.struct(F.when(way, "way").otherwise("node").alias("type"), k.alias("id"), F.when(~way, F.col("lat")).alias("lat"), F.when(~way, F.col("lon")).alias("lon"),
                  F.when(way & (k % 5 != 0), F.struct("lat", "lon")).alias("center"), F.struct(F.col("name")).alias("tags"))
    path = scratch_path(s, "elements")
    _pieces(t, "site_id").agg(F.to_json(F.struct(F.collect_list(el).alias("elements"))).alias("value")).select("value").write.text(path)
    e = C.osm_elements(s, path, multi_line=False)
    return C.element_points(e).select("type", "id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("s12_graphml", sql("road_edges", "SELECT src, dst, lanes, count(*) AS n FROM road_edges GROUP BY ALL"))
def _(s, d):
    path = scratch_path(s, "graphml")
    sinks.write_graph_edges(V.road_edges(s, d).select("src", "dst", "lanes"), path)
    _, edges = C.read_graphml(s, path)
    return edges.select("src", "dst", F.nullif(F.try_element_at("attrs", F.lit("lanes")), F.lit("")).alias("lanes")).groupBy("src", "dst", "lanes").agg(F.count("*").alias("n"))


@query("s16_permits", sql("", "SELECT s_suppkey::VARCHAR AS facility_id, s_name AS name, CASE WHEN s_suppkey%3=0 THEN 'SAN DIEGO' ELSE 'CHULA VISTA' END AS city, s_suppkey%2=0 AS active, (32+s_suppkey%7)::DOUBLE AS lat FROM supplier WHERE s_suppkey%4<>3 AND s_suppkey%3=0"))
def _(s, d):
    k = F.col("s_suppkey")
    p = V.table(s, d, "supplier").select(
        k.cast("string").alias("record_id"), F.col("s_name").alias("record_name"), F.when(k % 3 == 0, "San Diego").otherwise("Chula Vista").alias("city"),
        F.when(k % 2 == 0, "yes").otherwise("N").alias("active_permit"), F.when(k % 4 == 3, "n/a").otherwise((k % 7 + 32).cast("string")).alias("latitude"), F.lit("-117").alias("longitude"))
    path = scratch_path(s, "permits")
    sinks.write_json(p, path)
    return C.read_permits(s, path, "San Diego").select("facility_id", "name", "city", "active", "lat")


@query("s18_volume_points", sql("counts_text", "SELECT lat::DOUBLE AS lat, try_cast(adt_total AS DOUBLE) AS adt_total, count(*) AS n FROM counts_text GROUP BY ALL"))
def _(s, d):
    path = scratch_path(s, "volumes")
    sinks.write_csv(V.counts_text(s, d), path)
    return C.read_volume_points(s, path).groupBy("lat", "adt_total").agg(F.count("*").alias("n"))


@query("s20_typed_lookup", sql("", "SELECT lpad(p_partkey::VARCHAR,8,'0') AS code, p_size AS size FROM part"))
def _(s, d):
    path = scratch_path(s, "lookup")
    sinks.write_csv(V.table(s, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"), F.col("p_size").alias("size")), path)
    return C.read_lookup(s, path, "code string, size int")


@query("s22_coordinate_choice", sql("crash_text", "SELECT CASE_ID, coalesce(POINT_X,LONGITUDE)::DOUBLE AS lon, coalesce(POINT_Y,LATITUDE)::DOUBLE AS lat FROM crash_text"))
def _(s, d):
    return E.best_coordinates(V.crash_text(s, d)).select("CASE_ID", "lon", "lat")


@query("f13_dates_from_parts", sql("", "SELECT o_orderkey, CASE WHEN o_orderkey%41<>0 THEN o_orderdate::DATE END AS date FROM orders"))
def _(s, d):
    c = census(s, d)
    return c.select(F.col("ST_CASE").cast("bigint").alias("o_orderkey"), R.safe_date(F.col("bundle_year").cast("string"), F.col("MONTH"), F.col("DAY")).alias("date"))


@query("f18_json_columns", sql("", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events"))
def _(s, d):
    return V.table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("u1_union_of_years", sql("", "SELECT year(o_orderdate)::INT AS yr, count(*) AS n FROM orders GROUP BY 1"))
def _(s, d):
    from functools import reduce
    o = V.table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("yr"))
    ends = o.agg(F.min("yr").alias("a"), F.max("yr").alias("b")).first()
    return reduce(lambda a, b: a.unionByName(b), [o.where(F.col("yr") == y) for y in range(ends["a"], ends["b"] + 1)]).groupBy("yr").agg(F.count("*").alias("n"))


@query("k6_manifest", sql("", """SELECT sha256(string_agg(l, '' ORDER BY k)) AS sha256, sum(length(l))::BIGINT AS bytes, count(*)-1 AS row_count, 'nation list' AS source, 'user-supplied' AS fetch_timestamp, 25::BIGINT AS n_raw, 1.0::DOUBLE AS coord_coverage
  FROM (SELECT n_nationkey AS k, n_nationkey||','||n_name||chr(10) AS l FROM nation UNION ALL SELECT -1, 'nation,name'||chr(10))"""))
def _(s, d):
    """A file's digest, size, rows and the coordinate statistics of its load."""
    path = scratch_path(s, "manifest")
    n = V.table(s, d, "nation")
    n.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name")).coalesce(1).sortWithinPartitions("nation").write.option("header", True).csv(path)
    rows = E.read_text_csv(s, path, ["nation", "name"])
    stats = Q.contract_stats(n.select(F.lit(1.0).alias("lat"), F.col("n_nationkey").cast("double").alias("lon"), F.current_date().alias("date"), F.lit(1).alias("severity"))).select("n_raw", "coord_coverage")
    return sinks.manifest(s, f"{path}/*.csv", "nation list", rows, stats).drop("file")


@query("k9_treatment_log", sql("scored", "SELECT site_id, 1+(hit>=1)::BIGINT AS entries FROM scored"))
def _(s, d):
    path = scratch_path(s, "log")
    t = V.scored(s, d)
    sinks.append_log(t.select("site_id", "name"), path)
    sinks.append_log(t.where("hit >= 1").select("site_id", "name"), path)
    return s.read.schema("site_id bigint, name string").option("header", True).csv(path).groupBy("site_id").agg(F.count("*").alias("entries"))
