import io
import json
import zipfile
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from junctura.functions import geo as G
from junctura.plans import audits as Q, infra as I, traffic as TR
from junctura.sources import context as C, events as E, sinks

CANON = "crash_id string, date date, lat double, lon double, severity int"


def test_contract_errors_and_invalid_rows(spark):
    with pytest.raises(ValueError):
        E.finalize(spark.createDataFrame([("a", 1.0)], "crash_id string, lat double"))
    rows = [("a", date(2020, 1, 1), 32.7, -117.1, 1), ("b", date(2020, 1, 1), 32.7, -117.1, 2), ("c", None, 32.7, -117.0, 3),
            ("d", date(2020, 1, 1), None, -117.0, 3), ("e", date(2020, 1, 1), 95.0, 0.0, 3), ("f", date(2020, 1, 1), 1.0, 1.0, 9)]
    df = spark.createDataFrame(rows, CANON)
    out = E.finalize(df)
    assert {r.crash_id for r in out.collect()} == {"a", "b"}
    assert out.select("is_ped").distinct().first().is_ped is None  # unknown stays unknown
    st = Q.contract_verdict(Q.contract_stats(df)).first()
    assert (st.n_raw, st.n_bad_coords, st.n_bad_dates, st.n_bad_severity, st.max_at_one_coord) == (6, 2, 1, 1, 2)
    assert Q.contract_verdict(Q.contract_stats(df.limit(0))).first().verdict == "EMPTY"
    with pytest.raises(ValueError):
        Q.require_empty(df, "rows")
    Q.require_empty(df.limit(0), "rows")


def test_unknown_highway_marker_is_kept(spark):
    cols = ["CASE_ID", "COLLISION_DATE", "COLLISION_SEVERITY", "POINT_X", "POINT_Y", "STATE_HWY_IND"]
    df = spark.createDataFrame([("1", "2020-01-01", "1", "-117", "32", None), ("2", "2020-01-01", "1", "-117", "32", "Y"),
                                ("3", "bad", "1", "-117", "32", "N"), ("4", "2020-01-01", None, "-117", "32", "N")], ", ".join(f"{c} string" for c in cols))
    assert {r.id for r in E.load_crashes(df).collect()} == {"1"}


def test_csv_header_order_and_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("severity,CASE_ID\n1,007\n")
    r = E.read_text_csv(spark, str(tmp_path / "a.csv"), ["CASE_ID", "SEVERITY", "OTHER"]).first()
    assert (r.CASE_ID, r.SEVERITY, r.OTHER) == ("007", "1", None)


def test_csv_files_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n2,1\n")
    (tmp_path / "c d.csv").write_text("a\n9\n")
    r = E.read_text_csv(spark, str(tmp_path), ["a", "b"]).collect()
    assert sorted((x.a, x.b) for x in r if x.b) == [("1", "2"), ("1", "2")] and [x.a for x in r if x.b is None] == ["9"]


def test_multi_part_features(spark, tmp_path):
    square = lambda x: [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]]
    feats = [("MultiPolygon", [square(0), square(5)], 1), ("Polygon", square(9), 2), ("MultiPoint", [[1, 2], [3, 4]], 3), ("Point", [5, 6], 4)]
    path = tmp_path / "f.json"
    path.write_text(json.dumps({"features": [{"geometry": {"type": t, "coordinates": c}, "properties": {"id": str(i)}} for t, c, i in feats]}))
    rings = Counter((r.poly, r.ring) for r in C.read_polygons_geojson(spark, str(path), "id").collect())
    assert rings == {(1, 0): 5, (1, 1): 5, (2, 0): 5}
    assert sorted((r.lon, r.lat) for r in C.read_points_geojson(spark, str(path)).collect()) == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]


def test_first_listed_snapshot_wins(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "id int, v string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "id int, v string")
    assert {r.id: r.v for r in E.merge_snapshots([a, b], "id").collect()} == {1: "a", 2: "a", 3: "b"}


def bundle(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text, enc in files:
            z.writestr(name, text.encode(enc))


def test_zipped_bundles(spark, tmp_path):
    acc = "ST_CASE,MONTH,DAY,LATITUDE,LONGITUD,RELJCT2,RELJCT2NAME,FUNC_SYSNAME,MAN_COLLNAME,LGT_CONDNAME,CITYNAME,STATENAME,PEDS\n"
    acc += "1,2,30,32.7,-117.1,2,Intersection,Local,Angle,Daylight,San José,California,1\n"
    acc += "2,2,3,77.7777,-117.1,2,Intersection-Related,Interstate,Rear,Dark,X,California,0\n"
    acc += "3,2,3,32.7,-117.1,2,Intersection-Related,Local,Rear,Dusk,X,California,0\n"
    bundle(tmp_path / "FARS2021NationalCSV.zip", [("FARS2021/ACCIDENT.CSV", acc, "latin-1"), ("pbtype.csv", "ST_CASE,PBPTYPENAME\n3,Bicyclist\n", "latin-1")])
    bundle(tmp_path / "FARS2022NationalCSV.zip", [("accident.csv", acc, "latin-1")])
    pat = str(tmp_path / "*.zip")
    names = ["ST_CASE", "MONTH", "DAY", "LATITUDE", "LONGITUD", "RELJCT2", "RELJCT2NAME", "FUNC_SYSNAME", "MAN_COLLNAME", "LGT_CONDNAME", "CITYNAME", "STATENAME", "PEDS", "YEAR"]
    a = E.map_columns(E.read_zipped_csv(spark, pat, "accident.csv"), names)
    assert a.count() == 6 and a.where("ST_CASE='1'").first().CITYNAME == "San José"
    p = E.map_columns(E.read_zipped_csv(spark, pat, "PBTYPE.csv"), ["ST_CASE", "PBPTYPENAME"])
    c = {r.crash_id: r for r in E.fatal_census(a, p).collect()}
    assert set(c) == {"2021-3", "2022-3"}  # impossible date, sentinel and freeway rows are gone
    assert c["2021-3"].is_bike and not c["2022-3"].is_bike and c["2021-3"].is_night and c["2021-3"].at_intersection
    assert c["2021-3"].is_dui is None and c["2021-3"].severity_scheme == "fatal_only"
    n = {r.crash_id: r for r in E.fatal_census(a, None, exclude_freeway=False).collect()}
    assert n["2021-3"].is_bike is None and n["2021-3"].is_ped is False
    assert Q.ksi_guard(E.fatal_census(a)).count() == 2
    with pytest.raises(KeyError):
        E.get_adapter("nope")


def test_transit_feed(spark, tmp_path):
    bundle(tmp_path / "feed.zip", [("stops.txt", "stop_id,stop_lat,stop_lon\nS1,32.7,-117.1\nS2,,-117.1\n", "utf-8-sig"), ("routes.txt", "x\n1\n", "utf-8")])
    bundle(tmp_path / "empty.zip", [("stops.txt", "stop_id,stop_name\nS9,x\n", "utf-8")])
    got = [tuple(r) for r in C.transit_stops(spark, str(tmp_path / "*.zip")).collect()]
    assert got == [("S1", 32.7, -117.1)]


def test_geojson_osm_and_graphml(spark, tmp_path):
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"a": "b"}}]}, indent=1))
    r = C.read_points_geojson(spark, str(tmp_path / "p.geojson")).first()
    assert (r.lon, r.lat, r.props["a"]) == (1.0, 2.0, "b")
    (tmp_path / "q.geojson").write_text(json.dumps({"features": [
        {"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {"DISTRICT": "3"}}]}))
    v = C.read_polygons_geojson(spark, str(tmp_path / "q.geojson"), "DISTRICT")
    assert v.count() == 4 and v.first().poly == 3
    (tmp_path / "o.json").write_text(json.dumps({"elements": [
        {"type": "node", "id": 1, "lat": 2.0, "lon": 3.0, "tags": {"highway": "stop"}}, {"type": "way", "id": 2, "center": {"lat": 4.0, "lon": 5.0}},
        {"type": "way", "id": 3, "geometry": [{"lat": 0.0, "lon": 0.0}, {"lat": 1.0, "lon": 1.0}]}]}))
    e = C.osm_elements(spark, str(tmp_path / "o.json"))
    assert {(r.id, r.lon) for r in C.element_points(e).collect()} == {(1, 3.0), (2, 5.0)} and C.element_lines(e).count() == 1
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="7"><data key="y">1.5</data></node><edge source="1" target="3"><data key="lanes">2|1</data></edge></graph></graphml>')
    n, g = C.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert n.first().attrs["y"] == "1.5" and g.first().attrs["lanes"] == "2|1"


def test_sinks_log_manifest_and_lookup(spark, tmp_path):
    df = spark.createDataFrame([("007", 1)], "k string, v int")
    log = str(tmp_path / "log")
    sinks.append_log(df, log)
    sinks.append_log(df, log)
    assert C.read_lookup(spark, log, "k string, v int").count() == 2
    m = sinks.manifest(spark, f"{log}/*.csv", "log").first()
    assert len(m.sha256) == 64 and m.source == "log"
    sinks.write_context(df.withColumn("point_key", F.lit("1,2")), str(tmp_path / "ctx"))
    assert json.loads(spark.read.text(str(tmp_path / "ctx")).first().value) == {"point_key": "1,2", "record": {"k": "007", "v": 1}}


def test_open_data_ids_do_not_depend_on_order(spark):
    rows = [("2020-01-01", "32.7", "-117.1"), ("2020-01-01", "32.7", "-117.1"), ("2020-01-02", "x", "-117.1")]
    df = spark.createDataFrame(rows, "date_time string, latitude string, longitude string")
    a = {r.id for r in E.open_data_crashes(df).collect()}
    assert len(a) == 2 and a == {r.id for r in E.open_data_crashes(df.orderBy(F.desc("date_time"))).collect()}


def test_projection_against_known_points(spark):
    df = spark.createDataFrame([(-117.1625, 32.715, 11), (2.2945, 48.8582, 31), (151.2153, -33.8568, 56)], "lon double, lat double, zone int")
    x, y = G.utm_xy(F.col("lon"), F.col("lat"), F.col("zone"))
    got = [(round(r[0]), round(r[1])) for r in df.select(x, y).collect()]
    assert abs(got[1][0] - 448252) < 3 and abs(got[1][1] - 5411943) < 30
    assert abs(got[2][0] - 334873) < 60 and abs(got[2][1] - 6252266) < 60
    z = [r[0] for r in df.select(G.utm_epsg(F.col("lon"), F.col("lat"))).collect()]
    assert z == ["EPSG:32611", "EPSG:32631", "EPSG:32756"]
    e, n = G.lambert_ft(F.col("lon"), F.col("lat"))
    r = df.limit(1).select(e, n).first()
    # On the zone's central meridian the easting is the false easting.
    c = spark.createDataFrame([(-116.25, 32.1666666667)], "lon double, lat double").select(*G.lambert_ft(F.col("lon"), F.col("lat"))).first()
    assert c[0] == pytest.approx(2_000_000 * 3937 / 1200, abs=0.01) and c[1] == pytest.approx(500_000 * 3937 / 1200, abs=0.5)
    assert r[0] < c[0] and r[1] > c[1]


def test_raster_slope(spark):
    flat = spark.createDataFrame([(r, c, 100.0) for r in range(10) for c in range(10)], "row int, col int, elev double")
    assert I.slope_from_raster(flat, 1.0).agg(F.max("slope_pct")).first()[0] == 0.0
    ramp = spark.createDataFrame([(r, c, float(c)) for r in range(5) for c in range(5)], "row int, col int, elev double")
    got = {(r.row, r.col): r.slope_pct for r in I.slope_from_raster(ramp, 1.0).collect()}
    assert got[(2, 2)] == pytest.approx(100.0) and got[(2, 0)] == pytest.approx(50.0)


def test_police_reports(spark):
    cols = "REPORT_ID string, DATE_TIME string, ADDRESS_ROAD_PRIMARY string, ADDRESS_SFX_PRIMARY string, ADDRESS_NAME_INTERSECTING string, ADDRESS_SFX_INTERSECTING string, INJURED string, KILLED string"
    rows = [("1", "2025-03-01 10:00:00", "EL CAJON", "BOULEVARD", "43RD", "STREET", "1", "0"), ("2", "2025-09-10 10:00:00", "43RD", "ST", "EL CAJON", "BL", "2", "1"),
            ("3", "2024-12-31 10:00:00", "43RD", "ST", "EL CAJON", "BL", "9", "9"), ("4", "2025-03-01 10:00:00", "EL CAJON", "BL", None, None, "1", "0"),
            ("5", "2025-03-01 10:00:00", "EL CAJON", "BL", "EL CAJON", "BOULEVARD", "1", "0"), ("6", "2025-03-02 10:00:00", "PARK", "BL", "UPAS", "ST", "", "x")]
    p = TR.parse_reports(spark.createDataFrame(rows, cols), "2025-01-01")
    assert p.count() == 3
    by = TR.reports_by_pair(p)
    site = TR.reports_by_site(spark.createDataFrame([(1, "43rd Street & El Cajon Boulevard"), (2, "Lone Street")], "site_id int, name string"), by).first()
    assert (site.site_id, site.n_reports, site.injured, site.killed, site["last"]) == (1, 2, 3, 1, date(2025, 9, 10))
