import os
import subprocess
import sys
from datetime import date

import pytest
from pyspark.sql import functions as F

from junctura.functions import records as R, text as T
from junctura.operators import folds, ranking as K, resampling as B, tiers
from junctura.plans import audits as Q, export as X, infra as I, inspections as N, names as L, traffic as TR


@pytest.mark.parametrize("a,b", [("El Cajon Bl", "El Cajon Boulevard"), ("N 43rd St", "43rd Street"), ("Park Av", "park avenue"), ("Friars Rd.", "Friars Road"),
                                 ("W Mission Bay Dr", "Mission Bay Drive"), ("Camino del Rio South", "Camino Del Rio S"), ("Mt Ada Rd", "Mount Ada Road")])
def test_road_keys_agree(spark, a, b):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(T.road_key(F.col("a")), T.road_key(F.col("b"))).first()
    assert r[0] == r[1] != ""


def test_location_and_limits(spark):
    df = spark.createDataFrame([("El Cajon Blvd btwn 43rd St _ Van Dyke Ave",), ("Park Bl at Upas St",), ("Nowhere",), (None,)], "t string")
    s, li = T.parse_location(F.col("t"))
    got = df.select(s.alias("s"), li.alias("l"), T.limits_keys(li).alias("k")).collect()
    assert (got[0].s, got[0].l, got[0].k) == ("El Cajon Blvd", "43rd St & Van Dyke Ave", ["43rd street", "van dyke avenue"])
    assert (got[1].s, got[1].l) == ("Park Bl", "Upas St") and got[2].s is None and got[3].s is None
    y = spark.createDataFrame([("3/4/2019 0:00",), ("none",)], "t string").select(T.year_of(F.col("t")).alias("y")).collect()
    assert [r.y for r in y] == [2019, None]


def test_tags(spark):
    df = spark.createDataFrame([("2|1", "25 mph"), ("3", "40 km/h"), (None, None), ("unknown", "signals"), ("2;x;4", "fast")], "l string, s string")
    got = [tuple(r) for r in df.select(T.lanes_number(F.col("l")), T.speed_kph(F.col("s"), 40.0)).collect()]
    assert got[0] == (1.5, pytest.approx(40.2335)) and got[1] == (3.0, 40.0) and got[2] == (None, 40.0) and got[3] == (None, 40.0) and got[4] == (3.0, 40.0)
    t = spark.createDataFrame([("['a', 'b']",), ("x",), (None,)], "t string").select(T.tag_list(F.col("t")).alias("t")).collect()
    assert [r.t for r in t] == [["a", "b"], ["x"], []]


def test_traffic_legs(spark):
    sites = spark.createDataFrame([(1, "43rd Street & El Cajon Boulevard", 32.7551, -117.1035), (2, "Lone Road", 32.7, -117.1), (3, "Upas Street & Park Boulevard", 32.74, -117.146)],
                                  "site_id int, name string, lat double, lon double")
    c = [("El Cajon Bl", "43rd St & Van Dyke Ave", 15000, "2019-01-01", None, None), ("El Cajon Bl", "43rd St - Fairmount Av", 16841, "2023-05-01", None, None),
         ("43rd St", "El Cajon Bl - Meade Av", 9300, "2021-01-01", None, None), ("43rd St", "El Cajon Bl", 0, "2024-01-01", None, None),
         ("Park Bl", "Zoo Dr", 7000, "2022-01-01", 32.741, -117.146), ("Park Bl", "Far Av", 99999, "2024-01-01", 32.80, -117.146)]
    counts = spark.createDataFrame(c, "street string, limits string, total bigint, date string, lat double, lng double")
    legs = TR.legs(sites, counts)
    got = {(r.site_id, r.street): (r.adt, r.year, r.method) for r in legs.collect()}
    assert got == {(1, "El Cajon Boulevard"): (16841, 2023, "limits"), (1, "43rd Street"): (9300, 2021, "limits"), (3, "Park Boulevard"): (7000, 2022, "nearby")}
    e = {r.site_id: (r.entering, r.complete) for r in TR.entering(legs).collect()}
    assert e == {1: (26141, True), 3: (7000, False)}


def test_labels_from_roads(spark):
    e = spark.createDataFrame([
        (1, 2, ["primary"], ["El Cajon Boulevard"], None), (1, 3, ["residential"], ["43rd Street", "43rd St"], None),
        (4, 5, ["primary"], ["Park Boulevard"], None), (4, 6, ["service"], [], ["alley"]), (7, 8, ["tertiary"], ["Solo Way"], None)],
        "src int, dst int, highway array<string>, name array<string>, service array<string>")
    m = spark.createDataFrame([("x", 1), ("y", 4), ("z", 7), ("w", 99)], "site_id string, node int")
    got = {r.site_id: (r.label, r.method) for r in L.label_sites(m, e).collect()}
    assert got == {"x": ("43rd Street & El Cajon Boulevard", "cross"), "y": ("Park Boulevard & alley", "unnamed_cross"), "z": ("Solo Way", "single"), "w": ("Node w", "fallback")}


def test_node_attributes(spark):
    rows = [(0, i, ["primary"], "2", "25 mph") for i in range(1, 5)]
    e = spark.createDataFrame(rows, "src int, dst int, highway array<string>, lanes string, maxspeed string")
    r = I.node_attributes(e).where("node = 0").first()
    assert (r.edge_count, r.lane_count, r.approach_asymmetry, r.intersection_type, r.functional_class) == (4, 2.0, 0.0, 4, 3)


def test_combined_list_order_and_guards(spark):
    k = spark.createDataFrame([("K_low", 1, 9), ("K_high", 3, 2), ("K_tie", 1, 20)], "site_id string, ksi_history int, crashes_history int")
    s = spark.createDataFrame([("S5", 5), ("S9", 9), ("K_low", 7)], "site_id string, screen_count int")
    p = spark.createDataFrame([("P3", 3), ("P1", 1), ("K_high", 2)], "site_id string, model_rank bigint")
    rows = tiers.combined_list(k, s, p, 7, "site_id").orderBy("rank").collect()
    assert [r.site_id for r in rows] == ["K_high", "K_tie", "K_low", "S9", "S5", "P1", "P3"]
    by = {r.site_id: r for r in rows}
    assert by["K_high"].model_rank == 2 and by["K_low"].city_screen and by["K_tie"].model_rank is None and by["P1"].ksi_history == 0
    assert tiers.combined_list(k, s, p, 2, "site_id").count() == 2
    with pytest.raises(ValueError):
        tiers.combined_list(k, s, p, -1, "site_id")
    with pytest.raises(KeyError):
        tiers.combined_list(k.drop("crashes_history"), s, p, 5, "site_id")
    assert tiers.check_tier(k.union(k), "site_id", []).count() == 3


def test_export_nulls_and_emergents(spark):
    rows = [(1, 0.5, 99.0, False), (2, None, None, False), (3, 0.1, float("nan"), True)]
    df = spark.createDataFrame(rows, "rank bigint, score double, percentile double, is_known_emergent boolean").withColumns(
        {"lon": F.lit(-117.12345678), "lat": F.lit(32.7)})
    lines = {r["rank"]: r.value for r in X.feature_lines(X.listed(df, 2), ["rank", "score", "percentile"]).collect()}
    assert set(lines) == {1, 2, 3} and '"percentile":null' in lines[3] and '"score":null' in lines[2] and "NaN" not in "".join(lines.values())
    assert "[-117.123457,32.7]" in lines[1]
    bad = spark.createDataFrame([(1, 12, '{"a":1}', 5), (2, 3, '{"a":1}}', 5), (3, 4, "[1", 6)], "site_id int, council_district int, j string, node_id int")
    assert {r.check: r.n_bad for r in Q.export_violations(bad, ["j"]).collect()} == {"district": 1, "j": 2, "repeated_id": 1}


def test_matched_controls(spark):
    rows = [(i, i, 1 if i % 2 else 2, "signals" if i <= 8 else "stop", 90000 if i == 7 else 20000 if i != 5 else None) for i in range(1, 13)]
    s = spark.createDataFrame(rows, "site_id int, rank int, council_district int, control string, entering int")
    t, used = s.where("site_id = 1"), s.where("site_id = 3")
    got = [r.control_id for r in tiers.matched_controls(t, s, used, sid="site_id").orderBy("pos").collect()]
    assert got == [5, 2, 4]  # same district first, 7 is too busy, 3 was used, 9 and up are stop-controlled


def test_inspections(spark):
    v = [(date(2022, 3, 1), "routine", 95, 0, 1, False), (date(2022, 9, 1), "routine", 93, 0, 1, False), (date(2023, 3, 1), "routine", 91, 1, 0, False),
         (date(2023, 4, 1), "reinspection", 95, 0, 0, False), (date(2024, 3, 1), "routine", 90, 1, 1, True), (date(2024, 4, 1), "reinspection", 92, 0, 0, False),
         (date(2025, 3, 1), "routine", 94, 0, 1, False), (date(2025, 9, 3), "routine", 82, 2, 1, False)]
    df = spark.createDataFrame([("f", *r) for r in v], "facility_id string, date date, type string, score int, major int, minor int, closed boolean").withColumn(
        "grade", F.lit(None).cast("string"))
    r = N.inspection_stats(df, ["date"]).first()
    assert (r.closures, r.reinspections, r.last_grade, r.trend, r.last_score, r.n_routine) == (1, 2, "B", "worsening", 82, 6)
    assert r.majors_36mo == 4
    t = spark.createDataFrame([("f", date(2024, 1, 1), "vermin", "minor"), ("f", date(2024, 2, 1), "vermin", "minor"), ("f", date(2024, 1, 1), "temperature", "major"),
                               ("f", date(2025, 1, 1), "storage", "minor"), ("f", date(2025, 1, 1), "mystery", "minor")], "facility_id string, date date, theme string, severity string")
    th = N.theme_counts(t).orderBy("pos").collect()
    assert [x.theme for x in th] == ["temperature", "vermin", "other", "storage"]


def test_route_order(spark):
    path = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1000.0, 0.0)], "path_id int, seq int, x double, y double")
    s = spark.createDataFrame([("b", 700.0, 22.0), ("a", 100.0, 0.0), ("c", 500.0, 110.0)], "site_id string, x double, y double")
    got = I.sites_along(path, s, 35.0).orderBy("along_m").collect()
    assert [(r.site_id, round(r.meters), round(r.along_m)) for r in got] == [("a", 0, 100), ("b", 22, 700)]


def test_sites_along_crossing_paths_in_small_blocks(spark, monkeypatch):
    """Paths that come back to a site, blocks smaller than a cell, turns shorter than a path, and a long path, against every pair."""
    import math
    import random
    r = random.Random(4)
    v = [(p, i, r.uniform(0, 400) + 40 * p, r.uniform(0, 400)) for p in range(12) for i in range(2 + p)] + [(99, i, 100.0, 100.0) for i in range(2)]
    si = [(f"s{i}", float(r.randrange(0, 900)), float(r.randrange(-40, 440))) for i in range(300)]
    path = spark.createDataFrame(v, "path_id int, seq int, x double, y double")
    s = spark.createDataFrame([*si, ("none", None, 1.0)], "site_id string, x double, y double")
    want = {}
    for p in {q[0] for q in v}:
        at, cum = [q for q in v if q[0] == p], 0.0
        for a, b in zip(at[:-1], at[1:]):
            dx, dy = b[2] - a[2], b[3] - a[3]
            for i, x, y in si:
                t = max(0.0, min(1.0, ((x - a[2]) * dx + (y - a[3]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                d = math.hypot(x - a[2] - t * dx, y - a[3] - t * dy)
                if d <= 35.0:
                    want[p, i] = min(want.get((p, i), (1e9, 0, 0)), (round(d, 6), a[1], cum + t * math.hypot(dx, dy)))
            cum += math.hypot(dx, dy)
    for block, pairs, window in ((4096, 1_000_000, 100_000), (5, 3, 100_000), (5, 40, 11)):
        monkeypatch.setattr(I, "ALONG_BLOCK", block, raising=False)
        monkeypatch.setattr(I, "_PAIRS", pairs, raising=False)
        monkeypatch.setattr(I, "PATH_WINDOW_ROWS", window)
        out = I.sites_along(path, s, 35.0)
        if window == 100_000:  # no pair of path and site is shuffled
            assert "min_by" not in out._jdf.queryExecution().toString()
        got = {(q.path_id, q.site_id): (q.meters, q.along_m) for q in out.collect()}
        assert got.keys() == want.keys() and out.count() == len(want)
        for k, w in want.items():
            assert got[k] == pytest.approx((w[0], w[2]), abs=1e-5)


def test_long_paths_measure_the_same(spark, monkeypatch):
    path = spark.createDataFrame([(p, i, float(i * (p + 1)), float(i % 3)) for p in range(2) for i in range(25)], "path_id int, seq int, x double, y double")
    a = {(r.path_id, r.seq): (r.nx, round(r.cum, 6)) for r in I.path_lengths(path).collect()}
    monkeypatch.setattr(I, "PATH_WINDOW_ROWS", 5)
    monkeypatch.setattr(I, "PATH_CHUNK", 4)
    assert a == {(r.path_id, r.seq): (r.nx, round(r.cum, 6)) for r in I.path_lengths(path).collect()}


def test_folds_and_ranks(spark):
    df = spark.range(200).select(F.col("id").alias("site_id"), (F.col("id") % 10).alias("block"), (F.col("id") % 4 == 0).cast("int").alias("y"), F.lit(0.5).alias("score"))
    b = folds.block_folds(df, "block", 5)
    assert b.count() == 200 and b.groupBy("block").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    st = folds.stratified_folds(df, "site_id", "y", 5, 42).groupBy("fold").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    assert {(r.p, r.n) for r in st} == {(10, 40)}
    r = K.ranked(df, [("score", True), ("site_id", False)])  # one score for every row still ranks exactly
    assert r.where(F.col("rank") != F.col("site_id") + 1).count() == 0 and Q.rank_gaps(r).first().ok


def test_paired_interval_is_narrow_and_zero_for_equal(spark):
    df = spark.range(400).select(F.col("id").alias("site_id"), (F.col("id") % 8 == 0).cast("int").alias("y"), (F.col("id") + 1).alias("ra"),
                                 (F.when(F.col("id") % 8 == 0, F.col("id") / 2).otherwise(F.col("id")) + 1).alias("rb"))
    d = B.draws_of_positives(df, "site_id", "y", 200, ["ra", "rb"])
    assert d.count() == 200 * 50
    same = B.paired_delta(d, "ra", "ra", 100).first()
    assert (same.delta, same.lo, same.hi, same.p_better) == (0.0, 0.0, 0.0, 0.0)
    p = B.paired_delta(d, "rb", "ra", 100).first()
    a, b = B.recall_interval(d, "site_id", "ra", 100).first(), B.recall_interval(d, "site_id", "rb", 100).first()
    assert p.delta > 0 and p.hi - p.lo < (a.hi - a.lo) + (b.hi - b.lo)
    assert B.recall_interval(d, "site_id", "ra", 100, unique=True).first()["mean"] < a["mean"]


def test_small_rules(spark):
    r = spark.createDataFrame([(36821.0, 55, 210)], "n double, score int, rank int").select(
        R.two_figures(F.col("n")), R.grade_for(F.col("score")), R.tier_for(F.col("rank"))).first()
    assert tuple(r) == (37000, "C", "Moderate risk")
    assert T.search_tokens("Balboa and Genesee Ave.") == ["balboa", "genesee", "avenue"]
    lab = spark.createDataFrame([("EWMA crash rate 3.1",), ("0.4 years since last crash",), ("2.0 years since last crash",), ("72 km/h speed limit",), ("novel label",)], "display_label string")
    got = {x.display_label: (x.plain, x.matched) for x in X.plain_language(lab).collect()}
    assert got["0.4 years since last crash"][0] == "A crash within the past year" and got["72 km/h speed limit"][0] == "45 mph speed limit"
    assert got["2.0 years since last crash"][0] == "The last crash was about 2 years ago" and got["novel label"] == ("novel label", False)


def test_repeated_tier_ids_are_errors_and_ranks_outside_the_strata_have_a_reason(spark):
    known = spark.createDataFrame([(1, 2, 3), (1, 2, 3)], "site_id bigint, ksi_history bigint, crashes_history bigint")
    screen = spark.createDataFrame([(2, 9)], "site_id bigint, screen_count bigint")
    predicted = spark.createDataFrame([(3, 1)], "site_id bigint, model_rank bigint")
    with pytest.raises(ValueError, match="known"):
        tiers.combined_list(known, screen, predicted, 5, "site_id")
    sites = spark.createDataFrame([(1, 10_500, "signal", 100, 1), (2, 5, "signal", 100, 1)], "site_id bigint, rank int, control string, entering int, council_district int")
    got = {r.treated_id: (r.control_id, r.reason) for r in tiers.matched_controls(sites.where("site_id < 3"), sites, sites.where("false"), sid="site_id").collect()}
    assert got == {1: (None, "rank in no stratum"), 2: (None, "no free match")}


def test_hot_exposure_buckets_match_like_brute_force(spark):
    """A third of the sites has no exposure and all share one stratum; the cut lists lose nobody."""
    rows = [(i, 1 + i % 99, ["signal", "stop", None][i % 3], None if i % 3 == 0 else 100 + i % 400, i % 4) for i in range(400)]
    sites = spark.createDataFrame(rows, "site_id bigint, rank int, control string, entering int, council_district int")
    got = {}
    for r in tiers.matched_controls(sites.where("site_id % 20 = 7"), sites, sites.where("site_id % 20 = 9"), sid="site_id").where("pos is not null").collect():
        got.setdefault(r.treated_id, {})[r.pos] = r.control_id
    for t in [r for r in rows if r[0] % 20 == 7]:
        ok = [c for c in rows if c[0] % 20 not in (7, 9) and (t[2] is None or c[2] == t[2]) and (t[3] is None or c[3] is None or t[3] / 2 <= c[3] <= t[3] * 2)]
        want = [c[0] for c in sorted(ok, key=lambda c: (c[4] != t[4], c[1], c[0]))[:3]]
        assert [got[t[0]][k + 1] for k in range(len(want))] == want


def test_matched_controls_query_runs_past_the_last_stratum(spark, monkeypatch):
    from junctura import catalog
    from junctura.catalog import views as V
    catalog.load_all()
    n = 10_200
    sites = spark.range(n).select(F.col("id").alias("site_id"), (-F.col("id")).alias("score_a"), (F.col("id") % 7).cast("int").alias("council_district"),
                                  F.lit("BUILDING").alias("segment"))
    monkeypatch.setattr(V, "scored", lambda s, d: sites)
    got = catalog.QUERIES["j29_f15_matched_controls"](spark, "").collect()
    reasons = {r.treated_id: r.reason for r in got}
    assert set(reasons) == set(range(7, n, 50))
    assert {i for i, why in reasons.items() if why == "rank in no stratum"} == {i for i in reasons if i >= 10_000 or i % 350 == 7}
    assert all((r.control_id is None) == (r.reason is not None) for r in got)


def test_staging_without_a_checkpoint_folder(tmp_path):
    """A local session with the key unset stages in a folder of its own; checked in a fresh process."""
    code = ("from junctura.session import build_session, stage\ns = build_session('local[1]', 1)\n"
            "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
            "a, b = stage(s.range(3)), stage(s.range(4))\nassert a.count() == 3 and b.count() == 4\n"
            "assert a._staged_at.rsplit('/', 1)[0] == b._staged_at.rsplit('/', 1)[0]\n")
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_CONF_DIR", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], env=env | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
