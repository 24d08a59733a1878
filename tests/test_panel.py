from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from junctura.config import TABLE_PARAMS, Params, Windows
from junctura.functions import series as S
from junctura.plans import history as H, panel as L

SITES = [("A", 0.0, 0.0), ("B", 200.0, 0.0), ("C", 0.0, 200.0)]


def sites(spark):
    return spark.createDataFrame(SITES, "site_id string, x double, y double")


def test_snap_within_and_outside_buffer(spark):
    ev = spark.createDataFrame([("e1", 50.0, 0.0), ("e2", 110.0, 0.0), ("e3", 500.0, 500.0), ("e4", 95.0, 0.0)],
                               "event_id string, x double, y double")
    got = {r.event_id: r.site_id for r in L.snap(ev, sites(spark), 98.43).collect()}
    assert got == {"e1": "A", "e2": "B", "e4": "A"}
    both = {(r.event_id, r.site_id) for r in L.snap(ev, sites(spark), 160.0, "all_within_buffer").collect()}
    assert both == {("e1", "A"), ("e1", "B"), ("e2", "A"), ("e2", "B"), ("e4", "A"), ("e4", "B")}
    with pytest.raises(ValueError):
        L.snap(ev, sites(spark), 10.0, "nope")


def test_null_coordinates_never_snap(spark):
    ev = spark.createDataFrame([("e1", None, 0.0), ("e2", 1.0, 1.0)], "event_id string, x double, y double")
    assert [r.event_id for r in L.snap(ev, sites(spark), 50.0).collect()] == ["e2"]


def test_boundary_is_inclusive_and_ties_take_the_lowest_id(spark):
    ev = spark.createDataFrame([("e1", 100.0, 0.0)], "event_id string, x double, y double")
    assert L.snap(ev, sites(spark), 100.0).first().site_id == "A"


def test_eligibility_modes(spark):
    p = spark.createDataFrame([("A", 0, 0), ("B", 4, 1), ("C", 5, 1), ("D", 2, 2), ("E", 9, 3)], "site_id string, crashes_feat int, KSI_feat int")
    assert {r.site_id for r in L.eligible(p, TABLE_PARAMS, "city").collect()} == {"A", "B", "D"}
    assert {r.site_id for r in L.eligible(p, TABLE_PARAMS, "ksi_legacy").collect()} == {"A", "B", "C"}
    with pytest.raises(ValueError):
        L.eligible(p, TABLE_PARAMS, "other")


def test_window_wall_is_enforced():
    with pytest.raises(ValueError):
        Windows(date(2000, 1, 1), date(2001, 1, 1), date(2001, 1, 1), date(2001, 1, 1), date(2002, 1, 1), date(2000, 1, 1))


def series(spark, values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"y{i} double" for i in range(len(values))))
    ys = [F.col(f"y{i}") for i in range(len(values))]
    return df.select(S.slope(ys).alias("slope"), S.kendall_tau(ys).alias("tau"), S.changepoint(ys).alias("cp"),
                     S.ewma_last(ys, 0.4).alias("ewma"), S.momentum(ys).alias("mom"), S.acceleration(ys).alias("acc")).first()


def test_series_statistics(spark):
    up = series(spark, [0.0, 1.0, 2.0, 3.0, 4.0])
    assert up.slope == pytest.approx(1.0) and up.tau == pytest.approx(1.0) and up.mom == pytest.approx(3.5 / 0.5)
    flat = series(spark, [2.0] * 5)
    assert flat.slope == pytest.approx(0.0) and flat.tau == 0.0 and flat.cp == pytest.approx(0.26894, abs=1e-4) and flat.ewma == pytest.approx(2.0)
    down = series(spark, [4.0, 3.0, 2.0, 1.0])
    assert down.slope == pytest.approx(-1.0) and down.tau == pytest.approx(-1.0)
    one = series(spark, [3.0])
    assert one.slope == 0.0 and one.tau == 0.0 and one.cp == 0.0 and one.mom == 0.0 and one.acc == 0.0
    step = series(spark, [0.0, 0.0, 0.0, 8.0, 8.0, 8.0])
    assert step.cp > 0.99 and series(spark, [0.0, 0.0, 1.0, 3.0]).mom == pytest.approx(2.0)


def test_history_counts_on_coded_events(spark):
    rows = [("s", date(2017, 1, 1), "1", "Y", "N", "D", "B", "Y", "09"), ("s", date(2018, 1, 1), "2", "N", "Y", "D", "A", None, None),
            ("s", date(2019, 1, 1), "3", "N", "N", "A", "C", None, None), ("s", date(2020, 1, 1), "4", None, "N", None, "D", None, None),
            ("s", date(2021, 1, 1), "4", "N", "N", "D", None, None, None), ("s", date(2022, 1, 1), "1", "Y", "Y", "D", "B", "Y", "09")]
    df = spark.createDataFrame(rows, "site_id string, date date, severity string, ped string, bike string, collision string, lighting string, alcohol string, pcf string"
                               ).withColumn("is_left_turn", F.lit(False))
    df = df.withColumn("collision", F.when(F.col("date") == "2021-01-01", "B").otherwise(F.col("collision")))
    w = Windows(date(2016, 1, 1), date(2021, 12, 31), date(2022, 1, 1), date(2022, 1, 1), date(2024, 12, 31), date(2015, 1, 1))
    p = Params(windows=w)
    ids = spark.createDataFrame([("s",), ("quiet",)], "site_id string")
    f = {r.site_id: r for r in H.history_features(df, ids, p).collect()}
    assert (f["s"].crashes_72mo, f["s"].broadside_72mo, f["s"].night_72mo, f["s"].ped_crashes_72mo) == (5, 2, 3, 1)
    assert f["s"].worst_severity_72mo == 1 and f["s"].ped_row_violation_missing == 0
    q = f["quiet"]
    assert q.crashes_72mo == 0 and q.changepoint_prob == 0.0 and q.worst_severity_72mo == 5 and q.years_since_last_crash == pytest.approx(7.0, abs=0.01)


def test_yearly_rates(spark):
    def trend(counts):
        rows = [("s", 2016 + i, n) for i, n in enumerate(counts)]
        df = spark.createDataFrame(rows, "site_id string, year int, n int").select(
            "site_id", "year", F.lit(0).cast("bigint").alias("ksi"), F.lit(0).cast("bigint").alias("injury"), F.col("n").cast("bigint").alias("pdo"))
        n = H.nested_history(df)
        return n.select(*[c.alias(k) for k, c in H.rates(F.col("crash_history"), 2016, 2024, 2022).items()]).first()
    a = trend([1] * 9 + [9])
    assert a.years == 9 and a.per_year == pytest.approx(1.0) and a.trend == "steady"
    assert trend([0, 0, 0, 1, 0, 1, 2, 3, 2]).trend == "rising"
    assert trend([3] * 6 + [0, 1, 0]).trend == "falling"


def test_buffer_sweep_matches_separate_snaps(spark):
    ev = spark.createDataFrame([(i, date(2000, 5, 1), 1, float(i * 7 % 210), float(i * 3 % 90)) for i in range(60)],
                               "event_id int, date date, severity int, x double, y double")
    s = sites(spark)
    sweep = {r.radius_m: r for r in L.buffer_sweep(ev, s, TABLE_PARAMS).collect()}
    for r in TABLE_PARAMS.sweep_radii_m:
        n = L.snap(ev, s, r).groupBy("site_id").count().count()
        assert sweep[r].positives_ge1 == n and sweep[r].dist_0 == 3 - n


def test_params_are_values():
    assert replace(TABLE_PARAMS, screen_min=3).screen_min == 3
