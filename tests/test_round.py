"""Bootstraps, splits, paths, crowded spots, bundles and streams against plain computations."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.operators import proximity as X, resampling as B
from junctura.plans import infra as I, models as M, traffic as TR
from junctura.sources import bundles as Z, events as E
from junctura.streaming import reports as SR


def plain_metrics(rows, b, k):
    """One replicate by exploding its rows."""
    w = []
    for i, s, y in rows:
        d = hashlib.md5(f"bs|{b // 4}|{i}".encode()).digest()[4 * (b % 4):4 * (b % 4) + 4]
        u = int.from_bytes(d, "big") / 2**32
        w.append(sum(u >= c for c in B.POISSON1))
    n, p = sum(w), sum(a for a, r in zip(w, rows) if r[2] >= 1)
    if not 0 < p < n:
        return None
    auprc = auroc = hits = seen = pos = 0.0
    for s in sorted({r[1] for r in rows}, reverse=True):
        g = [(a, r[2]) for a, r in zip(w, rows) if r[1] == s]
        gn, gp = sum(a for a, _ in g), sum(a for a, y in g if y >= 1)
        if gn:
            hits += gp * min(max((k - seen) / gn, 0), 1)
        seen, pos = seen + gn, pos + gp
        if gn:
            auprc += gp * pos / seen
            auroc += gp * ((n - p) - (seen - pos) + (gn - gp) / 2)
    x = np.repeat([r[1] for r in rows], w), np.repeat([r[2] for r in rows], w)
    rank = [np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v]) for v in x]
    mu, y = np.maximum(x[0], 1e-6), x[1].astype(float)
    tw = (2 * (y**0.7 / (-0.3 * 0.7) - y * mu**-0.3 / -0.3 + mu**0.7 / 0.7)).mean()
    return [auprc / p, auroc / (p * (n - p)), hits / p, hits / min(k, n), np.corrcoef(*rank)[0, 1], tw, (2 * (y * np.log(y / mu + 1e-10) - (y - mu))).mean()]


def test_bootstrap_equals_exploded_rows(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, 0.5 if i % 3 == 0 else round(r.random(), 2), r.choice([0, 0, 0, 1, 2])) for i in range(150)]  # a third shares one score
    df = spark.createDataFrame(rows + [(900, None, 1), (901, 0.2, None)], "site_id long, s double, y int")
    got = {q.b: q for q in B.bootstrap_metrics(df, "s", "y", "site_id", 22, ks=(20,)).collect()}
    assert len(got) == 22
    for b in range(22):
        want = plain_metrics(rows, b, 20)
        assert [got[b][c] for c in B.metric_names((20,))] == pytest.approx(want, rel=1e-9)
    # two keys at once, and nothing but zeros: binary metrics are null, the others stand
    two = df.withColumn("arm", F.lit("a")).unionByName(df.withColumn("y", F.lit(0)).withColumn("arm", F.lit("z")))
    by = {(q.arm, q.b): q for q in B.bootstrap_metrics(two, "s", "y", "site_id", 6, ks=(20,), key="arm").collect()}
    assert by["a", 3].auprc == pytest.approx(got[3].auprc) and by["z", 3].auprc is None and by["z", 3].spearman_rho is None and by["z", 3].tweedie_deviance > 0


def test_long_and_short_paths_are_measured_alike(spark, monkeypatch):
    r = random.Random(2)
    rows = [(p, k, r.random() * 100, r.random() * 100) for p in range(6) for k in range(40 if p == 2 else 4)]
    v = spark.createDataFrame(rows, "path_id long, seq long, x double, y double")
    monkeypatch.setattr(I, "PATH_WINDOW_ROWS", 10)
    monkeypatch.setattr(I, "PATH_CHUNK", 7)
    got = {(q.path_id, q.seq): q for q in I.path_lengths(v).collect()}
    for p in range(6):
        cum = 0.0
        mine = [q for q in rows if q[0] == p]
        for a, b in zip(mine, mine[1:] + [None]):
            assert got[a[0], a[1]].cum == pytest.approx(cum)
            assert (got[a[0], a[1]].nx is None) == (b is None)
            cum += math.dist(a[2:], b[2:]) if b else 0


def test_counts_are_found_at_any_latitude(spark):
    sites = spark.createDataFrame([(i, lat, 20.0, "Maple Street & Ninth Avenue") for i, lat in enumerate((0.0, 60.0, 78.0, -85.0))], "site_id long, lat double, lon double, name string")
    rows = [("Maple St", "Oak St & Elm St", 10 + i, "2001-01-01", lat, 20.0 + 240 / (111_320 * math.cos(math.radians(lat)))) for i, lat in enumerate((0.0, 60.0, 78.0, -85.0))]
    counts = spark.createDataFrame(rows, "street string, limits string, total long, date string, lat double, lng double")
    got = {q.site_id: (q.adt, q.method) for q in TR.legs(sites, counts).where("leg = 0").collect()}
    assert got == {i: (10 + i, "nearby") for i in range(4)}


def test_a_dense_spot_does_not_change_its_neighbours(spark):
    """Hundreds of coordinates a millimetre apart beside an ordinary crowded cell."""
    r = random.Random(3)
    places = [(i, 500 + i * 1e-3, 500.0) for i in range(400)] + [(400 + i, r.uniform(300, 700), r.uniform(300, 700)) for i in range(600)]
    points = [(i, r.uniform(300, 700), r.uniform(300, 700)) for i in range(300)] + [(300 + i, 500 + r.random() * 0.4, 500.0005) for i in range(100)]
    q = spark.createDataFrame(places, "site_id long, x double, y double")
    p = spark.createDataFrame(points, "event_id long, x double, y double")
    got = {v.event_id: v.site_id for v in X.nearest_within(p, q, 150.0).collect()}
    for a in points:
        best = min(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, b[0]) for b in places)
        assert got[a[0]] == best[1]


def test_forward_scoring_refuses_rows_it_was_trained_on(spark):
    t = spark.createDataFrame([(i, "A", float(i % 3), i % 2) for i in range(30)], "site_id long, window string, f double, y int")
    with pytest.raises(ValueError, match="shares rows"):
        M.predict_forward(t, t, ["f"], M.tweedie_glm("y"), "y", ["site_id", "window"], ["site_id"])
    later = t.withColumn("window", F.lit("B")).withColumn("y", F.lit(None).cast("int"))
    assert M.predict_forward(t, later, ["f"], M.tweedie_glm("y"), "y", ["site_id", "window"], ["site_id"]).where("score is not null").count() == 30


def test_feature_sets_are_cumulative_and_single():
    s = M.feature_sets({"a": ["x"], "b": ["y"], "c": ["z"]})
    assert s == {"a": ["x"], "up_to_b": ["x", "y"], "up_to_c": ["x", "y", "z"], "a_and_c": ["x", "z"]}


def test_bundles_are_read_one_member_a_task(spark, tmp_path):
    rows = spark.createDataFrame([(2000 + i % 3, i, "Peñasco" if i % 2 else None) for i in range(60)], "bundle_year int, id long, place string")
    n = Z.write_bundles(rows, str(tmp_path / "zips"), "Deep/DATA.CSV", "bundle_year")
    got = E.read_zipped_csv(spark, str(tmp_path / "zips" / "*.zip"), "data.csv")
    assert n == 3 and got.rdd.getNumPartitions() == 3
    c = E.map_columns(got, ["id", "place", "absent"])
    assert sorted((q.bundle_year, int(q.id), q.place, q.absent) for q in c.collect()) == sorted((2000 + i % 3, i, "Peñasco" if i % 2 else "", None) for i in range(60))
    assert E.read_zipped_csv(spark, str(tmp_path / "zips" / "*.zip"), "other.csv").count() == 0
    assert E.read_zipped_csv(spark, str(tmp_path / "none" / "*.zip"), "data.csv").count() == 0


def test_stream_equals_batch_after_each_increment(spark, tmp_path):
    cols = ["report_id", "date_time", "address_road_primary", "address_sfx_primary", "address_name_intersecting", "address_sfx_intersecting", "injured", "killed"]
    rows = [(str(i), f"20{i % 3:02d}-0{1 + i % 9}-1{i % 9} 08:00:00", "MAPLE" if i % 2 else "OAK", "ST", "FIRST" if i % 5 else "", "AVE", str(i % 4), "0") for i in range(90)]
    src, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    seen = []
    for k in range(3):
        part = [r for r in rows if r[1].startswith(f"20{k:02d}")]
        seen += part
        spark.createDataFrame(part, ", ".join(f"{c} string" for c in cols)).coalesce(1).write.mode("append").option("header", True).csv(src)
        last = SR.keep_current(SR.by_pair_and_span(SR.report_stream(spark, src), "2000-01-01", "1500 days"), table, state)
        want = TR.reports_by_pair(TR.parse_reports(spark.createDataFrame(seen, ", ".join(f"{c} string" for c in cols)), "2000-01-01"))
        assert sorted(map(tuple, SR.current(spark, table, last).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert SR.keep_current(SR.by_pair_and_span(SR.report_stream(spark, src), "2000-01-01", "1500 days"), table, state) is None


def test_a_leg_takes_the_nearest_of_many_counts_on_its_street(spark, monkeypatch):
    """More counts in a cell than one row holds, some on one spot, legs near the cells' edges."""
    monkeypatch.setattr(TR, "CELL_COUNTS", 4)
    r = random.Random(12)
    rows = [("Maple St", f"L{i % 7} & M St", 10 + i % 5, f"20{i % 9:02d}-01-01", 32.7 + r.random() * 0.02, -117.2 + r.random() * 0.02) for i in range(200)]
    rows += [("Maple St", f"L{i} & M St", 5, "2001-01-01", 32.71, -117.19) for i in range(6)] + [("Oak St", "L0 & M St", 9, "2001-01-01", 32.71, -117.19)]
    sites = [(i, 32.7 + r.random() * 0.02, -117.2 + r.random() * 0.02, "Maple Street & Ninth Avenue") for i in range(60)]
    got = TR.legs(spark.createDataFrame(sites, "site_id long, lat double, lon double, name string"),
                  spark.createDataFrame(rows, "street string, limits string, total long, date string, lat double, lng double"), max_m=200.0)
    got = {q.site_id: (q.adt, q.year, q.limits) for q in got.where("leg = 0").collect()}
    for i, lat, lon, _ in sites:
        d = [(math.hypot((lng - lon) * 111_320 * math.cos(math.radians(lat)), (la - lat) * 110_540), li, t, int(dt[:4])) for st, li, t, dt, la, lng in rows if st == "Maple St"]
        d = [x for x in d if x[0] <= 200]
        assert got.get(i) == ((min(d)[2], min(d)[3], min(d)[1]) if d else None)


def test_count_texts_are_parsed_once(spark):
    """Neither a filter above nor the second rule reads the texts again."""
    raw = spark.createDataFrame([("Maple St btwn Oak Av _ Elm Av", "7", "2001-01-01", "32.7", "-117.2")], "location string, adt_total string, date string, lat string, lng string")
    plan = TR.parse_counts(raw).where("parsed").where("total > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "Generate" in plan and "RLIKE" not in plan[:plan.index("Generate")]


def test_way_edges_group_a_bounded_number_of_rows_in_a_task(spark):
    from junctura.session import dealt
    df = spark.range(1000).select((F.col("id") % 300).alias("k"), "id")
    d = dealt(df, "k", rows=100)
    assert d.rdd.getNumPartitions() == 10 and d.groupBy("k").count().agg(F.sum("count")).first()[0] == 1000
    assert "Exchange" not in d.distinct().groupBy("k").count()._jdf.queryExecution().executedPlan().toString().replace("Exchange hashpartitioning(k", "", 1)


def test_labels_read_the_roads_once(spark, monkeypatch):
    """Frequencies, names and descriptions come from one written table of incident roads."""
    from junctura.plans import names as N
    seen = []
    monkeypatch.setattr(N, "stage", lambda df, name="stage": (seen.append(name), spark.createDataFrame(df.collect(), df.schema))[1])
    e = spark.createDataFrame([(1, 2, ["primary"], ["Oak Street"], None), (1, 1, ["service"], None, ["alley"]), (3, 1, ["residential"], ["Elm"], None)],
                              "src long, dst long, highway array<string>, name array<string>, service array<string>")
    m = spark.createDataFrame([(7, 1), (8, 2)], "site_id long, node long")
    out = N.label_sites(m, e)
    assert {r.site_id: r.label for r in out.collect()} == {7: "Elm & Oak Street", 8: "Oak Street"} and seen == ["incident", "named_roads"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("highway") == 0
    assert sorted((r.node, r.name) for r in N.incident_names(e).where("name is null").collect()) == [(1, None), (1, None)]


def test_a_full_bundle_is_written_by_several_tasks(spark, tmp_path):
    """One value with most rows; rows come back whole, nulls as empty text."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    df = spark.range(20_000, numPartitions=8).select(F.when(F.col("id") % 10 == 0, 2001).otherwise(2002).alias("bundle_year"), F.col("id").cast("string").alias("id"),
                                                     F.when(F.col("id") % 3 == 0, F.md5(F.col("id").cast("string"))).alias("word"))
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        made = Z.write_bundles(df, f"file://{tmp_path}/b", "a.csv", "bundle_year")
    finally:
        spark.conf.set(key, before)
    assert made > 2
    back = E.map_columns(E.read_zipped_csv(spark, f"file://{tmp_path}/b/*.zip", "a.csv"), ["id", "word"])
    assert back.exceptAll(df.fillna("", ["word"])).count() == 0 and back.count() == 20_000


def test_ragged_rows_of_a_bundle(tmp_path):
    import zipfile
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.csv", "ï»¿id,a,,a\n1,2,3,4\n\n5,6\n7,8,9,10,11\n".encode("latin-1"))
    read = lambda: Z.ZippedCsvReader({"path": "", "member": "a.csv", "encoding": "utf-8"}).read(Z.Member(f"{tmp_path}/x.zip", "a.csv"))
    assert [dict(r) for b in read() for r in b.column("row").to_pylist()] == [{"id": "1", "a": "4"}, {"id": "5", "a": None}, {"id": "7", "a": "10"}]


def test_bootstrap_ranges_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """A range is one task's: more rows make more ranges, and copies of a score one row."""
    monkeypatch.setattr(B, "ROWS_PER_RANGE", 20)
    monkeypatch.setattr(B, "_SCORES_AT_ONCE", 16)
    seen = {}
    real = B.stage
    monkeypatch.setattr(B, "stage", lambda df, name="stage": seen.setdefault(name, real(df, name)))
    r = random.Random(5)
    rows = [(i, 0.5 if i % 3 == 0 else round(r.random(), 3), r.choice([0, 0, 0, 1, 2])) for i in range(400)]
    got = {q.b: q for q in B.bootstrap_metrics(spark.createDataFrame(rows, "site_id long, s double, y int"), "s", "y", "site_id", 6, ks=(20,)).collect()}
    ranges = [(q.part, q.score, q.y) for q in seen["replicates"].collect()]
    assert len(ranges) == len({(s, y) for _, s, y in ranges}) == len({(s, y) for _, s, y in rows})
    assert len({p for p, _, _ in ranges}) > 8 and max(sum(p == q for q, _, _ in ranges) for p, _, _ in ranges) <= 60
    for b in range(6):
        assert [got[b][c] for c in B.metric_names((20,))] == pytest.approx(plain_metrics(rows, b, 20), rel=1e-9)


def test_only_edges_of_near_nodes_are_grouped(spark, monkeypatch):
    """the roads of all nodes were grouped for the few that are nearest to a site."""
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 0.0)], "site_id bigint, x double, y double")
    nodes = spark.createDataFrame([(10, 5.0, 0.0), (11, 40.0, 0.0), (12, 900.0, 0.0)], "node bigint, x double, y double")
    edges = spark.createDataFrame([(10, 11, ["primary"], "2", "25 mph"), (10, 12, ["motorway"], "4", None), (11, 12, ["trunk"], "1", None)],
                                  "src bigint, dst bigint, highway array<string>, lanes string, maxspeed string")
    grouped, real = [], I.node_attributes

    def attributes(*a):
        grouped.append(real(*a))
        return grouped[-1]
    monkeypatch.setattr(I, "node_attributes", attributes)
    got = {r.site_id: r for r in I.geometry_features(sites, nodes, edges, 60.0).collect()}
    assert (got[1].node, got[1].edge_count, got[1].lane_count, got[1].functional_class, got[1].near_freeway) == (10, 2, 3.0, 1, 1)
    assert got[2].node is None and got[2].lane_count_missing == 1 and got[2].intersection_type == 5
    assert {r.node for r in grouped[0].collect()} == {10}
