"""Distance joins against brute force on crowded and repeated places."""

import math
import random

import pytest
from pyspark.sql import functions as F

from junctura.operators import components as C, polygons as P, proximity as X


def cloud(n, seed, hot=0.4, span=2000.0):
    """A third and more of the points in one small block, many of them copies."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if r.random() < hot:
            x, y = 500 + r.randrange(0, 40) * 0.25, 500 + r.randrange(0, 40) * 0.25
        else:
            x, y = r.uniform(0, span), r.uniform(0, span)
        out.append((i, x, y))
    return out


@pytest.fixture(scope="module")
def data(spark):
    ev, si = cloud(600, 1), cloud(300, 2)
    e = spark.createDataFrame(ev, "event_id bigint, x double, y double").cache()
    s = spark.createDataFrame(si, "site_id bigint, x double, y double").cache()
    return ev, si, e, s


def d2(a, b):
    return (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2


@pytest.mark.parametrize("levels", [0, 1, 3, None])
def test_nearest_equals_brute_force(data, levels, monkeypatch):
    ev, si, e, s = data
    monkeypatch.setattr(X, "CELL_LIMIT", 20)
    got = {r.event_id: r.site_id for r in X.nearest_within(e, s, 76.2, levels=levels).collect()}
    want = {}
    for a in ev:
        best = min((d2(a, b), b[0]) for b in si)
        if best[0] <= 76.2**2:
            want[a[0]] = best[1]
    assert got == want


def test_only_crowded_cells_are_refined_and_ids_may_repeat(data, spark, monkeypatch):
    ev, si, e, s = data
    monkeypatch.setattr(X, "CELL_LIMIT", 20)
    cells = X.crowded_cells(X.distinct_places(s, "site_id", "x", "y").select("qx", "qy"), 76.2)
    assert 0 < cells.count() <= 25  # the block's own cell and those that see it, out of hundreds
    p = spark.createDataFrame([(1, 500.0, 500.0), (1, 900.0, 900.0), (1, 505.0, 505.0)], "event_id bigint, x double, y double")
    got = {(r.x, r.y): r.site_id for r in X.nearest_within(p, s, 400.0, how="left").collect()}
    assert got == {(a[1], a[2]): min((d2(a, b), b[0]) for b in si)[1] for a in [(1, 500.0, 500.0), (1, 900.0, 900.0), (1, 505.0, 505.0)]}


def test_radius_totals_equal_brute_force(data):
    ev, si, e, s = data
    got = {r.site_id: (r.n, r.top) for r in X.radius_totals(s, e, 150.0, cid="site_id", sums={"n": F.lit(1)}, maxima={"top": F.col("event_id")}).collect()}
    want = {}
    for b in si:
        near = [a[0] for a in ev if d2(a, b) <= 150.0**2]
        if near:
            want[b[0]] = (len(near), max(near))
    assert got == want


def test_radius_totals_open_a_crowded_rim_box_level_by_level(spark):
    """A third of all items in one box of the rim: rows of a level stay bounded, sums stay exact."""
    r = random.Random(5)
    items = [(i, 149.9 + r.random() * 0.2, r.random() * 0.2, i % 3) for i in range(3000)] + [(i, r.uniform(-400, 400), r.uniform(-400, 400), 1) for i in range(3000, 9000)]
    it = spark.createDataFrame(items, "event_id bigint, x double, y double, v int")
    ce = spark.createDataFrame([(k, float(k), 0.0) for k in range(-3, 4)] + [(99, 5000.0, 0.0)], "site_id bigint, x double, y double")
    got = {r.site_id: (r.near, r.n, r.s, r.top) for r in X.radius_totals(
        ce, it, 150.0, cid="site_id", radii={"near": 40.0}, sums={"near": F.lit(1), "n": F.lit(1), "s": F.col("v")}, maxima={"top": F.col("event_id")}, leaf=16).collect()}
    assert 99 not in got
    for k in range(-3, 4):
        at = [(i, v, (x - k) ** 2 + y * y) for i, x, y, v in items]
        inside = [(i, v) for i, v, d in at if d <= 150.0**2]
        assert got[k] == (sum(d <= 1600 for *_, d in at) or None, len(inside), sum(v for _, v in inside), max(i for i, _ in inside))


def test_radius_totals_shuffle_centers_and_items_not_boxes(spark, monkeypatch):
    """Cells are cut into small blocks, and no staged table outgrows the centers and items."""
    r = random.Random(6)
    ev, si = [[(i, r.uniform(0, 300), r.uniform(0, 300)) for i in range(n)] for n in (6000, 300)]
    e, s = spark.createDataFrame(ev, "event_id bigint, x double, y double"), spark.createDataFrame(si, "site_id bigint, x double, y double")
    rows, keep = [], X.stage

    def counted(df, name="stage"):
        out = keep(df, name)
        rows.append(out.count())
        return out
    monkeypatch.setattr(X, "stage", counted)
    monkeypatch.setattr(X, "SUM_BLOCK", 400, raising=False)
    got = {r.site_id: (r.n, r.near, r.top) for r in X.radius_totals(
        s, e, 150.0, cid="site_id", radii={"near": 5.0}, sums={"n": F.lit(1), "near": F.col("event_id")}, maxima={"top": -F.col("event_id")}, leaf=4).collect()}
    want = {}
    for b in si:
        near = [(a[0], d2(a, b)) for a in ev if d2(a, b) <= 150.0**2]
        inner = [i for i, d in near if d <= 25.0]
        want[b[0]] = (len(near), sum(inner) if inner else None, max(-i for i, _ in near))
    assert got == want
    assert max(rows) <= len(ev) + len(si)


def test_k_nearest_in_nested_boxes(spark, monkeypatch):
    monkeypatch.setattr(X, "CELL_LIMIT", 30)
    r = random.Random(8)
    pts = [(i, 500 + r.random() * 10 ** -r.randrange(4), 500 + r.random() * 10 ** -r.randrange(4)) for i in range(900)] + [(i, r.uniform(0, 2000), r.uniform(0, 2000)) for i in range(900, 1200)]
    s = spark.createDataFrame(pts, "site_id bigint, x double, y double")
    got = {}
    for q in X.k_nearest(s, 300.0, 4, pid="site_id").collect():
        got.setdefault(q.site_id, {})[q.pos] = q.qid
    for b in pts[::7]:
        near = sorted((d2(a, b), a[0]) for a in pts if a[0] != b[0] and d2(a, b) <= 300.0**2)[:4]
        assert [got.get(b[0], {}).get(i + 1) for i in range(len(near))] == [q for _, q in near]


def test_decayed_sums_make_no_row_for_a_pair(spark):
    r = random.Random(9)
    pts = [(i, r.random(), r.random(), float(i % 5)) for i in range(1500)] + [(2000, None, 1.0, 1.0)]
    t = spark.createDataFrame(pts, "site_id bigint, x double, y double, v double")
    out = X.decayed_sums(t, 200.0, 80.0, {"p": "v"}, sid="site_id")
    got = {q.site_id: q.p for q in out.collect()}
    assert len(got) == 1500
    for b in pts[:1500:97]:
        assert got[b[0]] == pytest.approx(sum(math.exp(-0.5 * d2(a, b) / 6400.0) * a[3] for a in pts[:1500] if a[0] != b[0]), rel=1e-9)
    blocks = X._blocks(t.where("x is not null").select(F.col("x").alias("qx"), F.col("y").alias("qy")), 200.0, [])
    n, most = blocks.agg(F.count("*"), F.max(F.size("pts"))).first()
    assert n <= 1500 / 32 and most <= 3 * X.BLOCK  # so n * n rows of blocks instead of 1500 * 1500 of pairs


@pytest.mark.parametrize("limit", [10, 256])
def test_k_nearest_equals_brute_force(data, limit, monkeypatch):
    _, si, _, s = data
    monkeypatch.setattr(X, "CELL_LIMIT", limit)
    got = {}
    for r in X.k_nearest(s, 300.0, 3, pid="site_id").collect():
        got.setdefault(r.site_id, {})[r.pos] = r.qid
    for b in si:
        near = sorted((d2(a, b), a[0]) for a in si if a[0] != b[0] and d2(a, b) <= 300.0**2)[:3]
        assert [got.get(b[0], {}).get(i + 1) for i in range(len(near))] == [q for _, q in near]


def test_decayed_sums_equal_brute_force(data, spark):
    _, si, _, s = data
    t = s.withColumn("v", (F.col("site_id") % 7).cast("double"))
    got = {r.site_id: (r.p, r.n_neighbors) for r in X.decayed_sums(t, 200.0, 80.0, {"p": "v"}, sid="site_id").collect()}
    for b in si:
        near = [a for a in si if a[0] != b[0] and d2(a, b) <= 200.0**2]
        assert got[b[0]][0] == pytest.approx(sum(math.exp(-0.5 * d2(a, b) / 6400.0) * (a[0] % 7) for a in near), abs=1e-6)
        assert got[b[0]][1] == len(near)


def test_nearest_any_reaches_far(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 9000.0, 0.0)], "site_id bigint, x double, y double")
    q = spark.createDataFrame([(7, 10.0, 0.0)], "place_id bigint, x double, y double")
    got = {r.site_id: round(r.dist) for r in X.nearest_any(p, q, 50.0).collect()}
    assert got == {1: 10, 2: 8990}


def test_links_of_touching_crowded_cells_need_one_witness(spark):
    """Crowds on both sides of a gap near the radius: linked or not exactly as brute force says."""
    r = random.Random(4)
    rows = []
    for k, gap in enumerate((9.9, 10.0, 10.1, 10.6, 13.0)):
        left = [(k * 1000.0 - r.random() * 0.5, r.random() * 6) for _ in range(120)] + [(k * 1000.0, 3.0)]
        right = [(k * 1000.0 + gap + r.random() * 0.5, r.random() * 6) for _ in range(120)] + [(k * 1000.0 + gap, 3.0)]
        rows += [(k * 1000 + i, *p) for i, p in enumerate(left + right)]
    n = spark.createDataFrame([(i, x, y, False, False) for i, x, y in rows], "node_id bigint, x double, y double, is_freeway boolean, is_trunk boolean")
    got = {q.node_id // 1000 * 1000: q.member_count for q in C.merge_near_duplicates(n, 10.0).collect() if q.node_id % 1000 == 0}
    for k in range(5):
        mine = [p for p in rows if p[0] // 1000 == k]
        first, todo = {mine[0][0]}, [mine[0]]
        while todo:
            a = todo.pop()
            new = [b for b in mine if b[0] not in first and d2(a, b) <= 100.0]
            first.update(b[0] for b in new)
            todo += new
        assert got[k * 1000] == len(first)


def test_components_of_a_long_chain_and_copies(spark):
    rows = [(i, i * 9.0, 0.0, False, i == 3) for i in range(200)] + [(1000 + i, 5000.0, 5000.0, i == 0, False) for i in range(50)] + [(5000, 9000.0, 0.0, False, True)]
    n = spark.createDataFrame(rows, "node_id bigint, x double, y double, is_freeway boolean, is_trunk boolean")
    m = {r.node_id: r for r in C.merge_near_duplicates(n, 10.0).collect()}
    assert set(m) == {0, 1000, 5000}
    assert m[0].member_count == 200 and m[0].is_trunk_borderline and m[0].is_surface
    assert m[1000].member_count == 50 and m[1000].is_freeway and not m[1000].is_surface
    assert m[0].x == pytest.approx(199 * 9 / 2)
    assert C.id_collisions(C.merge_near_duplicates(n, 10.0)).count() == 0


def test_members_of_a_giant_component_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "MEMBER_CHUNK", 20)
    rows = [(i, i * 9.0, 0.0, False, False) for i in range(150)] + [(500 + i, 9000.0 + i, 0.0, False, False) for i in range(5)]
    n = spark.createDataFrame(rows, "node_id bigint, x double, y double, is_freeway boolean, is_trunk boolean")
    m = {r.node_id: r for r in C.merge_near_duplicates(n, 10.0).collect()}
    assert m[0].member_count == 150 and m[0].members is None and m[500].members == [500, 501, 502, 503, 504]
    got = C.member_chunks(n, 10.0).collect()
    assert sorted(i for r in got if r.node_id == 0 for i in r.members) == list(range(150))
    assert max(len(r.members) for r in got) <= 45 and sum(r.node_id == 0 for r in got) > 4


def test_polygon_with_hole_overlap_and_buffer(spark):
    v = [(1, 0, i, *p) for i, p in enumerate([(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)])]
    v += [(1, 1, i, *p) for i, p in enumerate([(40.0, 40.0), (60.0, 40.0), (60.0, 60.0), (40.0, 60.0)])]
    v += [(2, 0, i, *p) for i, p in enumerate([(80.0, 80.0), (180.0, 80.0), (180.0, 180.0), (80.0, 180.0)])]
    e = P.edges_from_vertices(spark.createDataFrame(v, "poly bigint, ring int, seq int, x double, y double"))
    pts = spark.createDataFrame([(1, 10.0, 10.0), (2, 50.0, 50.0), (3, 90.0, 90.0), (4, 150.0, 150.0), (5, 300.0, 5.0), (6, None, 1.0), (7, 185.0, 100.0)],
                                "site_id bigint, x double, y double")
    for cell in (7.0, 50.0, 1000.0):
        got = {r.site_id: r.poly for r in P.containing(pts, e, cell).collect()}
        assert got == {1: 1, 2: -1, 3: 1, 4: 2, 5: -1, 6: -1, 7: -1}
    near = {r.site_id for r in P.within_buffered_region(pts, e, 50.0, 11.0, pid="site_id").collect()}
    assert near == {1, 2, 3, 4, 7}
    once = P.within_region(pts, e, 50.0)
    assert {r.site_id for r in once.collect()} == {r.site_id for r in P.within_region(once, e, 50.0).collect()} == {1, 3, 4}


def test_evenly_dense_places_need_no_boxes(spark, monkeypatch):
    """Every block of the radius is crowded: points look in smaller cells, so no point meets all places in reach."""
    monkeypatch.setattr(X, "CELL_LIMIT", 100)
    monkeypatch.setattr(X, "FINE", 20)

    def boxes(*_a, **_k):
        raise AssertionError("even density must not open boxes")
    monkeypatch.setattr(X, "_pick_by_boxes", boxes)
    r = random.Random(9)
    si = [(i, float(r.randrange(-300, 300)), float(r.randrange(-300, 300))) for i in range(3000)]
    ev = [(i, float(r.randrange(-280, 280)), float(r.randrange(-280, 280))) for i in range(300)] + [(300, 900.0, 0.0), (301, None, 0.0)]
    e = spark.createDataFrame(ev, "event_id bigint, x double, y double")
    s = spark.createDataFrame(si, "site_id bigint, x double, y double")
    got = {r.event_id: r.site_id for r in X.nearest_within(e, s, 76.2, how="left").collect()}
    want = {}
    for a in ev:
        best = min((d2(a, b), b[0]) for b in si) if a[1] is not None else (1e9, None)
        want[a[0]] = best[1] if best[0] <= 76.2**2 else None
    assert got == want


def test_start_levels_follow_the_density_of_each_cell(spark):
    r = random.Random(3)
    pts = [(r.uniform(0, 100), r.uniform(0, 100)) for _ in range(3000)] + [(950.0 + i, 950.0) for i in range(10)]
    spots = spark.createDataFrame(pts, "qx double, qy double")
    lv = {(r.ux, r.uy): r.lv for r in X._start_levels(spots, 100.0, X.crowded_cells(spots, 100.0)).collect()}
    assert 3 <= lv[1, 1] < lv[0, 0] and (9, 9) not in lv


@pytest.mark.parametrize("limit", [10, 1000])
def test_pairs_of_many_places_are_not_broadcast(data, monkeypatch, limit, capsys):
    """nine copies of every place stood in the memory of one task."""
    _, si, _, s = data
    monkeypatch.setattr(X, "BROADCAST_ROWS", limit, raising=False)
    pairs = X.pairs_within(s.withColumnRenamed("site_id", "a"), s, 30.0, place_cols=["site_id"]).where("a < site_id")
    got = {(r.a, r.site_id) for r in pairs.collect()}
    assert got == {(a[0], b[0]) for a in si for b in si if a[0] < b[0] and d2(a, b) <= 900}
    capsys.readouterr()
    pairs.explain()
    assert ("SortMergeJoin" in capsys.readouterr().out) == (limit < len(si))


@pytest.mark.parametrize("limit", [10, 1000])
def test_neighbours_of_many_places_are_not_broadcast(data, monkeypatch, limit, capsys):
    """nine copies of every place went through the driver."""
    _, si, _, s = data
    monkeypatch.setattr(X, "BROADCAST_ROWS", limit)
    seen, real = [], X.stage

    def staged(df, name):
        if name == "ring":
            seen.append(df)
        return real(df, name)
    monkeypatch.setattr(X, "stage", staged)
    got = {(r.site_id, r.pos): r.qid for r in X.k_nearest(s, 300.0, 2, pid="site_id").collect()}
    want = {a[0]: sorted((d2(a, b), b[0]) for b in si if b[0] != a[0] and d2(a, b) <= 300.0**2)[:2] for a in si}
    assert got == {(k, i + 1): q[1] for k, v in want.items() for i, q in enumerate(v)}
    capsys.readouterr()
    seen[0].explain()
    plan = capsys.readouterr().out
    assert ("SortMergeJoin" in plan and "LeftOuter, BuildRight" not in plan) if limit < len(si) else "LeftOuter, BuildRight" in plan
