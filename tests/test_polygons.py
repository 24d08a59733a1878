"""The polygon index against plain ray casting: huge outlines, holes, overlaps and points on grid lines."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from junctura.operators import polygons as P

EDGES = "poly long, x1 double, y1 double, x2 double, y2 double"


def ring(poly, pts):
    return [(poly, *map(float, a), *map(float, b)) for a, b in zip(pts, pts[1:] + pts[:1]) if a != b]


def coast(n, r, wobble, cx=0.0, cy=0.0, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, q = 2 * math.pi * i / n, r * (1 + wobble * (rnd.random() - 0.5))
        out.append((cx + q * math.cos(a), cy + q * math.sin(a)))
    return out


def lowest(points, edges):
    """Ray to the right, one polygon after the other."""
    e = np.array(edges)
    got = []
    for x, y in points:
        up = (e[:, 2] > y) != (e[:, 4] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            xc = (e[:, 3] - e[:, 1]) * (y - e[:, 2]) / (e[:, 4] - e[:, 2]) + e[:, 1]
        hit = e[up & (x < np.clip(xc, np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3]))), 0]
        ids, n = np.unique(hit, return_counts=True)
        got.append(int(ids[n % 2 == 1].min()) if (n % 2).any() else -1)
    return got


def check(spark, edges, points, cell, limit):
    e = spark.createDataFrame(edges, EDGES)
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "site_id long, x double, y double")
    got = {r.site_id: r.poly for r in P.containing(pts, e, cell, limit=limit).collect()}
    assert [got[i] for i in range(len(points))] == lowest(points, edges)
    return e


def test_a_huge_outline_has_rows_of_bounded_size(spark):
    island = ring(5, coast(20_000, 1000.0, 0.02)) + ring(5, coast(400, 200.0, 0.3, seed=2))       # with a lake
    plots = ring(9, [(-300, -300), (300, -300), (300, 300), (-300, 300)]) + ring(2, [(990, -40), (1100, -40), (1100, 40), (990, 40)])
    rnd = random.Random(3)
    points = [(rnd.uniform(-1100, 1100), rnd.uniform(-1100, 1100)) for _ in range(300)]
    points += [(1000 * math.cos(a), 1000 * math.sin(a)) for a in (rnd.uniform(0, 7) for _ in range(300))]   # along the coast
    points += [(100.0 * i, 100.0 * j) for i in range(-11, 12) for j in range(-11, 12, 3)]                   # on grid corners
    e = check(spark, island + plots, points, 100.0, 64)
    levels = P.cell_levels(e, 100.0, 64)
    assert len(levels) > 1 and levels[-1][2] is None
    for _, rows, _ in levels:
        most = rows.select(F.aggregate("polys", F.lit(0), lambda n, p: n + F.size(p["es"])).alias("n")).agg(F.max("n")).first()[0]
        assert (most or 0) <= 64


def test_corners_on_grid_lines_and_slivers(spark):
    edges = ring(1, [(0, 0), (10, 0), (10, 10), (20, 10), (20, 20), (0, 20)]) + ring(3, [(10, 0), (20, 0), (20, 10), (10, 10)])
    edges += ring(4, [(5, 5), (15, 5.000001), (5, 5.000002)]) + ring(7, [(-10, -10), (30, -10), (10, 40)])
    points = [(i * 2.5, j * 2.5) for i in range(-5, 13) for j in range(-5, 17)] + [(6.0, 5.000001), (0.0, 0.0), (10.0, 10.0)]
    check(spark, edges, points, 10.0, 256)
    check(spark, edges, points, 10.0, 4)
    check(spark, edges, points, 1000.0, 3)


def test_edges_that_coincide_stop_the_split(spark):
    fan = [x for k in range(12) for x in ring(k, [(50, 50), (60 + k, 50), (60, 60 + k)])]  # all share a corner
    check(spark, fan, [(50.5, 50.2), (55, 52), (61, 50.5), (49, 49), (60, 61)], 100.0, 6)
    e = spark.createDataFrame([], EDGES)
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0)], "site_id long, x double, y double")
    assert [r.poly for r in P.containing(pts, e, 10.0).collect()] == [-1, -1]
