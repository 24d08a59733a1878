"""Point-in-polygon joins without a spatial predicate.

Polygons are stored as edges (poly, x1, y1, x2, y2) of closed rings; rings of one
polygon simply share the id, so holes work by parity. Each polygon is laid over
grid cells. A cell keeps only the edges that cross it, and per polygon one bit:
whether the cell's lower right corner lies inside. A point meets one cell row and
walks from that corner to itself, turning the bit at every edge it crosses: one
equality join, no point x edge rows, and no edge of the outline outside the cell.

The corner bits of a row of cells are carried from right to left: crossings of
the row's lower line are numbered in one global order, and cells between an odd
crossing and the next are inside. Cells that more than ``EDGE_LIMIT`` edges cross
are split, and only their points go on to the smaller cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from junctura.functions.geo import segment_nearest
from junctura.operators.proximity import cell_of
from junctura.operators.ranking import running_totals
from junctura.session import stage


def edges_from_vertices(vertices: DataFrame, poly: str = "poly", ring: str = "ring", seq: str = "seq") -> DataFrame:
    """Consecutive vertices (``seq`` 0, 1, ...) to edges; an unclosed ring is closed
    to its start. The next vertex comes from an equality join on the position, so
    an outline of any length is spread over tasks."""
    v = vertices.select(F.col(poly).alias("poly"), F.col(ring).alias("ring"), F.col(seq).cast("bigint").alias("seq"), "x", "y")
    nxt = v.select("poly", "ring", (F.col("seq") - 1).alias("seq"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    top = v.where("seq = 0").select("poly", "ring", F.col("x").alias("fx"), F.col("y").alias("fy"))
    e = v.join(nxt, ["poly", "ring", "seq"], "left").join(top, ["poly", "ring"]).select(
        "poly", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce("nx", "fx").alias("x2"), F.coalesce("ny", "fy").alias("y2"))
    return e.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


EDGE_LIMIT = 256   # edges in one cell row
PARTS = 8          # sub-cells per side of a crowded cell
_EDGE = ["x1", "y1", "x2", "y2"]


def _xc(e, y: Column) -> Column:
    """Where an edge meets the line at ``y``, never past its ends."""
    x = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
    return F.greatest(F.least(e["x1"], e["x2"]), F.least(F.greatest(e["x1"], e["x2"]), x))


def _flips(e, px: Column, py: Column, rx: Column, ry: Column) -> Column:
    """Whether an edge is crossed an odd number of times on the way from (rx, ry) straight
    up or down to (rx, py), then sideways to (px, py). Ends on a line count as below or left
    of it, and the place on the vertical line follows from the one on the horizontal line,
    so rounding cannot count a corner twice: summed over a closed ring the bits equal
    those of a ray to the right."""
    across = lambda y: (e["y1"] > y) != (e["y2"] > y)
    rising = (e["x2"] > e["x1"]) == (e["y2"] > e["y1"])
    under = lambda y: F.when(across(y), rising == (_xc(e, y) > rx)).otherwise(e["y1"] <= y)
    sideways = across(py) & ((px < _xc(e, py)) != (rx < _xc(e, py)))
    upright = ((e["x1"] > rx) != (e["x2"] > rx)) & (under(py) != under(ry))
    return sideways != upright


def _corner(cell: float) -> tuple[Column, Column]:
    return (F.col("kx") + 1) * F.lit(float(cell)), F.col("ky") * F.lit(float(cell))


def _span(lo: Column, hi: Column, cell: float, least: Column | None, most: Column | None) -> Column:
    """Cells from ``lo`` to ``hi`` with room for rounding, within ``least`` and ``most``.
    A cell too many changes nothing: an edge is counted where it is crossed."""
    room = F.lit(cell * 1e-6) + (F.abs(lo) + F.abs(hi)) * 1e-12
    a, b = cell_of(lo - room, cell), cell_of(hi + room, cell)
    if least is not None:
        a, b = F.greatest(a, least), F.least(b, most)
    return F.filter(F.sequence(F.least(a, b), F.greatest(a, b)), lambda k: (k >= a) & (k <= b))


def _crossed_cells(edges: DataFrame, cell: float, within: bool = False) -> DataFrame:
    """Edges once for each cell they cross (kx, ky); ``within`` the cell px, py of the coarser grid."""
    lim = lambda k: (F.col(k) * PARTS, F.col(k) * PARTS + PARTS - 1) if within else (None, None)
    e = {c: F.col(c) for c in _EDGE}
    banded = edges.withColumn("ky", F.explode(_span(F.least("y1", "y2"), F.greatest("y1", "y2"), cell, *lim("py"))))
    clip = lambda y: F.least(F.greatest(y, F.least("y1", "y2")), F.greatest("y1", "y2"))
    at = lambda k: F.coalesce(_xc(e, clip(k * F.lit(float(cell)))), F.col("x1"))
    flat = F.col("y1") == F.col("y2")
    a = F.when(flat, F.col("x1")).otherwise(at(F.col("ky")))
    b = F.when(flat, F.col("x2")).otherwise(at(F.col("ky") + 1))
    banded = banded.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b))
    return banded.withColumn("kx", F.explode(_span(F.col("_a"), F.col("_b"), cell, *lim("px")))).select("kx", "ky", "poly", *_EDGE)


def corner_bits(edges: DataFrame, cell: float) -> DataFrame:
    """(kx, ky, poly) of the cells whose lower right corner lies inside the polygon."""
    e = {c: F.col(c) for c in _EDGE}
    line = F.col("ky") * F.lit(float(cell))
    met = edges.withColumn("ky", F.explode(_span(F.least("y1", "y2"), F.greatest("y1", "y2"), cell, None, None)))
    met = met.where((F.col("y1") > line) != (F.col("y2") > line)).withColumn("_x", _xc(e, line))
    k = F.ceil(F.col("_x") / F.lit(float(cell))).cast("bigint") - 2   # the last cell whose corner lies left of the crossing
    left = lambda c: (c + 1) * F.lit(float(cell)) < F.col("_x")
    met = met.withColumn("_k", k).withColumn("_k", F.when(left(F.col("_k") + 1), F.col("_k") + 1).when(~left(F.col("_k")), F.col("_k") - 1).otherwise(F.col("_k")))
    odd = met.groupBy("poly", "ky", "_k").agg(F.count("*").alias("_c")).where("_c % 2 = 1").select("poly", "ky", "_k", F.lit(1).cast("bigint").alias("_one"))
    run = running_totals(odd, [("poly", False), ("ky", False), ("_k", True)], {"_n": "_one"})
    first = run.groupBy("poly", "ky").agg(F.min("_n").alias("_f"))
    pairs = run.join(first, ["poly", "ky"]).groupBy("poly", "ky", F.floor((F.col("_n") - F.col("_f")) / 2).alias("_m")).agg(
        F.min("_k").alias("_a"), F.max("_k").alias("_b")).where("_a < _b")
    return pairs.select(F.explode(F.sequence(F.col("_a") + 1, F.col("_b"))).alias("kx"), "ky", "poly")


def _rows(placed: DataFrame, bits: DataFrame) -> DataFrame:
    """One row per cell: the lowest polygon that holds the cell as a whole, and the
    edges of each lower one that crosses it."""
    mine = placed.groupBy("kx", "ky", "poly").agg(F.collect_list(F.struct(*_EDGE)).alias("es"))  # at most EDGE_LIMIT a cell
    both = mine.join(bits.withColumn("bit", F.lit(True)), ["kx", "ky", "poly"], "full")
    whole = F.min(F.when(F.col("es").isNull(), F.col("poly")))
    some = F.collect_list(F.when(F.col("es").isNotNull(), F.struct("poly", F.coalesce("bit", F.lit(False)).alias("bit"), "es")))
    return both.groupBy("kx", "ky").agg(whole.alias("whole"), some.alias("polys")).select(
        "kx", "ky", "whole", F.filter("polys", lambda p: F.col("whole").isNull() | (p["poly"] < F.col("whole"))).alias("polys"))


def _sub_bits(placed: DataFrame, bits: DataFrame, cell: float) -> DataFrame:
    """Corner bits of the sub-cells of crowded cells: the cell's own bit, turned by the
    edges between the two corners. Edges are added up, never gathered."""
    rx, ry = _corner(cell)
    small = cell / PARTS
    subs = F.explode(F.expr(f"flatten(transform(sequence(0, {PARTS - 1}), i -> transform(sequence(0, {PARTS - 1}), j -> struct(kx * {PARTS} + i AS sx, ky * {PARTS} + j AS sy))))"))
    e = {c: F.col(c) for c in _EDGE}
    each = placed.withColumn("_s", subs).withColumn("_f", _flips(e, (F.col("_s.sx") + 1) * F.lit(small), F.col("_s.sy") * F.lit(small), rx, ry))
    turned = each.groupBy("kx", "ky", "poly", "_s").agg(F.sum(F.col("_f").cast("int")).alias("_n"))
    own = placed.select("kx", "ky").distinct()
    full = bits.join(own, ["kx", "ky"], "left_semi").withColumn("_s", subs).withColumn("_own", F.lit(1))
    return turned.join(full, ["kx", "ky", "poly", "_s"], "full").where("(coalesce(_n, 0) + coalesce(_own, 0)) % 2 = 1").select(
        F.col("_s.sx").alias("kx"), F.col("_s.sy").alias("ky"), "poly")


def cell_levels(edges: DataFrame, cell: float, limit: int = EDGE_LIMIT) -> list[tuple[float, DataFrame, DataFrame | None]]:
    """(cell size, rows, crowded cells or None) from the coarsest grid down. Rows of a level
    leave out its crowded cells; the last level has none, unless edges coincide so much that
    a split no longer helps."""
    placed = stage(_crossed_cells(edges.where("poly is not null"), cell), "cells")
    bits = stage(corner_bits(edges.where("poly is not null"), cell), "bits")
    out, most = [], None
    while True:
        crowded = stage(placed.groupBy("kx", "ky").agg(F.count("*").alias("n")).where(F.col("n") > limit), "crowded")
        top = crowded.agg(F.max("n")).first()[0]
        if top is None or (most is not None and top >= most):
            return [*out, (cell, _rows(placed, bits), None)]
        keys = crowded.select("kx", "ky")
        rest = _rows(placed.join(keys, ["kx", "ky"], "left_anti"), bits.join(keys, ["kx", "ky"], "left_anti"))
        out.append((cell, rest, keys))
        inner = placed.join(keys, ["kx", "ky"], "left_semi")
        bits = stage(_sub_bits(inner, bits, cell), "bits")
        cell, most = cell / PARTS, top
        placed = stage(_crossed_cells(inner.withColumnsRenamed({"kx": "px", "ky": "py"}), cell, within=True), "cells")


def containing(points: DataFrame, edges: DataFrame, cell: float, *, x: str = "x", y: str = "y",
               out: str = "poly", missing: int = -1, limit: int = EDGE_LIMIT) -> DataFrame:
    """Adds the lowest id of the polygons that contain the point, else ``missing``.
    Null polygons and null points give ``missing``."""
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    todo = points.withColumn("kx", cell_of(px, cell)).withColumn("ky", cell_of(py, cell))
    done = None
    for size, rows, crowded in cell_levels(edges, cell, limit):
        rx, ry = _corner(size)
        inside = lambda p: p["bit"] != (F.size(F.filter(p["es"], lambda e: _flips(e, px, py, rx, ry))) % 2 == 1)  # noqa: E731, B023
        hit = F.coalesce(F.array_min(F.transform(F.filter("polys", inside), lambda p: p["poly"])), F.col("whole"))
        here = todo if crowded is None else todo.join(crowded, ["kx", "ky"], "left_anti")
        got = here.join(rows, ["kx", "ky"], "left").withColumn(out, F.coalesce(hit, F.lit(missing).cast("bigint"))).drop("kx", "ky", "polys", "whole")
        done = got if done is None else done.unionByName(got)
        if crowded is not None:
            sub = lambda v, k: F.greatest(k * PARTS, F.least(k * PARTS + PARTS - 1, cell_of(v, size / PARTS)))  # noqa: E731, B023
            todo = todo.join(crowded, ["kx", "ky"], "left_semi").withColumn("kx", sub(px, F.col("kx"))).withColumn("ky", sub(py, F.col("ky")))
    return done


def near_edge(points: DataFrame, edges: DataFrame, radius: float, *, pid: str, x: str = "x", y: str = "y") -> DataFrame:
    """Ids of the points within ``radius`` of any edge. Edges are cut to pieces no
    longer than the radius, so each piece reaches a fixed number of cells."""
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    steps = F.greatest(F.ceil(length / radius), F.lit(1))
    cut = edges.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_n")
    piece = cut.select(at("x1", "x2", F.col("_i")).alias("ax"), at("y1", "y2", F.col("_i")).alias("ay"),
                       at("x1", "x2", F.col("_i") + 1).alias("bx"), at("y1", "y2", F.col("_i") + 1).alias("by"))
    span = lambda a, b: F.sequence(cell_of(F.least(a, b) - radius, radius), cell_of(F.greatest(a, b) + radius, radius))
    rows = (
        piece.withColumn("kx", F.explode(span(F.col("ax"), F.col("bx"))))
        .withColumn("ky", F.explode(span(F.col("ay"), F.col("by"))))
    )
    # a cell's pieces in several rows of about EDGE_LIMIT, dealt by a hash
    per = rows.groupBy("kx", "ky").agg(F.ceil(F.count("*") / EDGE_LIMIT).alias("_k"))
    rows = rows.join(per, ["kx", "ky"]).groupBy("kx", "ky", F.pmod(F.xxhash64("ax", "ay", "bx", "by"), F.col("_k")).alias("part")).agg(
        F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("ps")).select(F.col("kx").alias("_kx"), F.col("ky").alias("_ky"), "ps")
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    r2 = float(radius) ** 2
    near = F.exists("ps", lambda s: segment_nearest(px, py, s["ax"], s["ay"], s["bx"], s["by"])[0] <= r2)
    return points.join(rows, (cell_of(px, radius) == F.col("_kx")) & (cell_of(py, radius) == F.col("_ky")) & near, "left_semi").select(pid)


def within_region(points: DataFrame, edges: DataFrame, cell: float, **kw) -> DataFrame:
    """Keep the points inside any polygon. Filtering a filtered table changes
    nothing, so re-runs are safe."""
    return containing(points, edges, cell, out="_region", **kw).where("_region <> -1").drop("_region")


def within_buffered_region(points: DataFrame, edges: DataFrame, cell: float, radius: float, *, pid: str,
                           x: str = "x", y: str = "y") -> DataFrame:
    """Inside any polygon or within ``radius`` of one. If there are no polygons
    the caller falls back to ``within_box``."""
    inside = containing(points, edges, cell, x=x, y=y, out="_in")
    close = near_edge(points, edges, radius, pid=pid, x=x, y=y).withColumn("_close", F.lit(True))
    return inside.join(close, pid, "left").where("_in <> -1 OR _close").drop("_in", "_close")


def within_box(points: DataFrame, x0: float, y0: float, x1: float, y1: float, x: str = "x", y: str = "y") -> DataFrame:
    return points.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def clip_edges(graph_edges: DataFrame, kept: DataFrame, node: str) -> DataFrame:
    """Edges whose two ends are both kept."""
    k = kept.select(node).distinct()
    return (graph_edges.join(k.withColumnRenamed(node, "src"), "src", "left_semi")
            .join(k.withColumnRenamed(node, "dst"), "dst", "left_semi"))
