"""Near-duplicate merging: radius links, connected components, roll-up."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from junctura.functions.geo import planar2, stable_site_id
from junctura.operators.proximity import cell_of
from junctura.session import discard, stage


#: Coordinates of a box up to which it is compared as an array; sub-boxes per side of a fuller one.
WITNESS_LEAF, WITNESS_PARTS = 8, 4


def _reach(a: str, b: str) -> tuple[Column, Column]:
    """Squared distance of two boxes: the least and the greatest of any two of their points."""
    c = lambda s, k: F.col(f"{s}_{k}")
    gap = lambda lo, hi: F.greatest(c(a, lo) - c(b, hi), c(b, lo) - c(a, hi), F.lit(0.0))
    far = lambda lo, hi: F.greatest(F.abs(c(a, hi) - c(b, lo)), F.abs(c(b, hi) - c(a, lo)))
    dx, dy, ex, ey = gap("x0", "x1"), gap("y0", "y1"), far("x0", "x1"), far("y0", "y1")
    return dx * dx + dy * dy, ex * ex + ey * ey


def _boxes(spots: DataFrame, size: float, keys: list[str]) -> DataFrame:
    """The boxes of ``size`` in ``spots`` (label, x, y, ``keys``): extent, count and, where
    they are few, the coordinates."""
    at = spots.withColumn("bx", cell_of(F.col("x"), size)).withColumn("by", cell_of(F.col("y"), size))
    per = at.groupBy("label", *keys, "bx", "by").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"))
    few = at.join(per.where(F.col("n") <= WITNESS_LEAF).select("label", *keys, "bx", "by"), ["label", *keys, "bx", "by"], "left_semi")
    pts = few.groupBy("label", *keys, "bx", "by").agg(F.collect_list(F.struct("x", "y")).alias("pts"))
    return per.join(pts, ["label", *keys, "bx", "by"], "left")


def _witnesses(pairs: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """(links, open) of pairs of boxes a_*, b_* with the labels la, label of their cells."""
    low, high = _reach("a", "b")
    r2 = float(radius) ** 2
    both = F.col("a_pts").isNotNull() & F.col("b_pts").isNotNull()
    seen = F.exists("a_pts", lambda p: F.exists("b_pts", lambda q: planar2(p["x"], p["y"], q["x"], q["y"]) <= r2))
    judged = stage(pairs.where(low <= r2).withColumn("linked", (high <= r2) | (both & seen)).where(F.col("linked") | ~both)
                   .drop("a_pts", "b_pts"), "witness")
    links = judged.where("linked").select(F.col("la").alias("u"), F.col("label").alias("v")).distinct()
    rest = judged.where("not linked").join(links, (F.col("la") == F.col("u")) & (F.col("label") == F.col("v")), "left_anti")
    return links, rest


def radius_links(nodes: DataFrame, radius: float, nid: str, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """(members, links). Cells have a diagonal just under the radius, so all nodes
    of a cell belong together and need no pair; ``members`` maps node to cell
    label (lowest id) and ``links`` holds only label pairs of touching cells.

    Two cells need one witness: a pair of nodes within the radius. Their boxes settle most
    cases by distance alone; boxes of few coordinates are compared inside one row; what
    is still open is cut into smaller boxes, and a pair of cells leaves as soon as any
    of its boxes has a witness."""
    size = radius / math.sqrt(2) * (1 - 1e-9)
    keyed = nodes.select(nid, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    keyed = keyed.withColumn("kx", cell_of(F.col("x"), size)).withColumn("ky", cell_of(F.col("y"), size))
    labels = keyed.groupBy("kx", "ky").agg(F.min(nid).alias("label"))
    members = keyed.join(labels, ["kx", "ky"]).select(nid, "label")
    spots = stage(keyed.select("kx", "ky", "x", "y").distinct().join(labels, ["kx", "ky"]), "spots")  # copies collapse
    cells = stage(_boxes(spots.select("label", "x", "y", "kx", "ky"), size, ["kx", "ky"]).drop("bx", "by"), "cells")
    offs = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    box = ["x0", "x1", "y0", "y1", "n", "pts"]
    a = cells.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in offs])))
    a = a.select(F.col("label").alias("la"), (F.col("kx") + F.col("_o.dx")).alias("kx"), (F.col("ky") + F.col("_o.dy")).alias("ky"), *[F.col(c).alias(f"a_{c}") for c in box])
    links, rest = _witnesses(a.join(cells.withColumnsRenamed({c: f"b_{c}" for c in box}), ["kx", "ky"]).drop("kx", "ky"), radius)
    rest = rest.select("la", "label", F.lit(0).cast("bigint").alias("a_x"), F.lit(0).cast("bigint").alias("a_y"), F.lit(0).cast("bigint").alias("b_x"), F.lit(0).cast("bigint").alias("b_y"))
    at = spots.select("label", "x", "y", F.lit(0).cast("bigint").alias("px"), F.lit(0).cast("bigint").alias("py"))
    while True:
        rest = stage(rest, "open")
        if rest.isEmpty():
            return members, links
        # only the boxes that an open pair still needs are cut
        need = rest.select(F.col("la").alias("label"), F.col("a_x").alias("px"), F.col("a_y").alias("py")).union(rest.select("label", "b_x", "b_y")).distinct()
        at = at.join(need, ["label", "px", "py"], "left_semi")
        size /= WITNESS_PARTS
        subs = stage(_boxes(at, size, ["px", "py"]), "sub_boxes")
        side = lambda s, label: subs.select(F.col("label").alias(label), F.col("px").alias(f"{s}_x"), F.col("py").alias(f"{s}_y"), F.col("bx").alias(f"{s}_bx"), F.col("by").alias(f"{s}_by"), *[F.col(c).alias(f"{s}_{c}") for c in box])  # noqa: E731, B023
        pairs = rest.join(side("a", "la"), ["la", "a_x", "a_y"]).join(side("b", "label"), ["label", "b_x", "b_y"])
        more, rest = _witnesses(pairs, radius)
        links = links.union(more)
        rest = rest.select("la", "label", F.col("a_bx").alias("a_x"), F.col("a_by").alias("a_y"), F.col("b_bx").alias("b_x"), F.col("b_by").alias("b_y"))
        at = stage(at.select("label", "x", "y", cell_of(F.col("x"), size).alias("px"), cell_of(F.col("y"), size).alias("py")), "spots")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step (Kiveris et al., 2014): hook larger neighbours (large) or
    smaller neighbours and self (small) to the lowest id seen."""
    if large:
        adj = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        adj = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = adj.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = adj.join(low, "u")
    if large:
        new = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v")))
    return new.where(F.col("u") != F.col("v")).distinct()


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links``; root is the lowest id. Rounds grow
    with the logarithm of the size, not with the longest chain. Each round is
    written to the shared folder, so a lost executor repeats one round."""
    edges = stage(links.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "links")
    for _ in range(max_rounds):
        new = stage(_star(_star(edges, True), False), "star")
        # both are sets of distinct edges, so no edge on one side only means no change
        same = new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        discard(edges)
        edges = new
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


#: Members of a merged node up to which its row lists them; longer lists come in parts of about this size.
MEMBER_CHUNK = 10_000


def _component_of(nodes: DataFrame, radius: float, nid: str, x: str, y: str) -> DataFrame:
    members, links = radius_links(nodes, radius, nid, x, y)
    root = connected(links)
    return stage(members.join(root, members["label"] == root["node"], "left").select(nid, F.coalesce("root", "label").alias("root")), "component_of")


def _lists(comp: DataFrame, nid: str, chunk: int) -> DataFrame:
    """(root, part, parts, members): sorted members, dealt into parts by a hash where they are many."""
    sizes = comp.groupBy("root").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    return comp.join(sizes, "root").groupBy("root", F.pmod(F.xxhash64(nid), F.col("parts")).alias("part"), "parts").agg(F.array_sort(F.collect_list(nid)).alias("members"))


def member_chunks(nodes: DataFrame, radius: float, *, nid: str = "node_id", x: str = "x", y: str = "y", chunk: int | None = None) -> DataFrame:
    """(node, part, members) of every merged node: all its members, at most about ``chunk`` a row."""
    comp = _component_of(nodes, radius, nid, x, y)
    return _lists(comp, nid, chunk or MEMBER_CHUNK).select(F.col("root").alias(nid), "part", "members")


def merge_near_duplicates(nodes: DataFrame, radius: float, *, nid: str = "node_id", x: str = "x", y: str = "y",
                          freeway: str = "is_freeway", trunk: str = "is_trunk") -> DataFrame:
    """Collapse nodes linked by steps of at most ``radius``. The merged node has the
    centroid, sorted members and class by precedence freeway, trunk, surface. A node of more
    than ``MEMBER_CHUNK`` members has a null list; ``member_chunks`` gives it in parts."""
    comp = _component_of(nodes, radius, nid, x, y)
    g = nodes.join(comp, nid).groupBy("root").agg(
        F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("member_count"),
        F.max(freeway).alias("is_freeway"), F.max(trunk).alias("_t"))
    short = _lists(comp, nid, MEMBER_CHUNK).where("parts = 1").select("root", "members")
    return g.join(short, "root", "left").select(
        F.col("root").alias(nid), stable_site_id(F.col("x"), F.col("y")).alias("site_key"), "x", "y",
        "member_count", "members", "is_freeway",
        (F.col("_t") & ~F.col("is_freeway")).alias("is_trunk_borderline"), (~F.col("is_freeway")).alias("is_surface"))


def id_collisions(merged: DataFrame, key: str = "site_key") -> DataFrame:
    """Ids shared by several merged nodes (should be empty)."""
    return merged.groupBy(key).count().where("count > 1")
