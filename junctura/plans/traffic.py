"""Traffic counts and police reports matched to sites by street name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from junctura.functions import text as T
from junctura.functions.geo import hypot_m
from junctura.functions.records import parsed_date
from junctura.session import stage

NEARBY_M = 250.0
CELL_COUNTS = 256   # counts of one street and cell in one row


def parse_counts(raw: DataFrame) -> DataFrame:
    """(street, limits, total, date, lat, lng, parsed). Rows without a readable
    location stay with parsed = false so the skipped rows can be counted."""
    street, limits = T.parse_location(F.col("location"))
    lat, lng = F.col("lat").try_cast("double"), F.col("lng").try_cast("double")
    both = lat.isNotNull() & lng.isNotNull()
    row = raw.select(F.struct(
        street.alias("street"), limits.alias("limits"),
        F.coalesce(F.floor(F.col("adt_total").try_cast("double")), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce("date", F.lit("")).alias("date"), F.when(both, lat).alias("lat"), F.when(both, lng).alias("lng"),
        street.isNotNull().alias("parsed")).alias("_r"))
    # A generator: filters on the result are not pushed below it, where they would read every text again.
    return row.select(F.inline(F.array("_r")))


def site_streets(sites: DataFrame, sid: str = "site_id", name: str = "name") -> DataFrame:
    """Two rows per "A & B" site: street and other; other labels give none."""
    p = T.split_label(F.col(name))
    legs = F.explode(F.array(
        F.struct(F.lit(0).alias("leg"), F.get(p, 0).alias("street"), F.get(p, 1).alias("other")),
        F.struct(F.lit(1).alias("leg"), F.get(p, 1).alias("street"), F.get(p, 0).alias("other")))).alias("l")
    return sites.where(F.size(p) == 2).select(sid, "lat", "lon", legs).select(
        sid, "lat", "lon", "l.*", T.road_key(F.col("l.street")).alias("road"), T.road_key(F.col("l.other")).alias("cross"))


def legs(sites: DataFrame, counts: DataFrame, sid: str = "site_id", max_m: float = NEARBY_M) -> DataFrame:
    """One count per leg. A count whose limits name the other street wins (most
    recent, then largest); else the nearest count on the street within ``max_m``.

    Counts are reduced before the joins. For the limits rule only the best count
    per (street, cross) can win, so that is what is joined, by equality. For the
    distance rule counts also meet by cell, so a long street never emits all its
    pairs with its corners.
    """
    st = site_streets(sites, sid)
    c = counts.where("total > 0").select("street", "limits", "total", "date", "lat", "lng").withColumn("road", T.road_key(F.col("street")))
    c = c.withColumn("yr", F.coalesce(T.year_of(F.col("date")), F.lit(0))).drop("street", "date")
    c = stage(c, "counts")  # texts are read once, both rules go on from their keys
    pick = F.struct(F.col("yr"), F.col("total"), F.col("limits"))
    by_limits = c.groupBy("road", "limits").agg(F.max(F.struct("yr", "total")).alias("_t")).select("road", "limits", "_t.*")
    by_cross = (
        by_limits.select("road", "yr", "total", "limits", F.explode(F.array_distinct(T.limits_keys(F.col("limits")))).alias("cross"))
        .where("cross <> ''").groupBy("road", "cross").agg(F.max(pick).alias("best"))
    )
    a = stage(st.join(by_cross, ["road", "cross"], "left"), "street_ends")
    found = a.where("best IS NOT NULL").withColumn("method", F.lit("limits"))
    rest = a.where("best IS NULL").drop("best")
    # Cells in degrees: rows of one height, and in each row a width that holds it at its latitude.
    # A cell's counts are one array (a fuller cell gives several); the legs, the smaller side,
    # look into every cell in their reach, and the nearest count is picked inside that row.
    dlat, reach = 2 * max_m / 110_540.0, max_m * (1 + 1e-9)
    cell = lambda v, d: F.floor(v / d).cast("bigint")
    degrees = lambda m, lat: F.lit(m) / (F.lit(111_320.0) * F.cos(F.radians(F.least(lat, F.lit(89.9)))))
    width = lambda ky: degrees(2 * max_m, F.greatest(F.abs(ky), F.abs(ky + 1)) * dlat)
    span = lambda v, r, d: F.explode(F.sequence(cell(v - r, d), cell(v + r, d)))
    geo = c.where("lat IS NOT NULL").groupBy("road", "lat", "lng").agg(F.min_by(pick, F.struct("limits", "total", "yr")).alias("best"))
    geo = geo.withColumn("ky", cell(F.col("lat"), dlat)).withColumn("kx", cell(F.col("lng"), width(F.col("ky"))))
    geo = stage(geo.select("road", "ky", "kx", F.struct("lat", "lng", "best").alias("q")), "count_spots")
    keys = ["road", "ky", "kx"]
    full = geo.groupBy(*keys).agg(F.ceil(F.count("*") / CELL_COUNTS).alias("_k")).where("_k > 1")
    part = F.when(F.col("_k").isNotNull(), F.pmod(F.xxhash64("q.lat", "q.lng"), F.col("_k"))).otherwise(0)
    blocks = geo.join(full, keys, "left").groupBy(*keys, part.alias("part")).agg(F.collect_list("q").alias("counts")).drop("part")
    at = rest.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("ky", span(F.col("lat"), F.lit(reach / 110_540.0), F.lit(dlat)))
    at = at.withColumn("kx", span(F.col("lon"), degrees(reach, F.abs("lat")), width(F.col("ky"))))
    seen = F.filter(F.transform("counts", lambda q: F.struct(
        hypot_m(F.col("lon"), F.col("lat"), q["lng"], q["lat"]).alias("d"), q["best"]["limits"].alias("limits"), q["best"]["total"].alias("total"), q["best"]["yr"].alias("yr"))),
        lambda q: q["d"] <= max_m)
    near = (
        at.join(blocks, keys).select(sid, "leg", "street", F.explode(F.slice(F.array_sort(seen), 1, 1)).alias("q"))
        .groupBy(sid, "leg", "street").agg(F.min("q").alias("q"))
        .select(sid, "leg", "street", F.struct("q.yr", "q.total", "q.limits").alias("best"), F.lit("nearby").alias("method"))
    )
    out = found.select(sid, "leg", "street", "best", "method").unionByName(near.select(sid, "leg", "street", "best", "method"))
    return out.select(sid, "leg", "street", F.col("best.total").alias("adt"),
                      F.when(F.col("best.yr") > 0, F.col("best.yr")).alias("year"), F.col("best.limits").alias("limits"), "method")


def entering(site_legs: DataFrame, sid: str = "site_id") -> DataFrame:
    """Entering volume per site; complete when both legs were found. At most two
    rows per site."""
    return site_legs.groupBy(sid).agg(
        F.sum("adt").alias("entering"), (F.count("*") == 2).alias("complete"),
        F.array_sort(F.collect_list(F.struct("leg", "street", "adt", "year", "limits", "method"))).alias("legs"))


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def parse_reports(raw: DataFrame, since: str) -> DataFrame:
    """Police rows to (pair, date, injured, killed): blank cross street, earlier
    dates and same-street rows drop out."""
    r = lower_columns(raw)
    txt = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    num = lambda c: F.coalesce(txt(c).try_cast("double").cast("int"), F.lit(0))
    street = lambda a, b: T.road_key(F.trim(F.concat_ws(" ", txt(a), txt(b))))
    day = F.substring(txt("date_time"), 1, 10)
    x = r.where((txt("address_name_intersecting") != "") & (F.length(day) == 10) & (day >= since))
    pair = T.pair_key(street("address_road_primary", "address_sfx_primary"),
                      street("address_name_intersecting", "address_sfx_intersecting"))
    return x.select(pair.alias("pair"), parsed_date(txt("date_time")).alias("date"), num("injured").alias("injured"),
                    num("killed").alias("killed")).where("pair IS NOT NULL")


def reports_by_pair(reports: DataFrame) -> DataFrame:
    return reports.groupBy("pair").agg(F.count("*").alias("n_reports"), F.sum("injured").alias("injured"),
                                       F.sum("killed").alias("killed"), F.max("date").alias("last"))


def reports_by_site(sites: DataFrame, by_pair: DataFrame, sid: str = "site_id", name: str = "name") -> DataFrame:
    return sites.select(sid, T.label_pair_key(F.col(name)).alias("pair")).where("pair IS NOT NULL").join(by_pair, "pair")
