"""Map, network, permit, transit and raster inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from junctura.sources import schemas as S
from junctura.sources.events import map_columns, read_text_csv, read_zipped_csv


def read_points_geojson(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """(lon, lat, props) of every point, also of each point of a multi-point feature. ``multi_line=False`` reads one
    document per line, which splits across tasks; a pretty-printed file does not."""
    f = spark.read.schema(S.GEOJSON_FEATURES).option("multiLine", multi_line).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    points = F.when(kind == "Point", F.array(F.from_json(text, "array<double>"))).when(kind == "MultiPoint", F.from_json(text, "array<array<double>>"))
    return f.select(F.explode(points).alias("p"), F.col("f.properties").alias("props")).select(
        F.get("p", 0).alias("lon"), F.get("p", 1).alias("lat"), "props")


def read_polygons_geojson(spark: SparkSession, path, id_prop: str, multi_line: bool = True) -> DataFrame:
    """(poly, ring, seq, x, y, props) of every polygon vertex. The rings of all parts of
    a multi-part polygon are numbered through: inside is inside an odd number of rings."""
    f = spark.read.schema(S.GEOJSON_FEATURES).option("multiLine", multi_line).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(text, "array<array<array<double>>>")).when(
        kind == "MultiPolygon", F.flatten(F.from_json(text, "array<array<array<array<double>>>>")))
    r = f.select(F.col(f"f.properties.{id_prop}").try_cast("bigint").alias("poly"), F.col("f.properties").alias("props"),
                 F.posexplode(rings).alias("ring", "pts"))
    return r.select("poly", "props", "ring", F.posexplode("pts").alias("seq", "p")).select(
        "poly", "ring", "seq", F.get("p", 0).alias("x"), F.get("p", 1).alias("y"), "props")


def osm_elements(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(S.OSM_ELEMENTS).option("multiLine", multi_line).json(path).select(F.explode("elements").alias("e")).select("e.*")


def element_points(elements: DataFrame) -> DataFrame:
    """(type, id, lon, lat, tags): a node's own point, a way's centre; elements with
    neither drop out."""
    return elements.select("type", "id", F.coalesce("lon", "center.lon").alias("lon"), F.coalesce("lat", "center.lat").alias("lat"), "tags"
                           ).where("lon IS NOT NULL AND lat IS NOT NULL")


def element_lines(elements: DataFrame) -> DataFrame:
    """(id, path of lon/lat, tags) of ways with at least two points."""
    return elements.where("type = 'way' AND size(geometry) >= 2").select(
        "id", F.transform("geometry", lambda g: F.struct(g["lon"].alias("lon"), g["lat"].alias("lat"))).alias("path"), "tags")


def read_graphml(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file: ids and a key-value map of attributes."""
    data = "data array<struct<_key string, _VALUE string>>"
    kv = lambda: F.map_from_entries(F.transform(F.filter("data", lambda d: d["_key"].isNotNull()),
                                                lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("attrs")
    n = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    e = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    return (n.select(F.col("_id").try_cast("bigint").alias("node"), kv()),
            e.select(F.col("_source").try_cast("bigint").alias("src"), F.col("_target").try_cast("bigint").alias("dst"), kv()))


def permits(raw: DataFrame, city: str | None = None) -> DataFrame:
    """Facility permits with a readable location."""
    x = raw.select(
        F.col("record_id").alias("facility_id"), F.col("record_name").alias("name"), "business_type", "address",
        F.upper(F.coalesce("city", F.lit(""))).alias("city"), "zip", "permit_status",
        F.upper(F.coalesce("active_permit", F.lit(""))).isin("Y", "YES", "TRUE").alias("active"),
        F.col("record_open_date").alias("opened"), F.col("latitude").try_cast("double").alias("lat"),
        F.col("longitude").try_cast("double").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")
    return x.where(F.col("city") == city.upper()) if city else x


def read_permits(spark: SparkSession, path, city: str | None = None) -> DataFrame:
    return permits(spark.read.schema(S.PERMITS).json(path), city)


def transit_stops(spark: SparkSession, pattern: str) -> DataFrame:
    """Stops of zipped feeds; a feed without the required columns gives no rows."""
    rows = map_columns(read_zipped_csv(spark, pattern, "stops.txt", "utf-8-sig"), ["stop_id", "stop_lat", "stop_lon"], keep=["path"])
    return rows.select("stop_id", F.col("stop_lat").try_cast("double").alias("stop_lat"),
                       F.col("stop_lon").try_cast("double").alias("stop_lon")).dropna()


def read_counts(spark: SparkSession, path) -> DataFrame:
    return read_text_csv(spark, path, ["location", "adt_total", "date", "lat", "lng"])


REPORT_COLS = ["report_id", "date_time", "address_road_primary", "address_sfx_primary", "address_name_intersecting", "address_sfx_intersecting", "injured", "killed"]


def read_reports(spark: SparkSession, path) -> DataFrame:
    """Police reports as text; headers match in any case and order."""
    return read_text_csv(spark, path, REPORT_COLS)


def read_volume_points(spark: SparkSession, path) -> DataFrame:
    r = read_text_csv(spark, path, ["lat", "lng", "adt_total"])
    return r.select(*[F.col(c).try_cast("double").alias(c) for c in r.columns])


def read_lookup(spark: SparkSession, path, schema: str) -> DataFrame:
    """Typed lookup CSV: ids stay text, leading zeros survive."""
    return spark.read.schema(schema).option("header", True).csv(path)
