"""Crash sources: two public layouts translated to one canonical frame."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from junctura.functions import records as R
from junctura.sources import schemas as S
from junctura.sources.bundles import read_members


def read_text_csv(spark: SparkSession, path, columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """CSV with headers, every value kept as text; columns a file lacks are null. Each
    file's own header decides its positions: files with one header are read together,
    and the groups are united by name."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for f in sorted(spark.read.text(path).inputFiles()):
        f = unquote(f)
        by_header.setdefault(tuple(reader.csv(f).columns), []).append(f)
    out = None
    for header, files in by_header.items():
        have = {c.upper(): c for c in header}
        part = reader.csv(files).select(
            *[(F.col(f"`{have[c.upper()]}`") if c.upper() in have else F.lit(None)).cast("string").alias(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns)) if out is None else out


def snapshot_paths(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, snap) of dated snapshot files, the date taken from the folder name."""
    f = spark.read.format("binaryFile").load(pattern).select("path")
    return f.withColumn("snap", F.regexp_extract("path", r"[/=](\d{8})/[^/]*$", 1))


def latest(df: DataFrame, snap: str) -> DataFrame:
    """Rows of the newest snapshot. The newest date is a scalar subquery, so a
    partitioned source prunes its folders by it."""
    return df.where(F.col(snap) == df.agg(F.max(snap)).scalar())


def first_wins(df: DataFrame, key: str, priority: list[Column]) -> DataFrame:
    """One row per key, the first in ``priority`` order. An aggregate, not a window,
    so copies of a key merge before the shuffle."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*priority)).alias("_s")).select(key, "_s.*")


def merge_snapshots(frames: list[DataFrame], key: str) -> DataFrame:
    """Overlapping snapshots; the earlier listed one wins per id."""
    out = None
    for i, f in enumerate(frames):
        g = f.withColumn("_p", F.lit(i))
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    rest = [F.col(c) for c in sorted(frames[0].columns) if c != key]
    return first_wins(out, key, [F.col("_p"), *rest]).drop("_p")


def provenance(raw: DataFrame) -> DataFrame:
    """Coordinate sources in one pass."""
    x, y = F.col("POINT_X").try_cast("double"), F.col("LATITUDE").try_cast("double")
    return raw.agg(F.count("*").alias("n_raw"), F.count(x).alias("n_point_xy"), F.count(y).alias("n_lat_lon"),
                   F.count_if(F.col("STATE_HWY_IND") == "Y").alias("n_state_hwy"))


def load_crashes(raw: DataFrame, exclude_state_highway: bool = True) -> DataFrame:
    """Analysis rows: primary coordinates, readable date and severity, surface
    streets. An unknown highway marker is kept."""
    x = raw.select(
        F.col("CASE_ID").alias("id"), R.parsed_date(F.col("COLLISION_DATE")).alias("date"),
        F.col("COLLISION_SEVERITY").try_cast("int").alias("severity"), F.col("POINT_X").try_cast("double").alias("lon"),
        F.col("POINT_Y").try_cast("double").alias("lat"), "STATE_HWY_IND")
    if exclude_state_highway:
        x = x.where(R.keeps_unknown(F.col("STATE_HWY_IND"), "Y"))
    return x.where(F.col("date").isNotNull() & F.col("severity").isNotNull() & R.valid_point(F.col("lat"), F.col("lon")))


def history_rows(raw: DataFrame, exclude_state_highway: bool = True) -> DataFrame:
    """Rows for the history features: like ``load_crashes`` but a null severity stays."""
    x = raw.select(
        "CASE_ID", R.parsed_date(F.col("COLLISION_DATE")).alias("date"), F.col("COLLISION_SEVERITY").alias("severity"),
        F.col("POINT_X").try_cast("double").alias("lon"), F.col("POINT_Y").try_cast("double").alias("lat"), "STATE_HWY_IND",
        F.col("PEDESTRIAN_ACCIDENT").alias("ped"), F.col("BICYCLE_ACCIDENT").alias("bike"),
        F.col("TYPE_OF_COLLISION").alias("collision"), F.col("LIGHTING").alias("lighting"),
        F.col("ALCOHOL_INVOLVED").alias("alcohol"), F.col("PCF_VIOL_CATEGORY").alias("pcf"))
    if exclude_state_highway:
        x = x.where(R.keeps_unknown(F.col("STATE_HWY_IND"), "Y"))
    return x.where(F.col("date").isNotNull() & R.valid_point(F.col("lat"), F.col("lon")))


def best_coordinates(raw: DataFrame) -> DataFrame:
    """Primary coordinates, the secondary field where the primary is missing."""
    x = F.coalesce(F.col("POINT_X").try_cast("double"), F.col("LONGITUDE").try_cast("double"))
    y = F.coalesce(F.col("POINT_Y").try_cast("double"), F.col("LATITUDE").try_cast("double"))
    return raw.withColumns({"lon": x, "lat": y})


def left_turn_ids(parties: DataFrame) -> DataFrame:
    """Case ids with a party turning left (one row per case)."""
    return parties.where(F.col("MOVE_PRE_ACC").isin(*R.LEFT_TURN_CODES)).select("CASE_ID").distinct()


def finalize(df: DataFrame, drop_invalid: bool = True) -> DataFrame:
    """The canonical frame: fixed columns and order, absent optional ones null
    (unknown, never false), invalid rows dropped."""
    have = set(df.columns)
    cols = [F.col(n).cast(t).alias(n) for n, t in S.CANONICAL_REQUIRED]
    cols += [(F.col(n) if n in have else F.lit(None)).cast("boolean").alias(n) for n in S.CANONICAL_FLAGS]
    cols += [(F.col(n) if n in have else F.lit(None)).cast("string").alias(n) for n in S.CANONICAL_ATTRS]
    missing = [n for n, _ in S.CANONICAL_REQUIRED if n not in have]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    out = df.select(*cols)
    if drop_invalid:
        out = out.where(R.valid_point(F.col("lat"), F.col("lon")) & F.col("date").isNotNull()
                        & F.coalesce(R.valid_severity(F.col("severity")), F.lit(False)))
    return out


def state_extract(raw: DataFrame, parties: DataFrame | None = None, exclude_state_highway: bool = True) -> DataFrame:
    """First layout to canonical. Code comparisons give false for a missing code, as
    the source leaves a blank for "no"; left turns stay unknown without parties."""
    yes = lambda c: F.coalesce(F.col(c) == "Y", F.lit(False))
    among = lambda c, v: F.coalesce(F.col(c).isin(*v), F.lit(False))
    x = raw.select(
        F.col("CASE_ID").alias("crash_id"), R.parsed_date(F.col("COLLISION_DATE")).alias("date"),
        F.col("COLLISION_SEVERITY").try_cast("int").alias("severity"), F.col("POINT_X").try_cast("double").alias("lon"),
        F.col("POINT_Y").try_cast("double").alias("lat"), yes("STATE_HWY_IND").alias("is_state_highway"),
        yes("PEDESTRIAN_ACCIDENT").alias("is_ped"), yes("BICYCLE_ACCIDENT").alias("is_bike"),
        among("TYPE_OF_COLLISION", R.BROADSIDE_CODES).alias("is_broadside"), among("LIGHTING", R.NIGHT_CODES).alias("is_night"),
        yes("ALCOHOL_INVOLVED").alias("is_dui"),
        F.coalesce(F.trim("PCF_VIOL_CATEGORY") == R.PED_ROW_CATEGORY, F.lit(False)).alias("is_ped_row_violation"),
        F.lit("California").alias("state_name"))
    if parties is not None:
        lt = left_turn_ids(parties).select(F.col("CASE_ID").alias("crash_id"), F.lit(True).alias("_lt"))
        x = x.join(lt, "crash_id", "left").withColumn("is_left_turn", F.coalesce("_lt", F.lit(False))).drop("_lt")
    if exclude_state_highway:
        x = x.where(~F.col("is_state_highway"))
    return finalize(x).withColumn("severity_scheme", F.lit("ksi"))


def _named(df: DataFrame, code: str) -> Column:
    """The decoded text of a code column when the bundle has it, else the code."""
    a, b = f"{code}NAME", code
    cols = [F.col(c).cast("string") for c in (a, b) if c in df.columns]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def fatal_census(acc: DataFrame, people: DataFrame | None = None, state: str | None = None, place: str | None = None,
                 exclude_freeway: bool = True, intersection_only: bool = False) -> DataFrame:
    """Second layout (annual national bundles, ``bundle_year`` attached) to canonical."""
    word = lambda c, rx: F.coalesce(_named(acc, c).rlike(rx), F.lit(False))
    num = lambda c: F.col(c).try_cast("double")
    inside = num("LATITUDE").between(*R.ENVELOPE_LAT) & num("LONGITUD").between(*R.ENVELOPE_LON)
    opt = lambda c: (F.col(c) if c in acc.columns else F.lit(None)).cast("string")
    x = acc.select(
        F.concat_ws("-", F.col("bundle_year").cast("string"), F.col("ST_CASE").cast("string")).alias("crash_id"),
        F.col("ST_CASE").cast("string").alias("_case"), F.col("bundle_year").alias("_yr"),
        R.safe_date(F.coalesce(opt("YEAR"), F.col("bundle_year").cast("string")), F.col("MONTH").cast("string"),
                    F.col("DAY").cast("string")).alias("date"),
        F.when(inside, num("LATITUDE")).alias("lat"), F.when(inside, num("LONGITUD")).alias("lon"), F.lit(1).alias("severity"),
        F.coalesce(_named(acc, "RELJCT2").isin(*R.JUNCTION_WORDS), F.lit(False)).alias("at_intersection"),
        word("FUNC_SYS", R.FREEWAY_WORDS).alias("is_state_highway"), _named(acc, "FUNC_SYS").alias("functional_class"),
        word("MAN_COLL", R.BROADSIDE_WORDS).alias("is_broadside"), word("LGT_COND", R.NIGHT_WORDS).alias("is_night"),
        opt("CITYNAME").alias("place_name"), opt("STATENAME").alias("state_name"),
        F.coalesce(opt("PEDS").try_cast("double"), F.lit(0.0)).alias("_peds"))
    if people is not None:
        k = people.groupBy(F.col("ST_CASE").cast("string").alias("_case"), F.col("bundle_year").alias("_yr")).agg(
            F.max(F.col("PBPTYPENAME").rlike("(?i)pedestrian")).alias("is_ped"),
            F.max(F.col("PBPTYPENAME").rlike("(?i)bicyclist|cyclist")).alias("is_bike"))
        x = x.join(k, ["_case", "_yr"], "left").fillna(False, ["is_ped", "is_bike"])
    else:
        x = x.withColumn("is_ped", F.col("_peds") > 0)  # bikes stay unknown without the person table
    if state:
        x = x.where(F.lower("state_name") == state.lower())
    if place:
        x = x.where(F.lower("place_name") == place.lower())
    if exclude_freeway:
        x = x.where(~F.col("is_state_highway"))
    if intersection_only:
        x = x.where("at_intersection")
    return finalize(x).withColumn("severity_scheme", F.lit("fatal_only"))


ADAPTERS = {"state_extract": state_extract, "fatal_census": fatal_census}


def get_adapter(name: str):
    if name not in ADAPTERS:
        raise KeyError(f"unknown source {name!r}; one of {sorted(ADAPTERS)}")
    return ADAPTERS[name]


def read_zipped_csv(spark: SparkSession, pattern: str, member: str, encoding: str = "latin-1") -> DataFrame:
    """(path, row map, bundle_year) of one CSV inside each zip, name matched without
    case. One task reads one member as a stream; its rows come out in batches."""
    year = F.regexp_extract("path", r"(\d{4})[^/]*$", 1).try_cast("int")
    return read_members(spark, pattern, member, encoding).withColumn("bundle_year", year)


def map_columns(rows: DataFrame, names: list[str], keep: list[str] = ("bundle_year",)) -> DataFrame:
    """Chosen keys of the row map as columns (null when the bundle lacks them)."""
    return rows.select(*keep, *[F.try_element_at("row", F.lit(n)).alias(n) for n in names])


def open_data_crashes(raw: DataFrame) -> DataFrame:
    """City open data with optional columns; the id is a hash of the row, so it does
    not depend on the order of reading. Identical rows are told apart by a number."""
    ren = {"date_time": "date", "latitude": "lat", "longitude": "lon"}
    have = {c.lower(): c for c in raw.columns}
    pick = lambda new: next((F.col(have[o]) for o, n in ren.items() if n == new and o in have),
                            F.col(have[new]) if new in have else F.lit(None)).cast("string")
    x = raw.select(
        F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in raw.columns]), 256).alias("_h"),
        R.parsed_date(pick("date")).alias("date"), pick("severity").try_cast("int").alias("severity"),
        pick("lat").try_cast("double").alias("lat"), pick("lon").try_cast("double").alias("lon"))
    x = x.where(F.col("date").isNotNull() & R.valid_point(F.col("lat"), F.col("lon")))
    # Copies of a row collapse to a count and are numbered without a window.
    n = x.groupBy(*x.columns).agg(F.count("*").alias("_n")).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    return n.select(F.concat_ws("-", "_h", F.col("_i").cast("string")).alias("id"), "date", "severity", "lat", "lon")
