"""Derived inputs. The bundled tables have no coordinates, so places and events get
them from a salted md5, the same expression in Spark and in the checking SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPAN = 10007
WORDS = ("Maple", "Oak", "Harbor", "Summit", "Canyon", "Mission", "Garnet", "Laurel", "Juniper", "Orange")
CROSS = ("First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bits(salt: str, k: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), k.cast("string"))), 1, 8), 16, 10).cast("bigint")


def h(salt: str, k: Column) -> Column:
    return bits(salt, k) % SPAN


def bits_sql(salt: str, k: str) -> str:
    return f"('0x'||substr(md5('{salt}'||{k}),1,8))::BIGINT"


def h_sql(salt: str, k: str) -> str:
    return f"({bits_sql(salt, k)} % {SPAN})"


def _pick(words, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (k + 1).cast("int"))


def _pick_sql(words, k: str) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + f"][(({k})+1)::INT]"


def sites(spark: SparkSession, sf: str) -> DataFrame:
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    x, y = h("sx", k).cast("double"), h("sy", k).cast("double")
    st = F.floor(k / 8)
    a = F.concat_ws(" ", _pick(WORDS, st % 10), st.cast("string"), F.lit("Street"))
    b = F.concat_ws(" ", _pick(CROSS, k % 8), F.lit("Avenue"))
    return c.select(
        k.alias("site_id"), x.alias("x"), y.alias("y"), (x * 0.00001 - 117.2).alias("lon"), (y * 0.00001 + 32.7).alias("lat"),
        (k + 5000).alias("osm_id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("acctbal"), (F.col("c_nationkey") % 8 != 0).alias("is_surface"),
        (F.col("c_nationkey") % 8 == 0).alias("is_freeway"), (F.col("c_nationkey") % 5 == 0).alias("is_trunk"),
        (F.col("c_nationkey") % 10).cast("int").alias("council_district"),
        F.when(k % 10 == 9, a).otherwise(F.concat_ws(" & ", a, b)).alias("name"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    x, y = h("ex", k).cast("double"), h("ey", k).cast("double")
    pr = F.col("o_orderpriority")
    return o.select(
        k.alias("event_id"), F.col("o_orderdate").cast("date").alias("date"), (k % 5 + 1).cast("int").alias("severity"),
        x.alias("x"), y.alias("y"), (x * 0.00001 - 117.2).alias("lon"), (y * 0.00001 + 32.7).alias("lat"),
        F.when(k % 19 != 0, F.when(pr == "1-URGENT", "Y").otherwise("N")).alias("ped"),
        F.when(pr == "2-HIGH", "Y").otherwise("N").alias("bike"),
        F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "O", "A").alias("collision"),
        F.char(k % 6 + 65).alias("lighting"),
        F.when(k % 11 == 0, "Y").when(k % 11 != 1, "N").alias("alcohol"),
        F.when(k % 13 != 0, F.concat(F.lpad((k % 12).cast("string"), 2, "0"), F.lit(" "))).alias("pcf"),
        F.when(k % 17 == 0, "Y").when(k % 17 != 1, "N").alias("state_hwy"), (k % 7 == 0).alias("is_left_turn"))


def crash_text(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a raw text extract, with unreadable and missing values."""
    e, k = events(spark, sf), F.col("event_id")
    s = lambda c: F.col(c).cast("string")
    return e.select(
        k.cast("string").alias("CASE_ID"),
        F.when(k % 23 == 0, "not a date").when(k % 29 != 0, s("date")).alias("COLLISION_DATE"),
        F.when(k % 31 == 0, "x").otherwise(s("severity")).alias("COLLISION_SEVERITY"),
        F.when(k % 37 != 0, F.format_string("%.5f", "lon")).alias("POINT_X"), F.when(k % 37 != 0, F.format_string("%.5f", "lat")).alias("POINT_Y"),
        F.when(k % 2 == 0, F.format_string("%.5f", "lat")).alias("LATITUDE"), F.when(k % 2 == 0, F.format_string("%.5f", "lon")).alias("LONGITUDE"),
        F.col("state_hwy").alias("STATE_HWY_IND"), F.col("ped").alias("PEDESTRIAN_ACCIDENT"), F.col("bike").alias("BICYCLE_ACCIDENT"),
        F.col("collision").alias("TYPE_OF_COLLISION"), F.col("lighting").alias("LIGHTING"), F.col("alcohol").alias("ALCOHOL_INVOLVED"),
        F.col("pcf").alias("PCF_VIOL_CATEGORY"))


def parties(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("CASE_ID"), F.char(F.col("l_linenumber") + 64).alias("MOVE_PRE_ACC"))


def road_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are even nodes, parts odd ones."""
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    a = o.select((F.col("o_orderkey") * 2).alias("node"), h("ex", F.col("o_orderkey")).cast("double").alias("x"), h("ey", F.col("o_orderkey")).cast("double").alias("y"))
    b = p.select((F.col("p_partkey") * 2 + 1).alias("node"), h("px", F.col("p_partkey")).cast("double").alias("x"), h("py", F.col("p_partkey")).cast("double").alias("y"))
    return a.unionAll(b)


HIGHWAYS = ("residential", "tertiary", "secondary", "primary", "trunk", "motorway", "service", "unclassified", "living_street", "primary_link")


def road_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as roads between order nodes and part nodes."""
    li = table(spark, sf, "lineitem")
    q, t = F.col("l_quantity").cast("int"), (F.col("l_tax") * 100).cast("int")
    hw = _pick(HIGHWAYS, F.col("l_partkey") % 10)
    hw2 = _pick(HIGHWAYS, F.col("l_suppkey") % 10)
    w = F.concat_ws(" ", _pick(WORDS, F.col("l_partkey") % 10), F.floor(F.col("l_partkey") / 10).cast("string"))
    return li.select(
        (F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"),
        F.when(q % 9 == 0, F.array(hw, hw2)).otherwise(F.array(hw)).alias("highway"),
        F.when(q % 7 == 0, None).when(q % 7 == 1, "2|1").when(q % 7 == 2, "unknown").otherwise((q % 7).cast("string")).alias("lanes"),
        F.when(q % 5 == 0, None).when(q % 5 == 1, F.concat((q % 4 * 10 + 25).cast("string"), F.lit(" mph"))).when(
            q % 5 == 2, F.concat((q % 4 * 10 + 40).cast("string"), F.lit(" km/h"))).when(q % 5 == 3, "signals").otherwise((q + 20).cast("string")).alias("maxspeed"),
        F.when(t == 0, F.array().cast("array<string>")).when(t == 1, F.array(F.concat_ws(" ", w, F.lit("St")), F.concat_ws(" ", w, F.lit("Street")))).otherwise(
            F.array(F.concat_ws(" ", w, F.lit("Street")))).alias("name"),
        F.when(q % 11 == 0, F.array(F.lit("alley"))).when(q % 11 == 1, F.array(F.lit("yard"))).alias("service"))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """One polygon per nation on a 5 x 5 tiling: a slanted quadrilateral (even) or an
    L-shape (odd). Columns poly, ring, seq, x, y."""
    n = table(spark, sf, "nation")
    quad = [(0, 100), (1900, 0), (2000, 1800), (200, 2000)]
    ell = [(0, 0), (2000, 0), (2000, 1000), (1000, 1000), (1000, 2000), (0, 2000)]
    arr = lambda v: F.array(*[F.struct(F.lit(float(a)).alias("vx"), F.lit(float(b)).alias("vy")) for a, b in v])
    k = F.col("n_nationkey")
    v = n.select(k.cast("bigint").alias("poly"), F.lit(0).alias("ring"), F.posexplode(F.when(k % 2 == 0, arr(quad)).otherwise(arr(ell))).alias("seq", "v"))
    return v.select("poly", "ring", "seq", (F.col("v.vx") + (F.col("poly") % 5) * 2000).alias("x"), (F.col("v.vy") + F.floor(F.col("poly") / 5) * 2000).alias("y"))


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    return s.select(k.alias("place_id"), F.col("s_name").alias("place_name"), h("px", k).cast("double").alias("x"), h("py", k).cast("double").alias("y"),
                    _pick(("school", "kindergarten", "college", "university"), k % 4).alias("amenity"))


def control_nodes(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select(k.alias("control_id"), h("cx", k).cast("double").alias("x"), h("cy", k).cast("double").alias("y"),
                    _pick(("traffic_signals", "stop", "give_way"), F.col("p_size") % 3).alias("kind"), (F.col("p_size") % 2 == 0).alias("all_way"))


def counts_text(spark: SparkSession, sf: str) -> DataFrame:
    """Traffic count rows as published text."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    st = F.floor(k / 80)
    a = F.concat_ws(" ", _pick(WORDS, st % 10), st.cast("string"), F.lit("St"))
    b, c = F.concat_ws(" ", _pick(CROSS, k % 8), F.lit("Av")), F.concat_ws(" ", _pick(CROSS, (k + 1) % 8), F.lit("Ave"))
    loc = F.when(k % 12 == 0, a).when(k % 12 == 1, F.concat_ws(" ", a, F.lit("at"), b)).otherwise(F.concat_ws(" ", a, F.lit("btwn"), b, F.lit("_"), c))
    x, y = h("ex", k), h("ey", k)
    return o.select(loc.alias("location"),
                    F.when(k % 14 == 0, "n/a").otherwise(F.concat(F.floor("o_totalprice").cast("string"), F.lit(".0"))).alias("adt_total"),
                    F.col("o_orderdate").cast("date").cast("string").alias("date"),
                    F.when(k % 9 != 0, F.format_string("%.5f", y * 0.00001 + 32.7)).alias("lat"),
                    F.when(k % 9 != 0, F.format_string("%.5f", x * 0.00001 - 117.2)).alias("lng"))


def reports_text(spark: SparkSession, sf: str) -> DataFrame:
    """Police rows with upper-case headers."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    st = F.floor(k / 80)
    road, cross = F.concat_ws(" ", F.upper(_pick(WORDS, st % 10)), st.cast("string")), F.upper(_pick(CROSS, k % 8))
    flip = k % 2 == 0
    return o.select(
        k.cast("string").alias("REPORT_ID"), F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit(" 08:00:00")).alias("DATE_TIME"),
        F.when(flip, road).otherwise(cross).alias("ADDRESS_ROAD_PRIMARY"), F.when(flip, "ST").otherwise("AVENUE").alias("ADDRESS_SFX_PRIMARY"),
        F.when(k % 6 != 0, F.when(flip, cross).otherwise(road)).alias("ADDRESS_NAME_INTERSECTING"),
        F.when(flip, "AV").otherwise("STREET").alias("ADDRESS_SFX_INTERSECTING"),
        F.when(k % 15 == 0, "").otherwise((k % 4).cast("string")).alias("INJURED"), F.when(k % 50 == 0, "1").otherwise("0").alias("KILLED"))


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """Inspections of supplier kitchens, one per line item."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("facility_id"), F.col("l_shipdate").cast("date").alias("date"),
        F.when(F.col("l_returnflag") == "R", "reinspection").when(F.col("l_returnflag") == "A", "routine").when(F.col("l_linenumber") == 7, "complaint").alias("type"),
        F.when(F.col("l_linenumber") != 6, (100 - F.col("l_quantity")).cast("int")).alias("score"), F.lit(None).cast("string").alias("grade"),
        (F.col("l_linenumber") % 3).cast("int").alias("major"), (F.col("l_linenumber") % 4).cast("int").alias("minor"),
        (F.col("l_discount") >= 0.1).alias("closed"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


THEME_CYCLE = ("temperature", "handwashing", "vermin", "sanitizing", "storage", "hygiene", "equipment", "plumbing", "labeling", "parking", "other", "noise")


def violations(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("facility_id"), F.col("l_shipdate").cast("date").alias("date"),
                     _pick(THEME_CYCLE, F.col("l_partkey") % 12).alias("theme"), F.when(F.col("l_tax") >= 0.05, "major").otherwise("minor").alias("severity"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Elevation raster of 50 columns, one pixel per part."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    return p.select(F.floor(k / 50).alias("row"), (k % 50).alias("col"), (F.col("p_size") * 1.0 + F.col("p_retailprice") / 100).alias("elev"))


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """A short path per order, one vertex per line item."""
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    v = li.select(k.alias("path_id"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("seq"),
                  (h("ex", k) + h("vx", F.col("l_partkey")) % 300).cast("double").alias("x"), (h("ey", k) + h("vy", F.col("l_partkey")) % 300).cast("double").alias("y"))
    return v.distinct()


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Sites with hash scores (many ties), a label count and a block."""
    s = sites(spark, sf)
    k = F.col("site_id")
    lab = F.when(bits("ya", k) % 10 == 0, bits("yb", k) % 3 + 1).otherwise(0)
    sa = (bits("sa", k) % 500) / 1000.0 + F.when(lab > 0, 0.25).otherwise(0.0)
    return s.withColumn("label", lab.cast("int")).withColumn("score_a", F.round(sa, 3)).withColumn(
        "score_b", (bits("sb", k) % 1000) / 1000.0).withColumn("hit", (F.col("label") >= 1).cast("int"))


# ---- the same inputs as SQL ------------------------------------------------

_A = f"{_pick_sql(WORDS, 'c_custkey//8%10')}||' '||(c_custkey//8)||' Street'"
_B = f"{_pick_sql(CROSS, 'c_custkey%8')}||' Avenue'"
_ST = "o_orderkey//80"
_CA = f"{_pick_sql(WORDS, _ST + '%10')}||' '||({_ST})||' St'"
_CB, _CC = f"{_pick_sql(CROSS, 'o_orderkey%8')}||' Av'", f"{_pick_sql(CROSS, '(o_orderkey+1)%8')}||' Ave'"
_RR, _RC = f"upper({_pick_sql(WORDS, _ST + '%10')})||' '||({_ST})", f"upper({_pick_sql(CROSS, 'o_orderkey%8')})"
_HW, _HW2 = _pick_sql(HIGHWAYS, "l_partkey%10"), _pick_sql(HIGHWAYS, "l_suppkey%10")
_W = f"{_pick_sql(WORDS, 'l_partkey%10')}||' '||(l_partkey//10)"

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "sites": ((), f"""SELECT c_custkey AS site_id, x, y, x*0.00001::DOUBLE-117.2::DOUBLE AS lon, y*0.00001::DOUBLE+32.7::DOUBLE AS lat,
      c_custkey+5000 AS osm_id, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS acctbal, c_nationkey%8<>0 AS is_surface,
      c_nationkey%8=0 AS is_freeway, c_nationkey%5=0 AS is_trunk, (c_nationkey%10)::INT AS council_district,
      CASE WHEN c_custkey%10=9 THEN {_A} ELSE {_A}||' & '||{_B} END AS name
      FROM (SELECT *, {h_sql('sx','c_custkey')}::DOUBLE AS x, {h_sql('sy','c_custkey')}::DOUBLE AS y FROM customer)"""),
    "ev": ((), f"""SELECT o_orderkey AS event_id, o_orderdate::DATE AS date, (o_orderkey%5+1)::INT AS severity, x, y,
      x*0.00001::DOUBLE-117.2::DOUBLE AS lon, y*0.00001::DOUBLE+32.7::DOUBLE AS lat,
      CASE WHEN o_orderkey%19<>0 THEN CASE WHEN o_orderpriority='1-URGENT' THEN 'Y' ELSE 'N' END END AS ped,
      CASE WHEN o_orderpriority='2-HIGH' THEN 'Y' ELSE 'N' END AS bike,
      CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'A' END AS collision, chr((o_orderkey%6+65)::INT) AS lighting,
      CASE WHEN o_orderkey%11=0 THEN 'Y' WHEN o_orderkey%11<>1 THEN 'N' END AS alcohol,
      CASE WHEN o_orderkey%13<>0 THEN lpad((o_orderkey%12)::VARCHAR,2,'0')||' ' END AS pcf,
      CASE WHEN o_orderkey%17=0 THEN 'Y' WHEN o_orderkey%17<>1 THEN 'N' END AS state_hwy, o_orderkey%7=0 AS is_left_turn
      FROM (SELECT *, {h_sql('ex','o_orderkey')}::DOUBLE AS x, {h_sql('ey','o_orderkey')}::DOUBLE AS y FROM orders)"""),
    "crash_text": (("ev",), """SELECT event_id::VARCHAR AS CASE_ID,
      CASE WHEN event_id%23=0 THEN 'not a date' WHEN event_id%29<>0 THEN date::VARCHAR END AS COLLISION_DATE,
      CASE WHEN event_id%31=0 THEN 'x' ELSE severity::VARCHAR END AS COLLISION_SEVERITY,
      CASE WHEN event_id%37<>0 THEN printf('%.5f',lon) END AS POINT_X, CASE WHEN event_id%37<>0 THEN printf('%.5f',lat) END AS POINT_Y,
      CASE WHEN event_id%2=0 THEN printf('%.5f',lat) END AS LATITUDE, CASE WHEN event_id%2=0 THEN printf('%.5f',lon) END AS LONGITUDE,
      state_hwy AS STATE_HWY_IND, ped AS PEDESTRIAN_ACCIDENT, bike AS BICYCLE_ACCIDENT, collision AS TYPE_OF_COLLISION, lighting AS LIGHTING,
      alcohol AS ALCOHOL_INVOLVED, pcf AS PCF_VIOL_CATEGORY FROM ev"""),
    "parties": ((), "SELECT l_orderkey::VARCHAR AS CASE_ID, chr((l_linenumber+64)::INT) AS MOVE_PRE_ACC FROM lineitem"),
    "snapped": (("ev", "sites"), """SELECT event_id, site_id, sqrt(d2) AS dist FROM (
      SELECT e.event_id, s.site_id, (e.x-s.x)*(e.x-s.x)+(e.y-s.y)*(e.y-s.y) AS d2,
        row_number() OVER (PARTITION BY e.event_id ORDER BY (e.x-s.x)*(e.x-s.x)+(e.y-s.y)*(e.y-s.y), s.site_id) AS rn
      FROM ev e JOIN sites s ON s.x BETWEEN e.x-77 AND e.x+77 AND s.y BETWEEN e.y-77 AND e.y+77
      WHERE (e.x-s.x)*(e.x-s.x)+(e.y-s.y)*(e.y-s.y) <= 76.2*76.2) WHERE rn=1"""),
    "se": (("ev", "snapped"), "SELECT ev.*, site_id, dist FROM ev JOIN snapped USING (event_id)"),
    "surface": (("sites",), "SELECT * FROM sites WHERE is_surface"),
    "ssnap": (("ev", "surface"), """SELECT event_id, site_id, sqrt(d2) AS dist FROM (
      SELECT e.event_id, s.site_id, (e.x-s.x)*(e.x-s.x)+(e.y-s.y)*(e.y-s.y) AS d2,
        row_number() OVER (PARTITION BY e.event_id ORDER BY (e.x-s.x)*(e.x-s.x)+(e.y-s.y)*(e.y-s.y), s.site_id) AS rn
      FROM ev e JOIN surface s ON s.x BETWEEN e.x-77 AND e.x+77 AND s.y BETWEEN e.y-77 AND e.y+77
      WHERE (e.x-s.x)*(e.x-s.x)+(e.y-s.y)*(e.y-s.y) <= 76.2*76.2) WHERE rn=1"""),
    "sse": (("ev", "ssnap"), "SELECT ev.*, site_id, dist FROM ev JOIN ssnap USING (event_id)"),
    "panel": (("sse", "surface"), """SELECT s.*, coalesce(KSI_feat,0) AS KSI_feat, coalesce(KSI_label,0) AS KSI_label,
      coalesce(crashes_feat,0) AS crashes_feat FROM surface s LEFT JOIN (
      SELECT site_id, count(*) FILTER (date BETWEEN '1995-01-01' AND '1999-12-31' AND severity<=2) AS KSI_feat,
        count(*) FILTER (date BETWEEN '2000-01-01' AND '2001-08-01' AND severity<=2) AS KSI_label,
        count(*) FILTER (date BETWEEN '1995-01-01' AND '1999-12-31') AS crashes_feat FROM sse GROUP BY 1) USING (site_id)"""),
    "cand": (("panel",), "SELECT *, (KSI_label>=1)::INT AS y_ge1, (KSI_label>=2)::INT AS y_ge2, (KSI_label>=2)::INT AS y_primary FROM panel WHERE crashes_feat<5"),
    "road_nodes": ((), f"""SELECT o_orderkey*2 AS node, {h_sql('ex','o_orderkey')}::DOUBLE AS x, {h_sql('ey','o_orderkey')}::DOUBLE AS y FROM orders
      UNION ALL SELECT p_partkey*2+1, {h_sql('px','p_partkey')}::DOUBLE, {h_sql('py','p_partkey')}::DOUBLE FROM part"""),
    "road_edges": ((), f"""SELECT l_orderkey*2 AS src, l_partkey*2+1 AS dst, CASE WHEN q%9=0 THEN [{_HW},{_HW2}] ELSE [{_HW}] END AS highway,
      CASE WHEN q%7=0 THEN NULL WHEN q%7=1 THEN '2|1' WHEN q%7=2 THEN 'unknown' ELSE (q%7)::VARCHAR END AS lanes,
      CASE WHEN q%5=0 THEN NULL WHEN q%5=1 THEN (q%4*10+25)||' mph' WHEN q%5=2 THEN (q%4*10+40)||' km/h' WHEN q%5=3 THEN 'signals' ELSE (q+20)::VARCHAR END AS maxspeed,
      CASE WHEN t=0 THEN []::VARCHAR[] WHEN t=1 THEN [{_W}||' St',{_W}||' Street'] ELSE [{_W}||' Street'] END AS name,
      CASE WHEN q%11=0 THEN ['alley'] WHEN q%11=1 THEN ['yard'] END AS service
      FROM (SELECT *, l_quantity::INT AS q, trunc(l_tax*100)::INT AS t FROM lineitem)"""),
    "both_edges": (("road_edges",), """SELECT src AS node, dst AS other, highway, lanes, maxspeed, name, service FROM road_edges
      UNION ALL SELECT dst, src, highway, lanes, maxspeed, name, service FROM road_edges"""),
    "region_edges": ((), """SELECT poly, x+ox AS x1, y+oy AS y1, lead(x+ox,1,fx+ox) OVER w AS x2, lead(y+oy,1,fy+oy) OVER w AS y2 FROM (
      SELECT n_nationkey::BIGINT AS poly, (n_nationkey%5)*2000.0::DOUBLE AS ox, (n_nationkey//5)*2000.0::DOUBLE AS oy, v.seq, v.x::DOUBLE AS x, v.y::DOUBLE AS y,
        v.fx::DOUBLE AS fx, v.fy::DOUBLE AS fy
      FROM nation JOIN (VALUES (0,0,0,100,0,100),(0,1,1900,0,0,100),(0,2,2000,1800,0,100),(0,3,200,2000,0,100),
        (1,0,0,0,0,0),(1,1,2000,0,0,0),(1,2,2000,1000,0,0),(1,3,1000,1000,0,0),(1,4,1000,2000,0,0),(1,5,0,2000,0,0)) v(kind,seq,x,y,fx,fy)
      ON v.kind=n_nationkey%2) WINDOW w AS (PARTITION BY poly ORDER BY seq)"""),
    "site_poly": (("sites", "region_edges"), """SELECT s.site_id, coalesce(min(p.poly),-1) AS poly FROM sites s LEFT JOIN (
      SELECT site_id, poly FROM sites s JOIN region_edges e ON ((e.y1>s.y)<>(e.y2>s.y)) AND s.x < (e.x2-e.x1)*(s.y-e.y1)/(e.y2-e.y1)+e.x1
      GROUP BY 1,2 HAVING count(*)%2=1) p USING (site_id) GROUP BY 1"""),
    "places": ((), f"""SELECT s_suppkey AS place_id, s_name AS place_name, {h_sql('px','s_suppkey')}::DOUBLE AS x, {h_sql('py','s_suppkey')}::DOUBLE AS y,
      ['school','kindergarten','college','university'][(s_suppkey%4+1)::INT] AS amenity FROM supplier"""),
    "controls": ((), f"""SELECT p_partkey AS control_id, {h_sql('cx','p_partkey')}::DOUBLE AS x, {h_sql('cy','p_partkey')}::DOUBLE AS y,
      ['traffic_signals','stop','give_way'][(p_size%3+1)::INT] AS kind, p_size%2=0 AS all_way FROM part"""),
    "counts_text": ((), f"""SELECT CASE WHEN o_orderkey%12=0 THEN {_CA} WHEN o_orderkey%12=1 THEN {_CA}||' at '||{_CB} ELSE {_CA}||' btwn '||{_CB}||' _ '||{_CC} END AS location,
      CASE WHEN o_orderkey%14=0 THEN 'n/a' ELSE floor(o_totalprice)::BIGINT||'.0' END AS adt_total, o_orderdate::DATE::VARCHAR AS date,
      CASE WHEN o_orderkey%9<>0 THEN printf('%.5f',{h_sql('ey','o_orderkey')}*0.00001::DOUBLE+32.7::DOUBLE) END AS lat,
      CASE WHEN o_orderkey%9<>0 THEN printf('%.5f',{h_sql('ex','o_orderkey')}*0.00001::DOUBLE-117.2::DOUBLE) END AS lng FROM orders"""),
    "reports_text": ((), f"""SELECT o_orderkey::VARCHAR AS report_id, o_orderdate::DATE||' 08:00:00' AS date_time,
      CASE WHEN o_orderkey%2=0 THEN {_RR} ELSE {_RC} END AS road1, CASE WHEN o_orderkey%2=0 THEN 'ST' ELSE 'AVENUE' END AS sfx1,
      CASE WHEN o_orderkey%6<>0 THEN CASE WHEN o_orderkey%2=0 THEN {_RC} ELSE {_RR} END END AS road2, CASE WHEN o_orderkey%2=0 THEN 'AV' ELSE 'STREET' END AS sfx2,
      CASE WHEN o_orderkey%15=0 THEN '' ELSE (o_orderkey%4)::VARCHAR END AS injured, CASE WHEN o_orderkey%50=0 THEN '1' ELSE '0' END AS killed FROM orders"""),
    "visits": ((), """SELECT l_suppkey AS facility_id, l_shipdate::DATE AS date, CASE WHEN l_returnflag='R' THEN 'reinspection' WHEN l_returnflag='A' THEN 'routine'
      WHEN l_linenumber=7 THEN 'complaint' END AS type, CASE WHEN l_linenumber<>6 THEN (100-l_quantity)::INT END AS score, (l_linenumber%3)::INT AS major,
      (l_linenumber%4)::INT AS minor, l_discount>=0.1 AS closed, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem"""),
    "violations": ((), f"""SELECT l_suppkey AS facility_id, l_shipdate::DATE AS date, {_pick_sql(THEME_CYCLE, 'l_partkey%12')} AS theme,
      CASE WHEN l_tax>=0.05 THEN 'major' ELSE 'minor' END AS severity FROM lineitem"""),
    "pixels": ((), "SELECT p_partkey//50 AS row, p_partkey%50 AS col, p_size*1.0::DOUBLE+p_retailprice/100 AS elev FROM part"),
    "paths": ((), f"""SELECT DISTINCT l_orderkey AS path_id, l_linenumber*100000000+l_partkey AS seq,
      ({h_sql('ex','l_orderkey')}+{h_sql('vx','l_partkey')}%300)::DOUBLE AS x, ({h_sql('ey','l_orderkey')}+{h_sql('vy','l_partkey')}%300)::DOUBLE AS y FROM lineitem"""),
    "scored": (("sites",), f"""SELECT *, round(({bits_sql('sa','site_id')}%500)/1000.0::DOUBLE+CASE WHEN label>0 THEN 0.25 ELSE 0 END,3)::DOUBLE AS score_a,
      ({bits_sql('sb','site_id')}%1000)/1000.0::DOUBLE AS score_b, (label>=1)::INT AS hit FROM (SELECT *, (CASE WHEN {bits_sql('ya','site_id')}%10=0
      THEN {bits_sql('yb','site_id')}%3+1 ELSE 0 END)::INT AS label FROM sites)"""),
}


def sql(views: str, body: str, ctes: str = "") -> str:
    """WITH the named views and what they need, then ``ctes``, then the body."""
    order: list[str] = []

    def need(v: str) -> None:
        for d in VIEW_SQL[v][0]:
            need(d)
        if v not in order:
            order.append(v)

    for v in views.split():
        need(v)
    parts = [f"{v} AS MATERIALIZED ({VIEW_SQL[v][1]})" for v in order]
    if ctes:
        parts.append(ctes)
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
