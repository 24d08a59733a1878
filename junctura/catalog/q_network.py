"""Road network, names, raster and path queries."""

from pyspark.sql import functions as F

from junctura.catalog import query, views as V
from junctura.catalog.views import sql
from junctura.functions import text as T
from junctura.operators import polygons as PG
from junctura.plans import infra as I, names as N
from junctura.session import dealt

_CLS = "CASE h WHEN 'motorway' THEN 1 WHEN 'trunk' THEN 2 WHEN 'primary' THEN 3 WHEN 'primary_link' THEN 3 WHEN 'secondary' THEN 4 WHEN 'tertiary' THEN 5 WHEN 'residential' THEN 6 WHEN 'unclassified' THEN 6 WHEN 'living_street' THEN 7 END"
_LANES = "CASE WHEN lanes='2|1' THEN 1.5::DOUBLE ELSE try_cast(lanes AS DOUBLE) END"
_SPEED = "CASE WHEN maxspeed LIKE '% mph' THEN try_cast(replace(maxspeed,' mph','') AS DOUBLE)*1.60934::DOUBLE WHEN maxspeed LIKE '% km/h' THEN try_cast(replace(maxspeed,' km/h','') AS DOUBLE) ELSE try_cast(maxspeed AS DOUBLE) END"
_ATTR = f"""attr AS (SELECT node, count(DISTINCT other) AS edge_count, avg({_LANES}) AS lane_count, coalesce(stddev_pop({_LANES}),0) AS asym, avg({_SPEED}) AS speed,
  coalesce(min((SELECT min({_CLS}) FROM unnest(highway) t(h))),6)::INT AS functional_class, max((list_contains(highway,'motorway') OR list_contains(highway,'motorway_link'))::INT) AS near_freeway FROM both_edges GROUP BY 1)"""
_ATTR_OUT = """edge_count, round(lane_count+1e-9,6) AS lane_count, round(asym+1e-9,6) AS approach_asymmetry, round(speed+1e-9,6) AS speed_limit, functional_class, near_freeway, (lane_count IS NULL)::INT AS lane_count_missing,
  CASE WHEN edge_count<=1 THEN 0 WHEN edge_count<=4 THEN edge_count ELSE 5 END::INT AS intersection_type"""


def _r(df):
    # The nudge settles exact halves of the last digit the same way in both engines.
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("lane_count", "approach_asymmetry", "speed_limit")})


@query("a10_node_road_attributes", sql("both_edges", f"SELECT node, {_ATTR_OUT} FROM attr", _ATTR))
def _(s, d):
    return _r(I.node_attributes(V.road_edges(s, d)))


@query("a11_node_classes", sql("both_edges", """SELECT node, fw AS is_freeway, tr AND NOT fw AS is_trunk, NOT fw AS is_surface FROM (SELECT node, bool_or(list_has_any(highway,['motorway','motorway_link'])) AS fw,
  bool_or(list_has_any(highway,['trunk','trunk_link'])) AS tr FROM both_edges GROUP BY 1)"""))
def _(s, d):
    return I.node_classes(V.road_edges(s, d))


@query("j8_geometry_at_nearest_node", sql("both_edges road_nodes sites", f"""SELECT site_id, n.node, {_ATTR_OUT} FROM (SELECT site_id, node FROM (SELECT a.site_id, b.node, row_number() OVER (PARTITION BY a.site_id
  ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.node) AS rn FROM sites a LEFT JOIN road_nodes b ON abs(a.x-b.x)<=60 AND abs(a.y-b.y)<=60 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=3600) WHERE rn=1) n LEFT JOIN attr ON attr.node=n.node""", _ATTR))
def _(s, d):
    g = I.geometry_features(V.sites(s, d).select("site_id", "x", "y"), V.road_nodes(s, d), V.road_edges(s, d), 60.0)
    return _r(g)


@query("j7_speed_from_dated_ways", sql("controls sites", """SELECT site_id, coalesce(k,cur)::DOUBLE AS speed_limit, 0 AS speed_limit_vintage, (coalesce(k,cur) IS NULL)::INT AS speed_limit_missing FROM (
  SELECT a.site_id, (b.control_id%30+30)::DOUBLE AS k, CASE WHEN a.site_id%3=0 THEN 40 END::DOUBLE AS cur, row_number() OVER (PARTITION BY a.site_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.control_id) AS rn
  FROM sites a LEFT JOIN controls b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=2500) WHERE rn=1"""))
def _(s, d):
    t = V.sites(s, d).select("site_id", "x", "y")
    ways = V.control_nodes(s, d).select(F.col("control_id").alias("way_id"), "x", "y", (F.col("control_id") % 30 + 30).cast("double").alias("way_kph"))
    cur = t.select("site_id", F.when(F.col("site_id") % 3 == 0, 40.0).alias("speed_limit"))
    return I.speed_features(t, ways, cur)


@query("s21_u5_way_edges", sql("", """WITH w AS (SELECT l_orderkey AS way_id, l_partkey AS ref, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem))
  SELECT way_id, src, dst, count(*) AS n FROM (SELECT way_id, ref AS src, nxt AS dst FROM w WHERE nxt IS NOT NULL UNION ALL SELECT way_id, nxt, ref FROM w WHERE nxt IS NOT NULL) GROUP BY ALL"""))
def _(s, d):
    # dealt by way once: rows, ways and edges are then grouped where they lie
    li = dealt(V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").distinct()
    ways = li.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda r: r["l_partkey"]).alias("refs"))
    return I.way_edges(ways, []).groupBy("way_id", "src", "dst").agg(F.count("*").alias("n"))


_INC = """inc AS MATERIALIZED (SELECT node, (SELECT n FROM unnest(name) t(n) ORDER BY length(n) DESC, n DESC LIMIT 1) AS nm, CASE WHEN service[1]='alley' THEN 'alley' ELSE CASE highway[1] WHEN 'service' THEN 'service road' WHEN 'residential' THEN 'unnamed street'
  WHEN 'living_street' THEN 'unnamed street' WHEN 'primary_link' THEN 'connector road' ELSE 'unnamed road' END END AS descr FROM both_edges)"""


@query("a35_street_name_frequency", sql("both_edges", "SELECT nm AS name, count(DISTINCT node) AS n_nodes, count(DISTINCT node)>30 AS generic FROM inc WHERE nm IS NOT NULL GROUP BY 1", _INC))
def _(s, d):
    return N.name_frequency(N.incident_names(V.road_edges(s, d))).withColumn("generic", F.col("n_nodes") > 30)


_LAB = """SELECT site_id, CASE WHEN k>=2 THEN list_sort(nms[1:2])[1]||' & '||list_sort(nms[1:2])[2] WHEN k=1 AND w IS NOT NULL THEN nms[1]||' & '||w WHEN k=1 THEN nms[1] ELSE 'Node '||site_id END AS label,
  CASE WHEN k>=2 THEN 'cross' WHEN k=1 AND w IS NOT NULL THEN 'unnamed_cross' WHEN k=1 THEN 'single' ELSE 'fallback' END AS method FROM (SELECT m.site_id, coalesce(len(nms),0) AS k, nms, w FROM (SELECT DISTINCT site_id FROM mem) m
  LEFT JOIN (SELECT site_id, list(nm ORDER BY length(nm) DESC, nm) AS nms FROM (SELECT DISTINCT site_id, nm FROM mem JOIN inc2 USING (node) WHERE nm IS NOT NULL) GROUP BY 1) USING (site_id)
  LEFT JOIN (SELECT site_id, arg_min(descr, (-c, descr)) AS w FROM (SELECT site_id, descr, count(*) AS c FROM mem JOIN inc2 USING (node) WHERE nm IS NULL GROUP BY 1,2) GROUP BY 1) USING (site_id))"""


@query("a36_f7_f8_intersection_labels", sql("both_edges", _LAB, _INC + """, inc2 AS (SELECT node, CASE WHEN nm IN (SELECT nm FROM inc WHERE nm IS NOT NULL GROUP BY 1 HAVING count(DISTINCT node)>95) THEN NULL ELSE nm END AS nm, descr FROM inc),
  mem AS (SELECT o_orderkey//2 AS site_id, o_orderkey*2 AS node FROM orders)"""))
def _(s, d):
    mem = V.table(s, d, "orders").select(F.floor(F.col("o_orderkey") / 2).alias("site_id"), (F.col("o_orderkey") * 2).alias("node"))
    return N.label_sites(mem, V.road_edges(s, d), limit=95)


@query("j32_relabel_points", sql("both_edges road_nodes sites", """SELECT s.site_id, CASE WHEN node IS NULL THEN 'no_match' WHEN l.k IS NULL OR l.k=0 THEN 'no_names' ELSE 'ok' END AS status, round(dist,1) AS nearest_m, CASE WHEN l.k>0 THEN mm END AS members FROM (
  SELECT a.site_id, b.node, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist, row_number() OVER (PARTITION BY a.site_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.node) AS rn
  FROM sites a LEFT JOIN road_nodes b ON abs(a.x-b.x)<=60 AND abs(a.y-b.y)<=60 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=3600) s
  LEFT JOIN (SELECT h.node AS hub, count(DISTINCT nm) AS k, count(DISTINCT m.node) AS mm FROM road_nodes h JOIN road_nodes m ON abs(h.x-m.x)<=40 AND abs(h.y-m.y)<=40 AND (h.x-m.x)*(h.x-m.x)+(h.y-m.y)*(h.y-m.y)<=1600
    LEFT JOIN inc ON inc.node=m.node GROUP BY 1) l ON l.hub=s.node WHERE rn=1""", _INC))
def _(s, d):
    nodes = V.road_nodes(s, d).withColumn("nx", F.col("x")).withColumn("ny", F.col("y"))
    r = N.relabel_points(V.sites(s, d).select("site_id", "x", "y"), nodes, V.road_edges(s, d), 60.0, 40.0)
    return r.select("site_id", "status", "nearest_m", "members")


@query("f9_variant_collapse", sql("both_edges", """SELECT node AS site_id, road, arg_max(n, (length(n), n)) AS name FROM (SELECT node, n, regexp_replace(regexp_replace(regexp_replace(lower(n),'\\b(north|south|east|west|n|s|e|w|ne|nw|se|sw)\\b',' ','g'),'\\bstreet\\b','st','g'),'[^a-z0-9]','','g') AS road
  FROM (SELECT node, unnest(name) AS n FROM both_edges)) GROUP BY 1,2"""))
def _(s, d):
    n = I.both_ways(V.road_edges(s, d)).select(F.col("node").alias("site_id"), F.explode("name").alias("name"))
    return N.collapse_variants(n)


_VK = lambda c: f"regexp_replace(regexp_replace(regexp_replace(lower({c}),'\\b(north|south|east|west|n|s|e|w|ne|nw|se|sw)\\b',' ','g'),'\\bstreet\\b','st','g'),'[^a-z0-9]','','g')"


@query("f9_same_road", sql("road_edges sites", f"""SELECT a, b, {_VK('a')}<>'' AND {_VK('b')}<>'' AND (contains({_VK('a')},{_VK('b')}) OR contains({_VK('b')},{_VK('a')})) AS same, count(*) AS n FROM (
  SELECT name[1] AS a, name[2] AS b FROM road_edges WHERE len(name)=2 UNION ALL SELECT split_part(name,' & ',1), split_part(name,' & ',2) FROM sites WHERE name LIKE '% & %') GROUP BY ALL"""))
def _(s, d):
    """Two spellings on one road, and the two streets of a corner."""
    e = V.road_edges(s, d).where(F.size("name") == 2).select(F.get("name", F.lit(0)).alias("a"), F.get("name", F.lit(1)).alias("b"))
    p = F.split("name", " & ")
    c = V.sites(s, d).where(F.col("name").contains(" & ")).select(F.get(p, F.lit(0)).alias("a"), F.get(p, F.lit(1)).alias("b"))
    return e.unionByName(c).groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("same", T.same_road(F.col("a"), F.col("b")))


@query("f5_f6_tag_numbers", sql("road_edges", f"SELECT lanes, maxspeed, round({_LANES},6) AS lanes_n, round({_SPEED},6) AS kph, count(*) AS n FROM road_edges GROUP BY ALL"))
def _(s, d):
    return V.road_edges(s, d).groupBy("lanes", "maxspeed").agg(F.count("*").alias("n")).select(
        "lanes", "maxspeed", F.round(T.lanes_number(F.col("lanes")), 6).alias("lanes_n"), F.round(T.speed_kph(F.col("maxspeed")), 6).alias("kph"), "n")


@query("w11_raster_slope", sql("pixels", """SELECT c.row, c.col, round(c.elev,6) AS elev, round(sqrt(pow((coalesce(e.elev,c.elev)-coalesce(w.elev,c.elev))/20.0::DOUBLE,2)+pow((coalesce(s.elev,c.elev)-coalesce(n.elev,c.elev))/20.0::DOUBLE,2))*100,6) AS slope_pct
  FROM pixels c LEFT JOIN pixels e ON e.row=c.row AND e.col=c.col+1 LEFT JOIN pixels w ON w.row=c.row AND w.col=c.col-1 LEFT JOIN pixels s ON s.row=c.row+1 AND s.col=c.col LEFT JOIN pixels n ON n.row=c.row-1 AND n.col=c.col"""))
def _(s, d):
    return I.slope_from_raster(V.pixels(s, d), 10.0).select("row", "col", F.round("elev", 6).alias("elev"), F.round("slope_pct", 6).alias("slope_pct"))


@query("s19_raster_at_sites", sql("pixels sites", """SELECT site_id, round(c.elev,6) AS elev, round(sqrt(pow((coalesce(e.elev,c.elev)-coalesce(w.elev,c.elev))/400.0::DOUBLE,2)+pow((coalesce(s.elev,c.elev)-coalesce(n.elev,c.elev))/400.0::DOUBLE,2))*100,6) AS slope_pct,
  (c.elev IS NULL)::INT AS slope_pct_missing FROM (SELECT site_id, floor((10007-y)/200)::BIGINT AS rw, floor(x/200)::BIGINT AS cl FROM sites) t LEFT JOIN pixels c ON c.row=rw AND c.col=cl
  LEFT JOIN pixels e ON e.row=c.row AND e.col=c.col+1 LEFT JOIN pixels w ON w.row=c.row AND w.col=c.col-1 LEFT JOIN pixels s ON s.row=c.row+1 AND s.col=c.col LEFT JOIN pixels n ON n.row=c.row-1 AND n.col=c.col"""))
def _(s, d):
    r = I.sample_raster(V.sites(s, d), I.slope_from_raster(V.pixels(s, d), 200.0), 0.0, 10007.0, 200.0)
    return r.withColumns({"elev": F.round("elev", 6), "slope_pct": F.round("slope_pct", 6)})


_SEG = """seg AS (SELECT path_id, seq, x, y, nx, ny, sqrt(pow(nx-x,2)+pow(ny-y,2)) AS step, coalesce(sum(sqrt(pow(nx-x,2)+pow(ny-y,2))) OVER (PARTITION BY path_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS cum FROM (
  SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM paths WINDOW w AS (PARTITION BY path_id ORDER BY seq)))"""


@query("w13_cumulative_length", sql("paths", "SELECT path_id, seq, round(cum,4) AS cum FROM seg", _SEG))
def _(s, d):
    return I.path_lengths(V.paths(s, d)).select("path_id", "seq", F.round("cum", 4).alias("cum"))


@query("w12_path_midpoints", sql("paths", """SELECT path_id, round(x+t*(nx-x),4) AS x, round(y+t*(ny-y),4) AS y FROM (SELECT s.*, coalesce((half-cum)/nullif(step,0),0) AS t, row_number() OVER (PARTITION BY path_id ORDER BY seq) AS rn
  FROM seg s JOIN (SELECT path_id, sum(coalesce(step,0))/2 AS half FROM seg GROUP BY 1) USING (path_id) WHERE step IS NOT NULL AND cum<=half AND half<=cum+step) WHERE rn=1""", _SEG))
def _(s, d):
    return I.path_midpoints(V.paths(s, d)).select("path_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("j27_sites_along_paths", sql("paths sites", """SELECT path_id, site_id, round(sqrt(d2),4) AS meters, round(along,4) AS along_m FROM (SELECT path_id, site_id, d2, cum+t*step AS along, row_number() OVER (PARTITION BY path_id, site_id ORDER BY d2, seq) AS rn FROM (
  SELECT *, pow(sx-(x+t*(nx-x)),2)+pow(sy-(y+t*(ny-y)),2) AS d2 FROM (SELECT g.*, s.site_id, s.x AS sx, s.y AS sy, greatest(0,least(1,coalesce(((s.x-g.x)*(nx-g.x)+(s.y-g.y)*(ny-g.y))/nullif(pow(nx-g.x,2)+pow(ny-g.y,2),0),0))) AS t
  FROM seg g JOIN sites s ON s.x BETWEEN least(g.x,nx)-35 AND greatest(g.x,nx)+35 AND s.y BETWEEN least(g.y,ny)-35 AND greatest(g.y,ny)+35 WHERE step IS NOT NULL)) WHERE d2<=1225) WHERE rn=1""", _SEG))
def _(s, d):
    a = I.sites_along(V.paths(s, d), V.sites(s, d), 35.0)
    return a.select("path_id", "site_id", F.round("meters", 4).alias("meters"), F.round("along_m", 4).alias("along_m"))


@query("s17_tract_shares", sql("sites site_poly", """SELECT site_id, round(pd,6) AS pop_density, round(inc,6) AS median_hh_income, round(nv,6) AS pct_no_vehicle FROM sites LEFT JOIN site_poly USING (site_id) LEFT JOIN (
  SELECT c_nationkey AS poly, sum(c_acctbal)/4.0 AS pd, avg(c_acctbal) AS inc, CASE WHEN count(*) FILTER (c_mktsegment<>'MACHINERY')>0 THEN count(*) FILTER (c_mktsegment='BUILDING')/(count(*) FILTER (c_mktsegment<>'MACHINERY'))::DOUBLE*100 END AS nv FROM customer GROUP BY 1) USING (poly)"""))
def _(s, d):
    seg = F.col("c_mktsegment")
    tr = V.table(s, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("tract")).agg(
        F.sum("c_acctbal").alias("pop_total"), F.avg("c_acctbal").alias("median_hh_income"), F.lit(4.0).alias("area_sqkm"),
        F.count_if(seg == "BUILDING").alias("hh_no_vehicle"), F.count_if(seg != "MACHINERY").alias("hh_total"),
        *[F.lit(0).alias(c) for c in ("pop_below_poverty", "pop_poverty_total", "pop_nonwhite", "pop_race_total")])
    t = I.tract_attributes(tr)
    p = PG.containing(V.sites(s, d).select("site_id", "x", "y"), PG.edges_from_vertices(V.regions(s, d)), 1000.0)
    return p.join(t, p["poly"] == t["tract"], "left").select(
        "site_id", *[F.round(c, 6).alias(c) for c in ("pop_density", "median_hh_income", "pct_no_vehicle")])


@query("a14_imputed_exposure", sql("sites ev", """SELECT site_id, round(aadt,6) AS aadt, missing AS aadt_missing, round(ln(1+aadt),6) AS log_aadt FROM (SELECT site_id, missing, coalesce(a, median(a) OVER ()) AS aadt FROM (
  SELECT site_id, missing, coalesce(v, median(v) OVER (PARTITION BY nation)) AS a FROM (SELECT s.site_id, s.nation, t AS v, (t IS NULL)::INT AS missing FROM sites s LEFT JOIN (
   SELECT a.site_id, max(b.event_id%5000)::DOUBLE AS t FROM sites a JOIN ev b ON b.x BETWEEN a.x-60 AND a.x+60 AND b.y BETWEEN a.y-60 AND a.y+60 WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=3600 GROUP BY 1) USING (site_id))))"""))
def _(s, d):
    ev = V.events(s, d).withColumn("total", F.col("event_id") % 5000)
    t = I.traffic_exposure(V.sites(s, d), ev, 60.0, group="nation")
    return t.select("site_id", F.round("aadt", 6).alias("aadt"), "aadt_missing", F.round("log_aadt", 6).alias("log_aadt"))
