"""Distance joins, polygons, components (J and P rows)."""

from pyspark.sql import functions as F

from junctura.catalog import query, views as V
from junctura.catalog.views import sql
from junctura.functions import geo as G
from junctura.operators import components as C, folds, polygons as P, proximity as X
from junctura.session import attach, stage

D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)"


@query("j1_nearest_within_buffer", sql("snapped", "SELECT event_id, site_id, round(dist,6) AS dist FROM snapped"))
def _(s, d):
    return X.nearest_within(V.events(s, d).select("event_id", "x", "y"), V.sites(s, d), 76.2).select(
        "event_id", "site_id", F.round("dist", 6).alias("dist"))


@query("j1_nearest_refined_grid", sql("snapped", "SELECT event_id, site_id, round(dist,6) AS dist FROM snapped"))
def _(s, d):
    """The same join through the dense-area path, whatever the density."""
    return X.nearest_within(V.events(s, d).select("event_id", "x", "y"), V.sites(s, d), 76.2, levels=2).select(
        "event_id", "site_id", F.round("dist", 6).alias("dist"))


@query("j2_all_within_buffer", sql("ev sites", f"SELECT a.event_id, b.site_id FROM ev a JOIN sites b ON abs(a.x-b.x)<=77 AND abs(a.y-b.y)<=77 WHERE {D2}<=76.2*76.2"))
def _(s, d):
    return X.pairs_within(V.events(s, d).select("event_id", "x", "y"), V.sites(s, d), 76.2, place_cols=["site_id"]).select("event_id", "site_id")


_NEAR = lambda r, extra="": f"(SELECT count(*) FROM feat b WHERE b.x BETWEEN a.x-{r} AND a.x+{r} AND b.y BETWEEN a.y-{r} AND a.y+{r} AND {D2}<={r}*{r}{extra})"


@query("j3_radius_counts", sql("sites ev sse", """SELECT a.site_id, coalesce(n150,0) AS nbr_crashes_150m, coalesce(n400,0) AS nbr_crashes_400m,
  coalesce(k400,0) AS nbr_ksi_400m, m-1 AS node_density_400m, coalesce(hs,0) AS n_hotspots_400m FROM sites a
  LEFT JOIN (SELECT a.site_id, count(*) FILTER (d2<=150*150) AS n150, count(*) AS n400, count(*) FILTER (severity<=2) AS k400 FROM
    (SELECT a.site_id, b.severity, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM sites a JOIN feat b ON b.x BETWEEN a.x-400 AND a.x+400 AND b.y BETWEEN a.y-400 AND a.y+400) a
    WHERE d2<=400*400 GROUP BY 1) USING (site_id)
  LEFT JOIN (SELECT a.site_id, count(*) AS m, count(*) FILTER (b.hot) AS hs FROM sites a JOIN hots b ON b.x BETWEEN a.x-400 AND a.x+400 AND b.y BETWEEN a.y-400 AND a.y+400
    WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=400*400 GROUP BY 1) USING (site_id)""",
    """feat AS (SELECT * FROM ev WHERE date BETWEEN '1995-01-01' AND '1999-12-31' AND state_hwy IS DISTINCT FROM 'Y'),
  hots AS (SELECT s.*, s.site_id IN (SELECT site_id FROM sse GROUP BY 1 HAVING count(*)>=5) AS hot FROM sites s)"""))
def _(s, d):
    from junctura.plans.panel import snap, surface_only
    ev = V.events(s, d)
    sites = V.sites(s, d)
    feat = ev.where("date BETWEEN DATE'1995-01-01' AND DATE'1999-12-31' AND NOT (state_hwy <=> 'Y')")
    hot = snap(ev.select("event_id", "x", "y"), surface_only(sites), 76.2).groupBy("site_id").count().where("count >= 5")
    marked = sites.join(hot.select("site_id", F.lit(1).alias("hot")), "site_id", "left")
    near = X.radius_totals(sites, feat, 400.0, cid="site_id", radii={"nbr_crashes_150m": 150.0}, sums={
        "nbr_crashes_150m": F.lit(1), "nbr_crashes_400m": F.lit(1), "nbr_ksi_400m": (F.col("severity") <= 2).cast("int")})
    around = X.radius_totals(sites, marked, 400.0, cid="site_id", sums={"m": F.lit(1), "n_hotspots_400m": F.coalesce("hot", F.lit(0))})
    x = sites.select("site_id").join(near, "site_id", "left").join(around, "site_id", "left").fillna(0)
    return x.withColumn("node_density_400m", F.col("m") - 1).drop("m")


@query("j4_nearest_hotspot_capped", sql("sites sse", f"""SELECT a.site_id, round(least(2000, min(sqrt({D2}))),6) AS dist_nearest_hotspot_m
  FROM sites a CROSS JOIN hots b GROUP BY 1""", "hots AS (SELECT * FROM sites WHERE site_id IN (SELECT site_id FROM sse GROUP BY 1 HAVING count(*)>=5))"))
def _(s, d):
    from junctura.plans.panel import snap, surface_only
    sites = V.sites(s, d)
    hot = snap(V.events(s, d).select("event_id", "x", "y"), surface_only(sites), 76.2).groupBy("site_id").count().where("count >= 5")
    hots = sites.join(hot, "site_id", "left_semi").select(F.col("site_id").alias("hot_id"), "x", "y")
    n = X.nearest_within(sites.select("site_id", "x", "y"), hots, 2000.0, pid="site_id", qid="hot_id", how="left")
    return n.select("site_id", F.round(F.coalesce("dist", F.lit(2000.0)), 6).alias("dist_nearest_hotspot_m"))


@query("j5_nearest_any_distance", sql("sites places", f"""SELECT site_id, place_id, round(sqrt(d2),6) AS dist, sqrt(d2)<=400 AS proximate FROM (
  SELECT a.site_id, b.place_id, {D2} AS d2, row_number() OVER (PARTITION BY a.site_id ORDER BY {D2}, b.place_id) AS rn FROM sites a CROSS JOIN places b) WHERE rn=1"""))
def _(s, d):
    n = X.nearest_any(V.sites(s, d).select("site_id", "x", "y"), V.suppliers(s, d), 400.0, pid="site_id", qid="place_id")
    return n.select("site_id", "place_id", F.round("dist", 6).alias("dist"), (F.col("dist") <= 400).alias("proximate"))


@query("j6_within_flags", sql("sites controls places", f"""SELECT site_id, sig AS signal_present, stp AS stop_control, cw AS has_crosswalk, sw AS has_sidewalk, ps AS has_ped_signal, cw+sw+ps AS ped_infra_score FROM (
  SELECT a.site_id, (EXISTS (SELECT 1 FROM controls b WHERE kind='traffic_signals' AND {D2}<=1600))::INT AS sig,
   (EXISTS (SELECT 1 FROM controls b WHERE kind='stop' AND {D2}<=900))::INT AS stp,
   (EXISTS (SELECT 1 FROM controls b WHERE kind='give_way' AND {D2}<=76.2*76.2))::INT AS cw,
   (EXISTS (SELECT 1 FROM places b WHERE {D2}<=76.2*76.2))::INT AS sw,
   (EXISTS (SELECT 1 FROM controls b WHERE kind='traffic_signals' AND {D2}<=76.2*76.2))::INT AS ps FROM sites a)"""))
def _(s, d):
    from junctura.plans.infra import control_features, walking_features
    c = V.control_nodes(s, d)
    sig, stp, cw = (c.where(F.col("kind") == k) for k in ("traffic_signals", "stop", "give_way"))
    x = control_features(V.sites(s, d).select("site_id", "x", "y"), sig, stp)
    return walking_features(x, cw, V.suppliers(s, d), sig, 76.2).drop("x", "y")


@query("j9_radius_max", sql("sites ev", f"""SELECT a.site_id, max(b.event_id%5000) AS top FROM sites a JOIN ev b ON b.x BETWEEN a.x-250 AND a.x+250 AND b.y BETWEEN a.y-250 AND a.y+250
  WHERE {D2}<=62500 GROUP BY 1"""))
def _(s, d):
    return X.radius_totals(V.sites(s, d), V.events(s, d), 250.0, cid="site_id", sums={}, maxima={"top": F.col("event_id") % 5000})


@query("j10_decayed_neighbour_sums", sql("sites se", f"""SELECT a.site_id, round(coalesce(sum(exp(-0.5*({D2})/10000.0::DOUBLE)*b.n),0),6) AS pressure, count(b.site_id) AS n_neighbors
  FROM sites a LEFT JOIN (SELECT s.*, coalesce(n,0) AS n FROM sites s LEFT JOIN (SELECT site_id, count(*) AS n FROM se GROUP BY 1) USING (site_id)) b
  ON a.site_id<>b.site_id AND {D2}<=250*250 GROUP BY 1"""))
def _(s, d):
    from junctura.plans.panel import snap
    sites = V.sites(s, d).select("site_id", "x", "y")
    n = snap(V.events(s, d).select("event_id", "x", "y"), sites, 76.2).groupBy("site_id").agg(F.count("*").alias("n"))
    return X.decayed_sums(sites.join(n, "site_id", "left").fillna(0, ["n"]), 250.0, 100.0, {"pressure": "n"}, sid="site_id").select(
        "site_id", F.round("pressure", 6).alias("pressure"), "n_neighbors")


@query("j11_a12_f12_merge_near_duplicates", sql("sites", """SELECT root AS site_id, round(avg(x),6) AS x, round(avg(y),6) AS y, count(*) AS member_count,
  string_agg(site_id::VARCHAR, ',' ORDER BY site_id) AS members, bool_or(is_freeway) AS is_freeway, bool_or(is_trunk) AND NOT bool_or(is_freeway) AS is_trunk_borderline,
  NOT bool_or(is_freeway) AS is_surface, md5(printf('%.1f',avg(x))||','||printf('%.1f',avg(y))) AS site_key
  FROM sites JOIN (SELECT id, min(r) AS root FROM reach GROUP BY 1) ON id=site_id GROUP BY root""",
  f"""pr AS (SELECT a.site_id AS u, b.site_id AS v FROM sites a JOIN sites b ON abs(a.x-b.x)<=60 AND abs(a.y-b.y)<=60 WHERE {D2}<=60*60),
  reach AS (SELECT site_id AS id, site_id AS r FROM sites UNION SELECT pr.v, reach.r FROM reach JOIN pr ON pr.u=reach.id)"""))
def _(s, d):
    m = C.merge_near_duplicates(V.sites(s, d), 60.0, nid="site_id")
    return m.withColumns({"x": F.round("x", 6), "y": F.round("y", 6), "members": F.array_join("members", ",")})


@query("j12_point_in_polygon", sql("site_poly", "SELECT site_id, poly FROM site_poly"))
def _(s, d):
    e = P.edges_from_vertices(V.regions(s, d))
    return P.containing(V.sites(s, d).select("site_id", "x", "y"), e, 1000.0).select("site_id", "poly")


@query("j13_within_region", sql("site_poly", "SELECT site_id FROM site_poly WHERE poly BETWEEN 0 AND 11"))
def _(s, d):
    e = P.edges_from_vertices(V.regions(s, d).where("poly <= 11"))
    once = P.within_region(V.sites(s, d).select("site_id", "x", "y"), e, 1000.0)
    return P.within_region(once, e, 1000.0).select("site_id")


@query("j13_clip_graph", sql("road_edges road_nodes", """SELECT src, dst, count(*) AS n FROM road_edges WHERE src IN (SELECT node FROM road_nodes WHERE x<5000)
  AND dst IN (SELECT node FROM road_nodes WHERE x<5000) GROUP BY 1,2"""))
def _(s, d):
    kept = V.road_nodes(s, d).where("x < 5000")
    return P.clip_edges(V.road_edges(s, d).select("src", "dst"), kept, "node").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("j34_buffered_region", sql("sites site_poly region_edges", """SELECT DISTINCT s.site_id FROM sites s JOIN site_poly p USING (site_id) WHERE poly >= 0 OR EXISTS (
  SELECT 1 FROM region_edges e WHERE
   pow(s.x-(e.x1+greatest(0,least(1,((s.x-e.x1)*(e.x2-e.x1)+(s.y-e.y1)*(e.y2-e.y1))/(pow(e.x2-e.x1,2)+pow(e.y2-e.y1,2))))*(e.x2-e.x1)),2)
  +pow(s.y-(e.y1+greatest(0,least(1,((s.x-e.x1)*(e.x2-e.x1)+(s.y-e.y1)*(e.y2-e.y1))/(pow(e.x2-e.x1,2)+pow(e.y2-e.y1,2))))*(e.y2-e.y1)),2)<=1000000.0)"""))
def _(s, d):
    e = P.edges_from_vertices(V.regions(s, d))
    return P.within_buffered_region(V.sites(s, d).select("site_id", "x", "y"), e, 1000.0, 1000.0, pid="site_id").select("site_id")


@query("j23_nearest_labelled_place", sql("sites places", f"""SELECT site_id, place_name AS school, amenity AS kind, round(sqrt(d2))::BIGINT AS meters FROM (
  SELECT a.site_id, b.place_name, b.amenity, {D2} AS d2, row_number() OVER (PARTITION BY a.site_id ORDER BY {D2}, b.place_id) AS rn FROM sites a JOIN places b ON {D2}<=90000) WHERE rn=1"""))
def _(s, d):
    n = X.nearest_within(V.sites(s, d).select("site_id", "x", "y"), V.suppliers(s, d), 300.0, pid="site_id", qid="place_id", carry=["place_name", "amenity"])
    return n.select("site_id", F.col("place_name").alias("school"), F.col("amenity").alias("kind"), F.round("dist").cast("bigint").alias("meters"))


@query("j24_control_class", sql("sites controls", f"""SELECT site_id, CASE WHEN sig>0 THEN 'signals' WHEN stp>0 THEN 'stop' WHEN yld>0 THEN 'yield' ELSE 'none' END AS control,
  CASE WHEN sig=0 AND stp>0 THEN alw>0 END AS all_way, n AS nodes FROM (SELECT a.site_id, count(b.control_id) AS n, count(*) FILTER (b.kind='traffic_signals') AS sig,
  count(*) FILTER (b.kind='stop') AS stp, count(*) FILTER (b.kind='stop' AND b.all_way) AS alw, count(*) FILTER (b.kind='give_way') AS yld
  FROM sites a LEFT JOIN controls b ON {D2}<=75*75 GROUP BY 1)"""))
def _(s, d):
    from junctura.plans.infra import control_class
    return control_class(V.sites(s, d).select("site_id", "x", "y"), V.control_nodes(s, d), 75.0)


@query("j25_k_nearest_sites", sql("sites", f"""SELECT site_id, other, round(sqrt(d2),6) AS dist, rn::INT AS pos FROM (SELECT a.site_id, b.site_id AS other, {D2} AS d2,
  row_number() OVER (PARTITION BY a.site_id ORDER BY {D2}, b.site_id) AS rn FROM sites a JOIN sites b ON a.site_id<>b.site_id AND {D2}<=640000) WHERE rn<=3"""))
def _(s, d):
    k = X.k_nearest(V.sites(s, d).select("site_id", "x", "y"), 800.0, 3, pid="site_id")
    return k.select("site_id", F.col("qid").alias("other"), F.round("dist", 6).alias("dist"), "pos")


@query("j26_twin_pairs", sql("sites", f"SELECT a.site_id AS site_a, b.site_id AS site_b FROM sites a JOIN sites b ON a.site_id<b.site_id AND {D2}<=900"))
def _(s, d):
    a = V.sites(s, d).select(F.col("site_id").alias("site_a"), "x", "y")
    return X.pairs_within(a, V.sites(s, d), 30.0, place_cols=["site_id"]).where("site_a < site_id").select("site_a", F.col("site_id").alias("site_b"))


@query("j28_sites_near_point", sql("sites", """SELECT site_id, round(sqrt(pow((lon- -117.15)*111320*cos(radians(32.75)),2)+pow((lat-32.75)*110540,2)),4) AS meters FROM sites
  WHERE sqrt(pow((lon- -117.15)*111320*cos(radians(32.75)),2)+pow((lat-32.75)*110540,2))<=500"""))
def _(s, d):
    m = G.hypot_m(F.lit(-117.15), F.lit(32.75), F.col("lon"), F.col("lat"))
    return V.sites(s, d).withColumn("meters", m).where("meters <= 500").select("site_id", F.round("meters", 4).alias("meters"))


@query("j22_point_key_join", sql("sites", "SELECT a.site_id, b.site_id AS same_point FROM sites a JOIN sites b ON printf('%.6f,%.6f',a.lat,a.lon)=printf('%.6f,%.6f',b.lat,b.lon)"))
def _(s, d):
    a = V.sites(s, d).select("site_id", G.point_key(F.col("lat"), F.col("lon")).alias("k"))
    return a.join(a.withColumnRenamed("site_id", "same_point"), "k").drop("k")


@query("p17_local_metres", sql("sites", """SELECT site_id, round(6371000.0*cos(radians(lat0))*radians(lon),3) AS mx, round(6371000.0*radians(lat),3) AS my
  FROM sites CROSS JOIN (SELECT avg(lat) AS lat0 FROM sites)"""))
def _(s, d):
    t = V.sites(s, d)
    mean = t.agg(F.avg("lat").alias("lat0"))
    x, y = G.equirect_xy(F.col("lon"), F.col("lat"), F.col("lat0"))
    return attach(t, mean).select("site_id", F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"))


@query("p18_projection_and_zone", sql("sites", """SELECT site_id, CASE WHEN lat>=0 THEN 'EPSG:326' ELSE 'EPSG:327' END||lpad((floor((lon+180)/6)+1)::INT::VARCHAR,2,'0') AS zone,
  round((rho*sin(theta)+2000000)*3937/1200,2) AS east_ft, round((rho0-rho*cos(theta)+500000)*3937/1200,2) AS north_ft FROM (SELECT *, n*radians(lon+116.25) AS theta,
  6378137.0*F*pow(t,n) AS rho, 6378137.0*F*pow(t0,n) AS rho0 FROM (SELECT *, m1/(n*pow(t1,n)) AS F FROM (SELECT *, (ln(m1)-ln(m2))/(ln(t1)-ln(t2)) AS n FROM (SELECT site_id, lon, lat,
  cos(p1)/sqrt(1-e2*pow(sin(p1),2)) AS m1, cos(p2)/sqrt(1-e2*pow(sin(p2),2)) AS m2, tan(pi()/4-p1/2)/pow((1-e*sin(p1))/(1+e*sin(p1)),e/2) AS t1,
  tan(pi()/4-p2/2)/pow((1-e*sin(p2))/(1+e*sin(p2)),e/2) AS t2, tan(pi()/4-p0/2)/pow((1-e*sin(p0))/(1+e*sin(p0)),e/2) AS t0,
  tan(pi()/4-radians(lat)/2)/pow((1-e*sin(radians(lat)))/(1+e*sin(radians(lat))),e/2) AS t FROM sites CROSS JOIN (SELECT radians(32+47/60.0) AS p1, radians(33+53/60.0) AS p2,
  radians(32+10/60.0) AS p0, sqrt((2-1/298.257222101::DOUBLE)/298.257222101::DOUBLE) AS e, (2-1/298.257222101::DOUBLE)/298.257222101::DOUBLE AS e2)))))"""))
def _(s, d):
    e, n = G.lambert_ft(F.col("lon"), F.col("lat"))
    return V.sites(s, d).select("site_id", G.utm_epsg(F.col("lon"), F.col("lat")).alias("zone"), F.round(e, 2).alias("east_ft"), F.round(n, 2).alias("north_ft"))


@query("p19_tile_blocks", sql("sites", "SELECT site_id, (dense_rank() OVER (ORDER BY floor(y/2000), floor(x/2000))-1)::INT AS block FROM sites"))
def _(s, d):
    return folds.tile_blocks(V.sites(s, d), 2000.0).select("site_id", "block")


@query("f11_distances", sql("sites", """SELECT site_id, round(2*6371000.0*asin(sqrt(pow(sin(radians(lat-32.75)/2),2)+cos(radians(32.75))*cos(radians(lat))*pow(sin(radians(lon+117.15)/2),2))),4) AS haversine,
  round(2*3958.8*asin(sqrt(pow(sin(radians(lat-32.75)/2),2)+cos(radians(32.75))*cos(radians(lat))*pow(sin(radians(lon+117.15)/2),2))),6) AS miles,
  round(sqrt(pow((lon+117.15)*111320*cos(radians(32.75)),2)+pow((lat-32.75)*110540,2)),4) AS hypot, round(sqrt((x-5000)*(x-5000)+(y-5000)*(y-5000)),6) AS planar FROM sites"""))
def _(s, d):
    a = (F.lit(-117.15), F.lit(32.75), F.col("lon"), F.col("lat"))
    return V.sites(s, d).select(
        "site_id", F.round(G.haversine_m(*a), 4).alias("haversine"), F.round(G.haversine_miles(*a), 6).alias("miles"),
        F.round(G.hypot_m(*a), 4).alias("hypot"), F.round(F.sqrt(G.planar2(F.col("x"), F.col("y"), F.lit(5000.0), F.lit(5000.0))), 6).alias("planar"))
