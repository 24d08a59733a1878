"""Distances, projections and point keys as column expressions.

Five distance formulas are in use and give different answers; each has its own
name and they are never swapped for one another.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from junctura.config import DEG_LAT_M, DEG_M, EARTH_RADIUS_M


def planar2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared planar distance; comparing squares avoids a square root per pair."""
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column,
                radius: float = EARTH_RADIUS_M) -> Column:
    dphi = F.radians(lat2 - lat1) / 2
    dlam = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dphi), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlam), 2)
    return F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))) * (2 * radius)


def haversine_miles(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return haversine_m(lon1, lat1, lon2, lat2, radius=3958.8)


def hypot_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Flat-earth metres with separate degree lengths, scaled at the first point."""
    dx = (lon2 - lon1) * DEG_M * F.cos(F.radians(lat1))
    dy = (lat2 - lat1) * DEG_LAT_M
    return F.sqrt(dx * dx + dy * dy)


def equirect_xy(lon: Column, lat: Column, lat0: Column) -> tuple[Column, Column]:
    """Local equirectangular metres about ``lat0`` (degrees)."""
    return (F.radians(lon) * F.cos(F.radians(lat0)) * EARTH_RADIUS_M,
            F.radians(lat) * EARTH_RADIUS_M)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone holding the point; null outside the globe."""
    zone = (F.floor((lon + 180) / 6) + 1).cast("int")
    ok = lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(ok, F.format_string("EPSG:%d%02d", F.when(lat >= 0, 326).otherwise(327), zone))


def utm_xy(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Forward transverse Mercator on WGS84 (published series, Snyder 1987,
    eqs. 8-9 to 8-15); southern points get the 10,000 km false northing."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    lam = F.radians(lon - (zone * 6 - 183))
    s, c = F.sin(phi), F.cos(phi)
    n = F.lit(a) / F.sqrt(1 - e2 * s * s)
    t = F.pow(s / c, 2)
    cc = ep2 * c * c
    al = lam * c
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = 0.9996 * n * (al + (1 - t + cc) * F.pow(al, 3) / 6
                      + (5 - 18 * t + t * t + 72 * cc - 58 * ep2) * F.pow(al, 5) / 120) + 500000.0
    y = 0.9996 * (m + n * (s / c) * (al * al / 2 + (5 - t + 9 * cc + 4 * cc * cc) * F.pow(al, 4) / 24
                  + (61 - 58 * t + t * t + 600 * cc - 330 * ep2) * F.pow(al, 6) / 720))
    return x, F.when(lat < 0, y + 10_000_000.0).otherwise(y)


# State Plane California VI (NAD83), US survey feet.
CA6 = dict(lat1=32 + 47 / 60, lat2=33 + 53 / 60, lat0=32 + 10 / 60, lon0=-(116 + 15 / 60),
           fe_m=2_000_000.0, fn_m=500_000.0)


def lambert_ft(lon: Column, lat: Column, zone: dict = CA6) -> tuple[Column, Column]:
    """Forward two-parallel Lambert conformal conic on GRS80 in US survey feet.
    The WGS84 to NAD83 datum shift (about a metre) is ignored."""
    import math

    a, f = 6378137.0, 1 / 298.257222101
    e = math.sqrt(f * (2 - f))

    def m_of(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def t_of(p: float) -> float:
        return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

    p1, p2, p0 = (math.radians(zone[k]) for k in ("lat1", "lat2", "lat0"))
    n = (math.log(m_of(p1)) - math.log(m_of(p2))) / (math.log(t_of(p1)) - math.log(t_of(p2)))
    big_f = m_of(p1) / (n * t_of(p1) ** n)
    rho0 = a * big_f * t_of(p0) ** n
    phi = F.radians(lat)
    es = F.sin(phi) * e
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(e / 2))
    rho = a * big_f * F.pow(t, F.lit(n))
    theta = n * F.radians(lon - zone["lon0"])
    ft = 3937.0 / 1200.0
    return ((rho * F.sin(theta) + zone["fe_m"]) * ft,
            (rho0 - rho * F.cos(theta) + zone["fn_m"]) * ft)


def point_key(lat: Column, lon: Column) -> Column:
    """The six-decimal "lat,lon" key of the per-site context files."""
    return F.format_string("%.6f,%.6f", lat, lon)


def stable_site_id(x: Column, y: Column) -> Column:
    """md5 of the coordinates at one decimal: the same place keeps its id."""
    return F.md5(F.format_string("%.1f,%.1f", x, y))


def segment_nearest(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column
                    ) -> tuple[Column, Column]:
    """(squared distance to segment ab, parameter t of the closest point)."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    raw = ((px - ax) * dx + (py - ay) * dy) / F.nullif(len2, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw, F.lit(0.0))))
    return planar2(px, py, ax + t * dx, ay + t * dy), t
