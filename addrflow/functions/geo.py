"""Coordinates as Column expressions: the national projections, the bounding box, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: EPSG code -> (central meridian, scale, false easting, false northing).
PROJECTIONS = {2180: (19.0, 0.9993, 500_000.0, -5_300_000.0), 2176: (15.0, 0.999923, 5_500_000.0, 0.0), 2177: (18.0, 0.999923, 6_500_000.0, 0.0), 2178: (21.0, 0.999923, 7_500_000.0, 0.0), 2179: (24.0, 0.999923, 8_500_000.0, 0.0)}
#: A box around the country (west, east, south, north).
BOX = (13.9, 24.3, 48.9, 55.0)
_A, _F = 6378137.0, 1 / 298.257222101
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def parse_epsg(srs: Column) -> Column:
    """struct(epsg, north_first): 2180 unless named; URN and URL forms put the northing first."""
    code = F.nullif(F.regexp_extract(srs, "([0-9]{4,5})$", 1), F.lit("")).cast("int")
    return F.struct(F.coalesce(code, F.lit(2180)).alias("epsg"), F.coalesce(F.rlike(srs, F.lit("^(urn:|https?://)")), F.lit(False)).alias("north_first"))


def in_poland(lon: Column, lat: Column) -> Column:
    return lon.between(*BOX[:2]) & lat.between(*BOX[2:])


def unproject(east: Column, north: Column, epsg: Column) -> Column:
    """struct(lon, lat) in degrees: the inverse transverse Mercator projection by Krueger's series."""

    def pick(k: int) -> Column:
        out = F.lit(float(PROJECTIONS[2180][k]))
        for code, values in PROJECTIONS.items():
            out = F.when(epsg == code, float(values[k])).otherwise(out)
        return out

    plane = F.struct(((north - pick(3)) / (pick(1) * _RADIUS)).alias("xi"), ((east - pick(2)) / (pick(1) * _RADIUS)).alias("eta"))

    def sphere(p: Column) -> Column:
        x, y = p["xi"], p["eta"]
        for j, b in enumerate(_BETA, 1):
            x = x - F.lit(b) * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
            y = y - F.lit(b) * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return F.struct(x.alias("x"), y.alias("y"))

    def geographic(s: Column) -> Column:
        lon = pick(0) + F.degrees(F.atan2(F.sinh(s["y"]), F.cos(s["x"])))
        return F.struct(lon.alias("lon"), F.asin(F.sin(s["x"]) / F.cosh(s["y"])).alias("chi"))

    def ellipsoid(g: Column) -> Column:
        lat = g["chi"]
        for j, d in enumerate(_DELTA, 1):
            lat = lat + F.lit(d) * F.sin(2 * j * g["chi"])
        return F.struct(g["lon"].alias("lon"), F.degrees(lat).alias("lat"))

    return let(let(let(plane, sphere), geographic), ellipsoid)


def to_wgs84(a: Column, b: Column, epsg: Column, north_first: Column) -> Column:
    """struct(lon, lat, swapped) of a coordinate pair in its declared axis order.

    A result outside the country is tried in the other order; if that is inside, it is taken and marked as swapped."""

    def both(first: Column, second: Column) -> Column:
        flat = unproject(first, second, epsg)
        return F.when(epsg == 4326, F.struct(first.alias("lon"), second.alias("lat"))).otherwise(flat)

    order = F.struct(F.when(north_first, b).otherwise(a).alias("east"), F.when(north_first, a).otherwise(b).alias("north"))
    pair = let(order, lambda o: F.struct(both(o["east"], o["north"]).alias("declared"), both(o["north"], o["east"]).alias("other")))

    def pick(p: Column) -> Column:
        d, o = p["declared"], p["other"]
        swapped = ~in_poland(d["lon"], d["lat"]) & in_poland(o["lon"], o["lat"])
        return F.struct(F.round(F.when(swapped, o["lon"]).otherwise(d["lon"]), 7).alias("lon"), F.round(F.when(swapped, o["lat"]).otherwise(d["lat"]), 7).alias("lat"), swapped.alias("swapped"))

    return let(pair, pick)


def first_vertex(pos: Column) -> Column:
    """struct(a, b): the first two numbers of a coordinate list, null if they are none."""
    parts = F.split(F.trim(pos), r"[\s,]+")
    a, b = (F.try_element_at(parts, F.lit(k)).try_cast("double") for k in (1, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres (haversine)."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(2 * 6371008.8) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def degrees_of(metres: float) -> tuple[float, float]:
    """Cell sides (longitude, latitude) that a distance never spans more than one of, inside BOX."""
    return 1.01 * metres / (111_000 * math.cos(math.radians(BOX[3]))), 1.01 * metres / 111_000
