"""Geometry on the WGS84 ellipsoid: cell areas, projections and polygon predicates.

Areas are exact on the authalic sphere: the area between two parallels has a closed form, so a raster cell's
area is a column expression, and a polygon's is a sum over its edges (taken as straight in longitude and sine
of authalic latitude, which differs from geodesics by far less than a raster cell for patches of cells).
Polygons are GeoJSON coordinate texts; their predicates are pandas UDFs over Arrow batches.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# WGS84.
A, INVERSE_F = 6378137.0, 298.257223563
_F = 1 / INVERSE_F
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def _q(sin_lat: Column) -> Column:
    """Twice the area, over a*a and per radian, between the equator and a latitude."""
    es = sin_lat * _E
    return (1 - _E2) * (sin_lat / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * _E))


def cell_area_m2(lat_from: Column, lat_to: Column, width: Column) -> Column:
    """Area of a cell between two latitudes, ``width`` degrees of longitude wide."""
    north, south = (_q(F.sin(F.radians(x))) for x in (lat_to, lat_from))
    return F.abs(north - south) * F.abs(F.radians(width)) * (A * A / 2)


def local_scales(lat: Column) -> tuple[Column, Column]:
    """Metres per degree of longitude and of latitude at a latitude, by the ellipsoid's radii of curvature there."""
    sin = F.sin(F.radians(lat))
    w = F.sqrt(1 - _E2 * sin * sin)
    return F.cos(F.radians(lat)) * (math.radians(A) / w), math.radians(A * (1 - _E2)) / (w * w * w)


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 10) -> Column:
    """Length in metres of the geodesic between two points, by Vincenty's inverse formula with a fixed number of rounds:
    below a millimetre for points that are not nearly opposite each other; 0 for the same point."""
    b = A * (1 - _F)
    u1, u2 = (F.atan((1 - _F) * F.tan(F.radians(x))) for x in (lat1, lat2))
    start = F.struct(F.radians(lon2 - lon1).alias("apart"), F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon2 - lon1).alias("on"))
    keep = lambda s, on: F.struct(*[s[k].alias(k) for k in ("apart", "s1", "c1", "s2", "c2")], on.alias("on"))

    def arc(s: Column) -> tuple[Column, ...]:
        """(sine, cosine and length of the arc, squared cosine of the azimuth at the equator, cosine at twice the middle, its sine)"""
        x, y = s["c2"] * F.sin(s["on"]), s["c1"] * s["s2"] - s["s1"] * s["c2"] * F.cos(s["on"])
        sin = F.sqrt(x * x + y * y)
        cos = s["s1"] * s["s2"] + s["c1"] * s["c2"] * F.cos(s["on"])
        azimuth = F.coalesce(F.try_divide(s["c1"] * s["c2"] * F.sin(s["on"]), sin), F.lit(0.0))
        square = 1 - azimuth * azimuth
        middle = F.coalesce(cos - F.try_divide(2 * s["s1"] * s["s2"], F.when(square > 1e-15, square)), F.lit(0.0))
        return sin, cos, F.atan2(sin, cos), square, middle, azimuth

    def onward(s: Column, _: Column) -> Column:
        sin, cos, length, square, middle, azimuth = arc(s)
        c = _F / 16 * square * (4 + _F * (4 - 3 * square))
        return keep(s, s["apart"] + (1 - c) * _F * azimuth * (length + c * sin * (middle + c * cos * (2 * middle * middle - 1))))

    def metres(s: Column) -> Column:
        sin, cos, length, square, middle, _ = arc(s)
        u = square * ((A * A - b * b) / (b * b))
        big = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
        small = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
        turn = small * sin * (middle + small / 4 * (cos * (2 * middle * middle - 1) - small / 6 * middle * (4 * sin * sin - 3) * (4 * middle * middle - 3)))
        return b * big * (length - turn)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, onward, metres)


def utm_to_lon_lat(easting: Column, northing: Column, zone: Column, north: Column) -> Column:
    """struct<lon,lat> in degrees, by Krüger's series to the third order (below a millimetre in a zone)."""
    n = _F / (2 - _F)
    scale = 0.9996 * A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = F.when(north, northing).otherwise(northing - 10_000_000.0) / scale
    eta = (easting - 500_000.0) / scale
    xi1 = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    eta1 = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    lon = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.struct((F.degrees(lon) + zone * 6 - 183).alias("lon"), F.degrees(lat).alias("lat"))


def polygons_of(text: str | None) -> list[list[np.ndarray]]:
    """Polygons, each a list of rings (n x 2), of a Polygon's or MultiPolygon's coordinates."""
    if not text:
        return []
    found = json.loads(text)
    depth, at = 0, found
    while isinstance(at, list) and at:
        depth, at = depth + 1, at[0]
    many = found if depth == 4 else [found] if depth == 3 else []
    return [[np.asarray(ring, float)[:, :2] for ring in polygon if len(ring)] for polygon in many]


def _ring_area(ring: np.ndarray) -> float:
    sin = np.sin(np.radians(ring[:, 1]))
    es = _E * sin
    q = (1 - _E2) * (sin / (1 - es * es) - np.log((1 - es) / (1 + es)) / (2 * _E))
    lon = np.radians(ring[:, 0])
    return abs(float((np.diff(lon) * (q[1:] + q[:-1])).sum())) / 2 * A * A / 2


@F.pandas_udf(T.DoubleType())
def polygon_area_m2(coordinates: pd.Series) -> pd.Series:
    """Area of polygons less their holes; null for none."""
    area = lambda t: sum(_ring_area(p[0]) - sum(map(_ring_area, p[1:])) for p in polygons_of(t) if p) if t else None
    return coordinates.map(area, na_action="ignore")


def inside(polygons: list[list[np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Points in any polygon, by even-odd crossings of all its rings; a point on an edge counts."""
    out = np.zeros(len(x), bool)
    for rings in polygons:
        odd, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for ring in rings:
            for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:], strict=True):
                side = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
                edge |= (side == 0) & (np.minimum(x0, x1) <= x) & (x <= np.maximum(x0, x1)) & (np.minimum(y0, y1) <= y) & (y <= np.maximum(y0, y1))
                if y0 != y1:
                    odd ^= ((y0 > y) != (y1 > y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
        out |= odd | edge
    return out


@F.pandas_udf(T.BooleanType())
def point_in_polygon(x: pd.Series, y: pd.Series, coordinates: pd.Series) -> pd.Series:
    """Rows that share a polygon are tested together."""
    out = np.zeros(len(x), bool)
    for text, rows in coordinates.groupby(coordinates).indices.items():
        out[rows] = inside(polygons_of(text), x.to_numpy()[rows], y.to_numpy()[rows])
    return pd.Series(out)


def _crosses(ring: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]
    n = len(a)
    turn = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    i, j = np.triu_indices(n, 2)
    keep = ~((i == 0) & (j == n - 1))
    i, j = i[keep], j[keep]
    return bool(((turn(a[i], b[i], a[j]) * turn(a[i], b[i], b[j]) < 0) & (turn(a[j], b[j], a[i]) * turn(a[j], b[j], b[i]) < 0)).any())


@F.pandas_udf(T.StringType())
def polygon_problem(coordinates: pd.Series) -> pd.Series:
    """What is wrong with a polygon, or null: empty, open or short rings, out of range, crossing itself."""

    def problem(text: str | None) -> str | None:
        try:
            polygons = polygons_of(text)
        except (ValueError, TypeError, IndexError):
            return "not coordinates"
        rings = [r for p in polygons for r in p]
        if not rings:
            return "empty"
        for r in rings:
            if len(r) < 4 or not np.array_equal(r[0], r[-1]):
                return "ring not closed"
            if not np.isfinite(r).all() or (np.abs(r[:, 0]) > 180).any() or (np.abs(r[:, 1]) > 90).any():
                return "out of range"
            if _crosses(r):
                return "crosses itself"
        return None

    return coordinates.map(problem)
