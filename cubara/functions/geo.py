"""Georeferencing and measures as column expressions: affine maps, tie points, projections, distances, areas, polygons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubara.functions.nodata import let

EARTH_RADIUS = 6_371_008.8
# WGS84.
_A, _F = 6_378_137.0, 1 / 298.257223563
_E2 = _F * (2 - _F)

Point = tuple[float, float]


def affine(gt: Sequence[float], col: Column, row: Column) -> tuple[Column, Column]:
    """(x, y) of a pixel position; (col, row) is the pixel's top-left corner, its centre half a pixel on."""
    return F.lit(gt[0]) + col * gt[1] + row * gt[2], F.lit(gt[3]) + col * gt[4] + row * gt[5]


def affine_inverse(gt: Sequence[float], x: Column, y: Column) -> tuple[Column, Column]:
    """(col, row) of a position."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    if not det:
        raise ValueError("the map has no inverse")
    dx, dy = x - gt[0], y - gt[3]
    return (dx * gt[5] - dy * gt[2]) / det, (dy * gt[1] - dx * gt[4]) / det


def window_affine(gt: Sequence[float], col0: float, row0: float, factor: float = 1.0) -> list[float]:
    """The map of a window whose top-left pixel is (col0, row0) and whose pixels are factor times as large."""
    return [gt[0] + col0 * gt[1] + row0 * gt[2], gt[1] * factor, gt[2] * factor, gt[3] + col0 * gt[4] + row0 * gt[5], gt[4] * factor, gt[5] * factor]


def wrap_near(lon: Column, near: Column) -> Column:
    """lon plus a multiple of 360, the closest to near."""
    return lon - 360 * F.round((lon - near) / 360)


def bilinear(fx: Column, fy: Column, v00: Column, v10: Column, v01: Column, v11: Column, longitude: bool = False) -> Column:
    """The value at (fx, fy) in a cell of tie points; beyond 0..1 it extrapolates. Longitudes are made to follow the first corner, and the result lies in -180..180."""
    if longitude:
        v10, v01, v11 = (wrap_near(v, v00) for v in (v10, v01, v11))
    value = v00 * (1 - fx) * (1 - fy) + v10 * fx * (1 - fy) + v01 * (1 - fx) * fy + v11 * fx * fy
    return F.pmod(value + 180, F.lit(360.0)) - 180 if longitude else value


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle meters on the mean sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def ground_meters(lat: Column, geographic: bool) -> tuple[Column, Column]:
    """Meters along x and y that one unit of the axes covers: degrees by latitude, else meters themselves."""
    if not geographic:
        return F.lit(1.0), F.lit(1.0)
    one = math.pi * EARTH_RADIUS / 180
    return F.lit(one) * F.cos(F.radians(lat)), F.lit(one)


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees of an earth-centred position, by the parametric latitude."""
    b = _A * (1 - _F)
    p = F.hypot(x, y)
    beta = F.atan2(z * _A, p * b)
    ep2 = _E2 / (1 - _E2)
    lat = F.atan2(z + F.lit(ep2 * b) * F.pow(F.sin(beta), 3), p - F.lit(_E2 * _A) * F.pow(F.cos(beta), 3))
    return F.degrees(F.atan2(y, x)), F.degrees(lat)


def _ring(points: Sequence[Point]) -> list[tuple[Point, Point]]:
    return list(zip(points, [*points[1:], points[0]]))


def inside(points: Sequence[Point], x: Column, y: Column) -> Column:
    """Whether (x, y) lies in a polygon of the driver's, by the even-odd rule; edges as literals in one compiled expression."""
    odd = F.lit(False)
    for (x1, y1), (x2, y2) in _ring(points):
        if y1 != y2:
            at = F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at)
            odd = odd != crosses
    return odd


def inside_points(pts: Column, x: Column, y: Column) -> Column:
    """As inside, for polygons in a column of array<struct<x,y>>: regions join to pixels on their bounds, then this test."""
    rotated = F.concat(F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 1, 1))

    def crosses(a, b):
        at = a["x"] + F.when(a["y"] != b["y"], (y - a["y"]) * (b["x"] - a["x"]) / F.when(a["y"] != b["y"], b["y"] - a["y"]))
        return F.coalesce(((a["y"] > y) != (b["y"] > y)) & (x < at), F.lit(False))

    return F.aggregate(F.zip_with(pts, rotated, crosses), F.lit(False), lambda odd, c: odd != c)


def bounds(points: Sequence[Point]) -> tuple[float, float, float, float]:
    """min x, min y, max x, max y: what a scan can be pruned by."""
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


def plane_area(pts: Column) -> Column:
    """Area of a polygon in a column of array<struct<x,y>>, by the shoelace sum."""
    rotated = F.concat(F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 1, 1))
    terms = F.zip_with(pts, rotated, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def sphere_area(pts: Column) -> Column:
    """Square meters of a polygon of lon/lat degrees (x, y) on the mean sphere."""
    rotated = F.concat(F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 1, 1))
    terms = F.zip_with(pts, rotated, lambda a, b: F.radians(wrap_near(b["x"], a["x"]) - a["x"]) * (2 + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"]))))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) * (EARTH_RADIUS * EARTH_RADIUS / 2)


def polygon_area(pts: Column, geographic: bool, meters: float | None = 1.0) -> Column:
    """Area of a polygon: on the sphere for degrees, else in the plane, in square meters if a unit has `meters`, in square units if that is None."""
    return sphere_area(pts) if geographic else plane_area(pts) * F.lit(1.0 if meters is None else meters * meters)


def segment_distance(x: Column, y: Column, a: Point, b: Point) -> Column:
    """Distance of a point from the segment a b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a[0]) * dx + (y - a[1]) * dy) / n)) if n else F.lit(0.0)
    return F.hypot(x - (t * dx + a[0]), y - (t * dy + a[1]))


def packed_degrees(v: Column) -> Column:
    """Degrees of DDDMMMSSS.SS."""
    size = F.abs(v)
    d = F.floor(size / 1e6)
    m = F.floor((size - d * 1e6) / 1e3)
    return F.signum(v) * (d + m / 60 + (size - d * 1e6 - m * 1e3) / 3600)


# -- projections (EPSG 4326, 3857, 326xx and 327xx, 3413, 3031)


def _series() -> tuple[list[float], list[float]]:
    """Forward and inverse coefficients of the transverse Mercator's series in the third flattening."""
    n = _F / (2 - _F)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    inverse = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return forward, inverse


_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def _conformal(lat: Column) -> Column:
    """The tangent of the conformal latitude; lat in radians."""
    e, s = math.sqrt(_E2), F.sin(lat)
    return F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))


def _geodetic(tau_c: Column) -> Column:
    """Latitude (radians) from the tangent of the conformal one: five Newton steps, each a fixed expression."""
    e = math.sqrt(_E2)

    def step(tau: Column) -> Column:
        def corrected(s: Column) -> Column:
            back = tau * F.sqrt(1 + s["sigma"] * s["sigma"]) - s["sigma"] * s["root"]
            return tau + (tau_c - back) / F.sqrt(1 + back * back) * (1 + (1 - _E2) * tau * tau) / ((1 - _E2) * s["root"])

        root = F.sqrt(1 + tau * tau)
        return let(F.struct(root.alias("root"), F.sinh(F.lit(e) * F.atanh(F.lit(e) * tau / root)).alias("sigma")), corrected)

    def steps(tau: Column, n: int) -> Column:
        return tau if n == 0 else let(step(tau), lambda t: steps(t, n - 1))

    return F.atan(let(tau_c, lambda t: steps(t, 5)))


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing."""
    forward, _ = _series()
    k = 0.9996 * _RADIUS

    def mapped(p: Column) -> Column:
        x, y = p["eta"], p["xi"]
        for j, a in enumerate(forward, 1):
            x = x + a * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
            y = y + a * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
        return F.struct((x * k + 500_000.0).alias("x"), (y * k + (10_000_000.0 if south else 0.0)).alias("y"))

    lam = F.radians(lon - (6 * zone - 183))
    angles = lambda t: F.struct(F.atan2(t, F.cos(lam)).alias("xi"), F.asinh(F.sin(lam) / F.sqrt(t * t + F.pow(F.cos(lam), 2))).alias("eta"))
    out = let(let(_conformal(F.radians(lat)), angles), mapped)
    return out["x"], out["y"]


def utm_inverse(easting: Column, northing: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """lon and lat in degrees."""
    _, inverse = _series()
    k = 0.9996 * _RADIUS
    start = F.struct(((northing - (10_000_000.0 if south else 0.0)) / k).alias("xi"), ((easting - 500_000.0) / k).alias("eta"))

    def sphere(p: Column) -> Column:
        x, e = p["xi"], p["eta"]
        for j, b in enumerate(inverse, 1):
            x = x - b * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
            e = e - b * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return F.struct(x.alias("x"), e.alias("e"))

    s = let(start, sphere)
    lon = let(s, lambda q: F.degrees(F.atan2(F.sinh(q["e"]), F.cos(q["x"]))) + (6 * zone - 183))
    lat = let(s, lambda q: F.degrees(_geodetic(F.sin(q["x"]) / F.sqrt(F.pow(F.sinh(q["e"]), 2) + F.pow(F.cos(q["x"]), 2)))))
    return lon, lat


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * _A, F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * _A


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / _A), F.degrees(2 * F.atan(F.exp(y / _A)) - math.pi / 2)


def _polar_scale(true_lat: float) -> float:
    """Radius times m / t at the latitude of true scale (degrees, of the pole's own side)."""
    e, s = math.sqrt(_E2), math.sin(math.radians(true_lat))
    t = math.tan(math.pi / 4 - math.radians(true_lat) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)
    return _A * math.cos(math.radians(true_lat)) / math.sqrt(1 - _E2 * s * s) / t


#: EPSG: (latitude of true scale, central meridian, side).
_POLAR = {3413: (70.0, -45.0, 1), 3031: (71.0, 0.0, -1)}


def polar(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    true_lat, middle, side = _POLAR[epsg]
    tau = _conformal(F.radians(lat * side))
    rho = _polar_scale(true_lat) * (F.sqrt(1 + tau * tau) - tau)
    lam = F.radians(lon - middle)
    return rho * F.sin(lam), rho * F.cos(lam) * -side


def polar_inverse(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    true_lat, middle, side = _POLAR[epsg]
    t = F.hypot(x, y) / _polar_scale(true_lat)
    tau = (1 / t - t) / 2
    lat = F.when(t == 0, F.lit(90.0)).otherwise(F.degrees(_geodetic(tau))) * side
    return F.pmod(F.degrees(F.atan2(x, y * -side)) + middle + 180, F.lit(360.0)) - 180, lat


def project(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """(x, y) of lon/lat degrees in a known system."""
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return mercator(lon, lat)
    if epsg in _POLAR:
        return polar(lon, lat, epsg)
    if epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60:
        return utm(lon, lat, epsg % 100, epsg // 100 == 327)
    raise ValueError(f"EPSG:{epsg} is none of 4326, 3857, 3413, 3031, 326xx, 327xx")


def unproject(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """(lon, lat) degrees of a position in a known system."""
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return mercator_inverse(x, y)
    if epsg in _POLAR:
        return polar_inverse(x, y, epsg)
    if epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60:
        return utm_inverse(x, y, epsg % 100, epsg // 100 == 327)
    raise ValueError(f"EPSG:{epsg} is none of 4326, 3857, 3413, 3031, 326xx, 327xx")


def default_epsg(lon: Column, lat: Column) -> Column:
    """The system for a place: polar beyond 84 degrees, else its UTM zone."""
    zone = F.least(F.lit(60), F.greatest(F.lit(1), F.floor((F.pmod(lon + 180, F.lit(360.0))) / 6).cast("int") + 1))
    return F.when(lat > 84, 3413).when(lat < -84, 3031).otherwise(F.when(lat >= 0, 32600).otherwise(32700) + zone)


def repeats(lon: Column) -> Column:
    """The longitudes under which a place on a global grid is found."""
    return F.array(lon - 360, lon, lon + 360)


def globe(lon: Column, lat: Column, lon0: float, lat0: float, height: float) -> tuple[Column, Column, Column]:
    """Perspective view from `height` meters above (lon0, lat0): right and up in radii, and whether the place is visible (spherical)."""
    p, p0, d = F.radians(lat), math.radians(lat0), F.radians(lon - lon0)
    cosc = F.sin(p) * math.sin(p0) + F.cos(p) * F.cos(d) * math.cos(p0)
    far = 1 + height / EARTH_RADIUS
    k = (far - 1) / (far - cosc)
    return k * F.cos(p) * F.sin(d), k * (F.sin(p) * math.cos(p0) - F.cos(p) * F.cos(d) * math.sin(p0)), cosc > 1 / far
