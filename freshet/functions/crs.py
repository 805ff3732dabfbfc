"""Coordinate systems as column arithmetic (SP3, SP4): UTM and other transverse Mercators by the published Krueger series in
n, to third order; conic equal-area (Albers), conic conformal (Lambert) and web Mercator by their closed forms, with series for latitudes.

NAD83 and WGS84 degrees are taken as equal (within about two metres): datums aren't shifted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_SCALE = 0.9996 * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_EAST = 500000.0
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_zone(west: float, east: float) -> int:
    """SP4: one zone for the whole table, from the middle of its bounds."""
    return min(60, max(1, math.floor(((west + east) / 2 + 180) / 6) + 1))


def _series(factors: tuple[float, ...], xi: Column, eta: Column, outer, inner) -> Column:
    total = F.lit(0.0)
    for j, factor in enumerate(factors, 1):
        total = total + F.lit(factor) * outer(xi * (2 * j)) * inner(eta * (2 * j))
    return total


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in metres (northern form)."""
    k = 2 * math.sqrt(_N) / (1 + _N)
    turn, phi = F.radians(lon - F.lit(float(zone * 6 - 183))), F.radians(lat)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(k) * F.atanh(F.lit(k) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    return (
        F.lit(_EAST) + F.lit(_SCALE) * (eta + _series(_ALPHA, xi, eta, F.cos, F.sinh)),
        F.lit(_SCALE) * (xi + _series(_ALPHA, xi, eta, F.sin, F.cosh)),
    )


def from_utm(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi, eta = y / F.lit(_SCALE), (x - F.lit(_EAST)) / F.lit(_SCALE)
    xi1, eta1 = xi - _series(_BETA, xi, eta, F.sin, F.cosh), eta - _series(_BETA, xi, eta, F.cos, F.sinh)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, factor in enumerate(_DELTA, 1):
        phi = phi + F.lit(factor) * F.sin(chi * (2 * j))
    return F.lit(float(zone * 6 - 183)) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


#: Names of projections in well-known text (fixed values), by what they are here.
PROJECTIONS = {
    "albers": "albers",
    "albers_conic_equal_area": "albers",
    "lambert_conformal_conic": "lambert",
    "lambert_conformal_conic_1sp": "lambert",
    "lambert_conformal_conic_2sp": "lambert",
    "transverse_mercator": "transverse",
    "mercator_auxiliary_sphere": "web",
    "popular_visualisation_pseudo_mercator": "web",
}


@dataclass(frozen=True)
class Crs:
    """A coordinate system: `kind` is degrees or a projection; lengths are in units of `unit` metres."""

    kind: str = "degrees"
    a: float = _A
    f: float = _F
    unit: float = 1.0
    values: dict[str, float] = field(default_factory=dict)

    @property
    def geographic(self) -> bool:
        return self.kind == "degrees"

    def value(self, *names: str, default: float = 0.0) -> float:
        return next((self.values[n] for n in names if n in self.values), default)


def from_wkt(text: str) -> Crs:
    """The system that a .prj file's text (WKT 1) names; ValueError for projections that aren't known here."""
    ellipsoid = re.search(r'SPHEROID\s*\[\s*"[^"]*"\s*,\s*([-+0-9.eE]+)\s*,\s*([-+0-9.eE]+)', text, re.I)
    if not ellipsoid:
        raise ValueError("the coordinate system's text names no ellipsoid")
    a, inverse = float(ellipsoid[1]), float(ellipsoid[2])
    shape = {"a": a, "f": 1 / inverse if inverse else 0.0}
    if not re.match(r"\s*PROJCS", text, re.I):
        return Crs(**shape)
    name = re.search(r'PROJECTION\s*\[\s*"([^"]*)"', text, re.I)
    kind = PROJECTIONS.get(name[1].strip().lower()) if name else None
    if kind is None:
        raise ValueError(f"unknown projection: {name[1] if name else 'none'}")
    values = {k.strip().lower(): float(v) for k, v in re.findall(r'PARAMETER\s*\[\s*"([^"]*)"\s*,\s*([-+0-9.eE]+)', text, re.I)}
    units = re.findall(r'UNIT\s*\[\s*"[^"]*"\s*,\s*([-+0-9.eE]+)', text, re.I)
    return Crs(kind, **shape, unit=float(units[-1]) if units else 1.0, values=values)


Transform = Callable[[Column, Column], tuple[Column, Column]]


def _q(e: float, s):
    """The authalic quantity of a latitude with sine `s`, a number or a column."""
    log = math.log if isinstance(s, float) else F.ln
    return (1 - e * e) * (s / (1 - e * e * s * s) - 1 / (2 * e) * log((1 - e * s) / (1 + e * s)))


def _m(e: float, phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)


def _t(e: float, phi, s):
    """The conformal quantity of a latitude with sine `s`."""
    if isinstance(s, float):
        return math.tan(math.pi / 4 - phi / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)
    return F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))


def _sines(angle: Column, factors: tuple[float, ...]) -> Column:
    out = angle
    for j, factor in enumerate(factors, 1):
        out = out + F.lit(factor) * F.sin(angle * (2 * j))
    return out


def _conic(crs: Crs) -> tuple[Transform, Transform]:
    e2 = max(crs.f * (2 - crs.f), 1e-12)  # a sphere goes by the same forms
    e = math.sqrt(e2)
    lat0 = math.radians(crs.value("latitude_of_origin", "latitude_of_center"))
    lon0 = crs.value("central_meridian", "longitude_of_center")
    first = math.radians(crs.value("standard_parallel_1", default=math.degrees(lat0)))
    second = math.radians(crs.value("standard_parallel_2", default=math.degrees(first)))
    m1, m2, one = _m(e, first), _m(e, second), abs(first - second) < 1e-12
    if crs.kind == "albers":
        q1, q2 = _q(e, math.sin(first)), _q(e, math.sin(second))
        n = math.sin(first) if one else (m1 * m1 - m2 * m2) / (q2 - q1)
        c = m1 * m1 + n * q1
        radius = lambda phi: F.lit(crs.a) * F.sqrt(F.lit(c) - F.lit(n) * _q(e, F.sin(phi))) / F.lit(n)
        rho0 = crs.a * math.sqrt(c - n * _q(e, math.sin(lat0))) / n
        qp = (1 - e2) * (1 / (1 - e2) - 1 / (2 * e) * math.log((1 - e) / (1 + e)))

        def latitude(rho: Column) -> Column:
            q = (F.lit(c) - F.pow(rho * F.lit(n / crs.a), F.lit(2.0))) / F.lit(n)
            phi = _sines(F.asin(q / F.lit(qp)), (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360))
            s = F.sin(phi)  # a step of Newton's on the series
            return phi + F.pow(1 - F.lit(e2) * s * s, F.lit(2.0)) / (2 * F.cos(phi)) * (q - _q(e, s)) / F.lit(1 - e2)

    else:
        scale = crs.value("scale_factor", default=1.0)
        t1, t2 = _t(e, first, math.sin(first)), _t(e, second, math.sin(second))
        n = math.sin(first) if one else math.log(m1 / m2) / math.log(t1 / t2)
        k = scale * crs.a * m1 / (n * t1**n)
        radius = lambda phi: F.lit(k) * F.pow(_t(e, phi, F.sin(phi)), F.lit(n))
        rho0 = k * _t(e, lat0, math.sin(lat0)) ** n
        latitude = lambda rho: _sines(
            F.lit(math.pi / 2) - 2 * F.atan(F.pow(rho / F.lit(k), F.lit(1 / n))),
            (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280),
        )
    sign = math.copysign(1.0, n)

    def forward(lon: Column, lat: Column) -> tuple[Column, Column]:
        rho, turn = radius(F.radians(lat)), F.radians(lon - F.lit(lon0)) * F.lit(n)
        return rho * F.sin(turn), F.lit(rho0) - rho * F.cos(turn)

    def back(x: Column, y: Column) -> tuple[Column, Column]:
        up = F.lit(rho0) - y
        return F.lit(lon0) + F.degrees(F.atan2(x * F.lit(sign), up * F.lit(sign)) / F.lit(n)), F.degrees(latitude(F.lit(sign) * F.sqrt(x * x + up * up)))

    return forward, back


def _transverse(crs: Crs) -> tuple[Transform, Transform]:
    n = crs.f / (2 - crs.f)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    scale = crs.value("scale_factor", default=1.0) * crs.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    lon0, k = crs.value("central_meridian"), 2 * math.sqrt(n) / (1 + n)
    s0 = math.sin(math.radians(crs.value("latitude_of_origin")))
    xi0 = math.atan(math.sinh(math.atanh(s0) - k * math.atanh(k * s0)))
    y0 = scale * (xi0 + sum(a * math.sin(2 * j * xi0) for j, a in enumerate(alpha, 1)))

    def forward(lon: Column, lat: Column) -> tuple[Column, Column]:
        turn, s = F.radians(lon - F.lit(lon0)), F.sin(F.radians(lat))
        t = F.sinh(F.atanh(s) - F.lit(k) * F.atanh(F.lit(k) * s))
        xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
        return F.lit(scale) * (eta + _series(alpha, xi, eta, F.cos, F.sinh)), F.lit(scale) * (xi + _series(alpha, xi, eta, F.sin, F.cosh)) - F.lit(y0)

    def back(x: Column, y: Column) -> tuple[Column, Column]:
        xi, eta = (y + F.lit(y0)) / F.lit(scale), x / F.lit(scale)
        xi1, eta1 = xi - _series(beta, xi, eta, F.sin, F.cosh), eta - _series(beta, xi, eta, F.cos, F.sinh)
        return F.lit(lon0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(_sines(F.asin(F.sin(xi1) / F.cosh(eta1)), delta))

    return forward, back


def _web(crs: Crs) -> tuple[Transform, Transform]:
    lon0 = crs.value("central_meridian")

    def forward(lon: Column, lat: Column) -> tuple[Column, Column]:
        return F.lit(crs.a) * F.radians(lon - F.lit(lon0)), F.lit(crs.a) * F.asinh(F.tan(F.radians(lat)))

    def back(x: Column, y: Column) -> tuple[Column, Column]:
        return F.lit(lon0) + F.degrees(x / F.lit(crs.a)), F.degrees(F.atan(F.sinh(y / F.lit(crs.a))))

    return forward, back


def _both(crs: Crs) -> tuple[Transform, Transform]:
    return {"albers": _conic, "lambert": _conic, "transverse": _transverse, "web": _web}[crs.kind](crs)


def from_degrees(crs: Crs) -> Transform:
    """Degrees to the system's coordinates."""
    if crs.geographic:
        return lambda lon, lat: (lon, lat)
    forward, east, north = _both(crs)[0], crs.value("false_easting"), crs.value("false_northing")

    def apply(lon: Column, lat: Column) -> tuple[Column, Column]:
        x, y = forward(lon, lat)
        return x / F.lit(crs.unit) + F.lit(east), y / F.lit(crs.unit) + F.lit(north)

    return apply


def to_degrees(crs: Crs) -> Transform:
    """The system's coordinates to degrees."""
    if crs.geographic:
        return lambda x, y: (x, y)
    back, east, north = _both(crs)[1], crs.value("false_easting"), crs.value("false_northing")
    return lambda x, y: back((x - F.lit(east)) * F.lit(crs.unit), (y - F.lit(north)) * F.lit(crs.unit))


def between(source: Crs, target: Crs) -> Transform:
    """One system's coordinates to another's, by degrees."""
    if source == target or source.geographic and target.geographic:
        return lambda x, y: (x, y)
    return lambda x, y: from_degrees(target)(*to_degrees(source)(x, y))
