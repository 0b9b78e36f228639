"""Ellipsoidal map projections as column expressions, forward and inverse.

A projection is a small record of parameters; ``forward`` and ``inverse`` turn
columns of degrees into columns of metres and back, inside Catalyst.  All of
them go through the conformal latitude: the isometric latitude is closed, and
its inverse is a series in the third flattening n.  The transverse Mercator adds
the series of the rectifying sphere; both are kept to n^4, which leaves far less
than a millimetre within a zone.  The conic takes two standard parallels.

Null coordinates give null.  Poles have no conic or Mercator image; what lies
90 degrees or more from a transverse Mercator's meridian is outside its range.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RAD = math.pi / 180


@dataclass(frozen=True)
class Ellipsoid:
    """Semi-major axis in metres and inverse flattening (0: a sphere)."""

    a: float
    inverse_flattening: float

    @property
    def f(self) -> float:
        return 1 / self.inverse_flattening if self.inverse_flattening else 0.0

    @property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)

    def isometric(self, latitude: float) -> float:
        s = math.sin(latitude)
        return math.atanh(s) - self.e * math.atanh(self.e * s)

    def to_geodetic(self) -> list[float]:
        """Series from conformal to geodetic latitude, by multiples of 2."""
        n = self.n
        return [
            2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4, 7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4,
            56 / 15 * n**3 - 136 / 35 * n**4, 4279 / 630 * n**4,
        ]


@dataclass(frozen=True)
class TransverseMercator:
    """Origin in degrees, scale on the meridian, false easting and northing in metres."""

    ellipsoid: Ellipsoid
    lat0: float
    lon0: float
    k0: float
    x0: float
    y0: float

    @property
    def radius(self) -> float:
        n = self.ellipsoid.n
        return self.k0 * self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def to_plane(self) -> list[float]:
        n = self.ellipsoid.n
        return [
            n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
            61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4,
        ]

    def to_sphere(self) -> list[float]:
        n = self.ellipsoid.n
        return [
            n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4,
            17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4,
        ]

    @property
    def northing0(self) -> float:
        """Northing of the origin's latitude, before ``y0``."""
        xi = math.atan(math.sinh(self.ellipsoid.isometric(self.lat0 * RAD)))
        return self.radius * (xi + sum(a * math.sin(2 * k * xi) for k, a in enumerate(self.to_plane(), 1)))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        t = F.sinh(_isometric(self.ellipsoid, lat * RAD))
        away = (lon - self.lon0) * RAD
        xi, eta = F.atan2(t, F.cos(away)), F.asinh(F.sin(away) / F.sqrt(t * t + F.cos(away) * F.cos(away)))
        x, y = eta, xi
        for k, a in enumerate(self.to_plane(), 1):
            x = x + F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * a
            y = y + F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * a
        return x * self.radius + self.x0, y * self.radius + (self.y0 - self.northing0)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        xi, eta = (y - (self.y0 - self.northing0)) / self.radius, (x - self.x0) / self.radius
        u, v = xi, eta
        for k, b in enumerate(self.to_sphere(), 1):
            u = u - F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * b
            v = v - F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * b
        latitude = _geodetic(self.ellipsoid, F.asin(F.sin(u) / F.cosh(v)))
        return F.atan2(F.sinh(v), F.cos(u)) / RAD + self.lon0, latitude / RAD


@dataclass(frozen=True)
class LambertConic:
    """Conformal conic with two standard parallels, origin in degrees."""

    ellipsoid: Ellipsoid
    lat0: float
    lon0: float
    parallels: tuple[float, float]
    x0: float
    y0: float

    def _width(self, latitude: float) -> float:
        return math.cos(latitude) / math.sqrt(1 - (self.ellipsoid.e * math.sin(latitude)) ** 2)

    @property
    def exponent(self) -> float:
        first, second = (p * RAD for p in self.parallels)
        if first == second:
            return math.sin(first)
        return math.log(self._width(first) / self._width(second)) / (self.ellipsoid.isometric(second) - self.ellipsoid.isometric(first))

    @property
    def constant(self) -> float:
        first = self.parallels[0] * RAD
        return self.ellipsoid.a * self._width(first) / self.exponent * math.exp(self.exponent * self.ellipsoid.isometric(first))

    @property
    def radius0(self) -> float:
        return self.constant * math.exp(-self.exponent * self.ellipsoid.isometric(self.lat0 * RAD))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        radius = F.exp(_isometric(self.ellipsoid, lat * RAD) * -self.exponent) * self.constant
        turn = (lon - self.lon0) * (RAD * self.exponent)
        return radius * F.sin(turn) + self.x0, (F.lit(self.radius0) - radius * F.cos(turn)) + self.y0

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        sign = math.copysign(1, self.exponent)
        east, south = x - self.x0, (y - self.y0) * -1 + self.radius0
        radius = F.sqrt(east * east + south * south) * sign
        isometric = F.log(radius / self.constant) / -self.exponent
        latitude = _geodetic(self.ellipsoid, F.atan(F.sinh(isometric)))
        return F.atan2(east * sign, south * sign) / (RAD * self.exponent) + self.lon0, latitude / RAD


@dataclass(frozen=True)
class WebMercator:
    """The sphere's Mercator on geodetic degrees."""

    radius: float = 6378137.0

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon * (RAD * self.radius), F.asinh(F.tan(lat * RAD)) * self.radius

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return x / (RAD * self.radius), F.atan(F.sinh(y / self.radius)) / RAD


def _isometric(ellipsoid: Ellipsoid, latitude: Column) -> Column:
    s = F.sin(latitude)
    return F.atanh(s) - F.atanh(s * ellipsoid.e) * ellipsoid.e


def _geodetic(ellipsoid: Ellipsoid, conformal: Column) -> Column:
    latitude = conformal
    for k, d in enumerate(ellipsoid.to_geodetic(), 1):
        latitude = latitude + F.sin(conformal * (2 * k)) * d
    return latitude


# The ellipsoid and the projections that the export codes stand for.
GRS80 = Ellipsoid(6378137.0, 298.257222101)


def utm(zone: int, south: bool, ellipsoid: Ellipsoid = GRS80) -> TransverseMercator:
    return TransverseMercator(ellipsoid, 0.0, 6 * zone - 183.0, 0.9996, 500000.0, 10_000_000.0 if south else 0.0)


PROJECTIONS = {
    2154: LambertConic(GRS80, 46.5, 3.0, (49.0, 44.0), 700000.0, 6600000.0),
    2972: utm(22, False),
    2975: utm(40, True),
    3857: WebMercator(),
    4471: utm(38, True),
    5490: utm(20, False),
}


def _by_code(srid: Column, of: Callable[[object], Column], codes: dict) -> Column:
    found = F.lit(None)
    for code, projection in codes.items():
        found = F.when(srid == code, of(projection)).otherwise(found)
    return found


def _pair(names: tuple[str, str], values: tuple[Column, Column]) -> Column:
    return F.struct(*(v.cast("double").alias(n) for n, v in zip(names, values)))


def project(lon: Column, lat: Column, srid: Column, codes: dict = PROJECTIONS) -> Column:
    """Struct (x, y) of degrees in the projection of ``srid``; 4326 keeps them; null for an unknown code."""
    same = F.when(srid == 4326, _pair(("x", "y"), (lon, lat)))
    return F.coalesce(same, _by_code(srid, lambda p: _pair(("x", "y"), p.forward(lon, lat)), codes))


def unproject(x: Column, y: Column, srid: Column, codes: dict = PROJECTIONS) -> Column:
    """Struct (lon, lat) in degrees of a point in the projection of ``srid``."""
    same = F.when(srid == 4326, _pair(("lon", "lat"), (x, y)))
    return F.coalesce(same, _by_code(srid, lambda p: _pair(("lon", "lat"), p.inverse(x, y)), codes))


def project_rings(rings: Column, srid: Column, codes: dict = PROJECTIONS) -> Column:
    """Rings of points (lon, lat) in the projection of ``srid``, as points (x, y)."""
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: project(p["lon"], p["lat"], srid, codes)))
