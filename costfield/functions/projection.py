"""Longitude and latitude to UTM zone 32N on the GRS80 ellipsoid and back, as column expressions (Krüger series)."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid, the zone, and the published coefficients of the series (Karney 2011, to the sixth order).
_AXIS, _FLATTENING, _SCALE, _MERIDIAN, _EASTING = 6378137.0, 1 / 298.257222101, 0.9996, 9 * pi / 180, 500000.0
_N = _FLATTENING / (2 - _FLATTENING)
_TO_GRID = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
_FROM_GRID = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
_RADIUS = _SCALE * _AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_E = sqrt(_FLATTENING * (2 - _FLATTENING))


def _coefficients(series: tuple) -> list[float]:
    return [sum(c * _N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(series, 1)]


TO_GRID, FROM_GRID = _coefficients(_TO_GRID), _coefficients(_FROM_GRID)


def to_utm32(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    sine, east = F.sin(F.radians(lat)), F.radians(lon) - F.lit(_MERIDIAN)
    t = F.sinh(F.atanh(sine) - _E * F.atanh(_E * sine))
    north, across = F.atan2(t, F.cos(east)), F.atanh(F.sin(east) / F.sqrt(1 + t * t))
    y = sum((a * F.sin(2 * j * north) * F.cosh(2 * j * across) for j, a in enumerate(TO_GRID, 1)), north)
    x = sum((a * F.cos(2 * j * north) * F.sinh(2 * j * across) for j, a in enumerate(TO_GRID, 1)), across)
    return _EASTING + _RADIUS * x, _RADIUS * y


def conformal(x: Column, y: Column) -> tuple[Column, Column]:
    """The tangent of the conformal latitude, and the longitude in degrees, of a grid point."""
    north, across = y / _RADIUS, (x - _EASTING) / _RADIUS
    xi = north - sum((b * F.sin(2 * j * north) * F.cosh(2 * j * across) for j, b in enumerate(FROM_GRID, 1)), F.lit(0.0))
    eta = across - sum((b * F.cos(2 * j * north) * F.sinh(2 * j * across) for j, b in enumerate(FROM_GRID, 1)), F.lit(0.0))
    tangent = F.sin(xi) / F.sqrt(F.pow(F.sinh(eta), 2) + F.pow(F.cos(xi), 2))
    return tangent, F.degrees(F.lit(_MERIDIAN) + F.atan2(F.sinh(eta), F.cos(xi)))


def latitude(tangent: Column, steps: int = 5) -> Column:
    """The latitude in degrees from the conformal latitude's tangent, by Newton's method."""

    def step(tau: Column, _: Column) -> Column:
        root = F.sqrt(1 + tau * tau)
        sigma = F.sinh(_E * F.atanh(_E * tau / root))
        guess = tau * F.sqrt(1 + sigma * sigma) - sigma * root
        slope = (1 - _E**2) * root * F.sqrt(1 + guess * guess) / (1 + (1 - _E**2) * tau * tau)
        return tau + (tangent - guess) / slope

    return F.degrees(F.atan(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), tangent, step)))
