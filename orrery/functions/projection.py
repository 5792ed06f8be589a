"""Coordinates between degrees and metres, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MERCATOR_RADIUS = 6378137.0


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical web-mercator metres of degrees."""
    return F.radians(lon) * MERCATOR_RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_RADIUS), F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - math.pi / 2)


def to_transverse_mercator(lon: Column, lat: Column, meridian: float = 117.0, a: float = 6378245.0, f: float = 1 / 298.3, k0: float = 1.0, false_easting: float = 500_000.0) -> tuple[Column, Column]:
    """Gauss-Krueger metres (easting, northing) about a meridian, by Krueger's series on the given ellipsoid. No shift of datum is applied, which can be
    some tens of metres."""
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return k0 * big * x + false_easting, k0 * big * y


def project(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Coordinates in one of the reference systems 4326 (degrees), 3857 (spherical mercator) and 2436 (Gauss-Krueger about 117 degrees east, without its shift of datum)."""
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return to_mercator(lon, lat)
    if epsg == 2436:
        return to_transverse_mercator(lon, lat)
    raise ValueError(f"no projection for epsg {epsg}")
