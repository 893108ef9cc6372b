"""Distances, projected grid cells and cell geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Mean Earth radius (m); WGS84 semi-major axis (m) and flattening; UTM scale and false easting.
EARTH_RADIUS = 6_371_008.8
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
UTM_SCALE, UTM_EASTING = 0.9996, 500_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) ** 2
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def _series():
    """Coefficients of the transverse Mercator series in the third flattening, to order 4."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    return n, radius, alpha, beta


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (m), northern hemisphere."""
    n, radius, alpha, _ = _series()
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(6.0 * zone - 183.0))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_EASTING + UTM_SCALE * radius * east, UTM_SCALE * radius * north


def utm_inverse(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude (degrees)."""
    n, radius, _, beta = _series()
    xi, eta = north / (UTM_SCALE * radius), (east - UTM_EASTING) / (UTM_SCALE * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    # Geodetic from conformal latitude: sinh(psi) fixed point, four rounds reach 1e-13.
    psi0 = F.atanh(F.sin(chi))
    s = F.sin(chi)
    for _ in range(5):
        s = F.tanh(psi0 + e * F.atanh(e * s))
    lon = F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + F.lit(6.0 * zone - 183.0)
    return lon, F.degrees(F.asin(s))


def to_grid(df: DataFrame, lon: str, lat: str, zone: int, size: float) -> DataFrame:
    """Half-open square cells of the projected plane; invalid coordinates get null indices."""
    ok = F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    ok = F.coalesce(ok, F.lit(False))
    east, north = utm(F.col(lon), F.col(lat), zone)
    cell = lambda v: F.when(F.col("grid_valid"), F.floor(v / size))
    return df.withColumn("grid_valid", ok).withColumns({"x_index": cell(east), "y_index": cell(north)})


def grid_key(x: Column, y: Column) -> Column:
    return x.cast("long") * 10_000_000 + y.cast("long")


def grid_id(city: Column, size: int, x: Column, y: Column) -> Column:
    return F.format_string(f"%s_R{size}_E%d_N%d", city, x.cast("long"), y.cast("long"))


def cell_geometry(df: DataFrame, x: str, y: str, size: float, zone: int) -> DataFrame:
    """Bounds (m), centre (degrees) and the closed ring of the cell in degrees as text."""
    lo_x, lo_y = F.col(x) * F.lit(float(size)), F.col(y) * F.lit(float(size))
    hi_x, hi_y = lo_x + size, lo_y + size
    lon, lat = utm_inverse(lo_x + size / 2, lo_y + size / 2, zone)
    ring = [(lo_x, lo_y), (hi_x, lo_y), (hi_x, hi_y), (lo_x, hi_y), (lo_x, lo_y)]
    points = [F.format_string("%.8f %.8f", *utm_inverse(a, b, zone)) for a, b in ring]
    return df.withColumns(
        {
            "min_x": lo_x, "min_y": lo_y, "max_x": hi_x, "max_y": hi_y,
            "centroid_lon": lon, "centroid_lat": lat,
            "wkt": F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *points), F.lit("))")),
        }
    )


def coarse_index(index: Column, factor: int) -> Column:
    return F.floor(index / factor)
