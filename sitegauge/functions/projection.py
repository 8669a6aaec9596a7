"""WGS84 degrees <-> national grid metres, staged as columns so each step is computed once.

The published transverse Mercator series and the seven-parameter datum shift are used, without a
grid shift file, so results are good to a few metres.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Airy 1830 and WGS84 ellipsoids, the national grid projection, OSGB36 -> WGS84 shift.
AIRY = (6377563.396, 6356256.909)
WGS84 = (6378137.0, 6356752.314245)
SCALE, LAT0, LON0, EAST0, NORTH0 = 0.9996012717, 49.0, -2.0, 400000.0, -100000.0
SHIFT_METRES = (446.448, -125.157, 542.060)
SHIFT_ARCSEC = (0.1502, 0.2470, 0.8421)
SHIFT_PPM = -20.4894

def _ecc2(ellipsoid: tuple[float, float]) -> float:
    a, b = ellipsoid
    return 1 - (b * b) / (a * a)


def _change_datum(df: DataFrame, source: tuple, target: tuple, sign: int) -> DataFrame:
    """Move (_lat, _lon) in radians from one datum to the other through cartesian coordinates."""
    e2 = _ecc2(source)
    df = df.withColumn("_nu", F.lit(source[0]) / F.sqrt(1 - e2 * F.sin(F.col("_lat")) * F.sin(F.col("_lat"))))
    df = df.withColumns({
        "_x": F.col("_nu") * F.cos(F.col("_lat")) * F.cos(F.col("_lon")),
        "_y": F.col("_nu") * F.cos(F.col("_lat")) * F.sin(F.col("_lon")),
        "_z": F.col("_nu") * (1 - e2) * F.sin(F.col("_lat")),
    })
    tx, ty, tz = (sign * t for t in SHIFT_METRES)
    rx, ry, rz = (sign * math.radians(r / 3600) for r in SHIFT_ARCSEC)
    s = 1 + sign * SHIFT_PPM * 1e-6
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    df = df.withColumns({
        "_x": tx + s * x - rz * y + ry * z,
        "_y": ty + rz * x + s * y - rx * z,
        "_z": tz - ry * x + rx * y + s * z,
    })
    e2 = _ecc2(target)
    df = df.withColumns({"_p": F.sqrt(x * x + y * y), "_lon": F.atan2(y, x)})
    df = df.withColumn("_lat", F.atan2(z, F.col("_p") * (1 - e2)))
    for _ in range(4):
        df = df.withColumn("_nu", F.lit(target[0]) / F.sqrt(1 - e2 * F.sin(F.col("_lat")) * F.sin(F.col("_lat"))))
        df = df.withColumn("_lat", F.atan2(z + e2 * F.col("_nu") * F.sin(F.col("_lat")), F.col("_p")))
    return df.drop("_x", "_y", "_z", "_p", "_nu")


def _meridian(lat: Column) -> Column:
    a, b = AIRY
    n = (a - b) / (a + b)
    d, s = lat - math.radians(LAT0), lat + math.radians(LAT0)
    return (b * SCALE) * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d
        - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(s)
        + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * s)
        - (35 / 24 * n**3) * F.sin(3 * d) * F.cos(3 * s)
    )


def _curvatures(df: DataFrame) -> DataFrame:
    e2, a = _ecc2(AIRY), AIRY[0]
    df = df.withColumn("_w", 1 - e2 * F.sin(F.col("_lat")) * F.sin(F.col("_lat")))
    df = df.withColumns({
        "_nu": a * SCALE / F.sqrt(F.col("_w")),
        "_rho": a * SCALE * (1 - e2) / F.pow(F.col("_w"), F.lit(1.5)),
        "_t2": F.tan(F.col("_lat")) * F.tan(F.col("_lat")),
    })
    return df.withColumn("_eta2", F.col("_nu") / F.col("_rho") - 1)


def lonlat_to_grid(df: DataFrame, lon: str, lat: str, east: str = "x", north: str = "y") -> DataFrame:
    out = df.withColumns({"_lat": F.radians(lat), "_lon": F.radians(lon)})
    out = _curvatures(_change_datum(out, WGS84, AIRY, -1))
    nu, rho, t2, eta2 = (F.col(c) for c in ("_nu", "_rho", "_t2", "_eta2"))
    out = out.withColumns({"_d": F.col("_lon") - math.radians(LON0), "_s": F.sin(F.col("_lat")), "_c": F.cos(F.col("_lat"))})
    d, s, c = F.col("_d"), F.col("_s"), F.col("_c")
    out = out.withColumns({
        north: _meridian(F.col("_lat")) + NORTH0
        + nu / 2 * s * c * d * d
        + nu / 24 * s * F.pow(c, 3) * (5 - t2 + 9 * eta2) * F.pow(d, 4)
        + nu / 720 * s * F.pow(c, 5) * (61 - 58 * t2 + t2 * t2) * F.pow(d, 6),
        east: EAST0 + nu * c * d
        + nu / 6 * F.pow(c, 3) * (nu / rho - t2) * F.pow(d, 3)
        + nu / 120 * F.pow(c, 5) * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2) * F.pow(d, 5),
    })
    return out.drop("_lat", "_lon", "_w", "_nu", "_rho", "_t2", "_eta2", "_d", "_s", "_c")


def grid_to_lonlat(df: DataFrame, east: str, north: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    scale = AIRY[0] * SCALE
    out = df.withColumn("_lat", (F.col(north) - NORTH0) / scale + math.radians(LAT0))
    for _ in range(6):
        out = out.withColumn("_lat", F.col("_lat") + (F.col(north) - NORTH0 - _meridian(F.col("_lat"))) / scale)
    out = _curvatures(out)
    nu, rho, t2, eta2 = (F.col(c) for c in ("_nu", "_rho", "_t2", "_eta2"))
    d = (F.col(east) - EAST0) / nu
    out = out.withColumns({
        "_lon": math.radians(LON0)
        + (d - (nu / rho + 2 * t2) / 6 * F.pow(d, 3) + (5 + 28 * t2 + 24 * t2 * t2) / 120 * F.pow(d, 5))
        / F.cos(F.col("_lat")),
        "_lat": F.col("_lat")
        - F.tan(F.col("_lat")) * nu / (2 * rho) * d * d
        + F.tan(F.col("_lat")) * nu / (24 * rho) * (5 + 3 * t2 + eta2 - 9 * t2 * eta2) * F.pow(d, 4)
        - F.tan(F.col("_lat")) * nu / (720 * rho) * (61 + 90 * t2 + 45 * t2 * t2) * F.pow(d, 6),
    })
    out = _change_datum(out, AIRY, WGS84, 1)
    return out.withColumns({lon: F.degrees(F.col("_lon")), lat: F.degrees(F.col("_lat"))}).drop(
        "_lat", "_lon", "_w", "_nu", "_rho", "_t2", "_eta2"
    )
