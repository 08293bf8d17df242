"""Points, segments and paths on the globe and on the plane. Coordinates are longitude, then latitude, in degrees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
KM_A_DEGREE_EAST, KM_A_DEGREE_NORTH = 111.32, 110.574


def haversine_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def flat_km(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    east = (lon_b - lon_a) * KM_A_DEGREE_EAST * F.cos(F.radians((lat_a + lat_b) / 2))
    return F.sqrt(east * east + F.pow((lat_b - lat_a) * KM_A_DEGREE_NORTH, 2))


def round_up_half(x: Column, digits: int = 0) -> Column:
    """Rounded with ties toward positive infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def undirected(a: Column, b: Column) -> tuple[Column, Column]:
    """Both ends in order: numbers by value, texts by bytes, structs by fields."""
    return F.least(a, b), F.greatest(a, b)


def segment_position(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on the segment, from 0 to 1, the point nearest to p lies."""
    square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    along = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(square, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = segment_position(px, py, ax, ay, bx, by)
    return F.sqrt(F.pow(px - (ax + t * (bx - ax)), 2) + F.pow(py - (ay + t * (by - ay)), 2))


def box_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A lower bound of the distance to anything in the box."""
    return F.sqrt(F.pow(F.greatest(x0 - px, F.lit(0.0), px - x1), 2) + F.pow(F.greatest(y0 - py, F.lit(0.0), py - y1), 2))


def kept_places(lon: np.ndarray, lat: np.ndarray, tolerance_m: float) -> np.ndarray:
    """Places of the points that a path keeps when others lie within the tolerance of the kept ones' lines: both ends, and of a
    stretch the farthest point beyond it, of equal ones the first. Without a tolerance all stay.

    All stretches of one depth are measured together, as arrays. Degrees are scaled by the first point's latitude, both by
    the same length.
    """
    n = len(lon)
    if n < 3 or tolerance_m <= 0:
        return np.arange(n)
    unit = KM_A_DEGREE_EAST * 1000
    x, y = np.asarray(lon, float) * unit * np.cos(np.radians(lat[0])), np.asarray(lat, float) * unit
    kept = np.zeros(n, bool)
    kept[[0, -1]] = True
    low, high = np.array([0]), np.array([n - 1])
    while len(low):
        inner = high - low - 1
        first = np.cumsum(inner) - inner
        span = np.repeat(np.arange(len(low)), inner)
        at = np.arange(len(span)) - first[span] + low[span] + 1
        dx, dy = x[high] - x[low], y[high] - y[low]
        square = dx * dx + dy * dy
        px, py = x[at] - x[low][span], y[at] - y[low][span]
        along = np.clip((px * dx[span] + py * dy[span]) / np.where(square > 0, square, 1)[span], 0, 1)
        d = np.hypot(px - along * dx[span], py - along * dy[span])
        far = np.maximum.reduceat(d, first)
        tops = np.flatnonzero(d == far[span])
        best = at[tops[np.unique(span[tops], return_index=True)[1]]]
        cut = far > tolerance_m
        kept[best[cut]] = True
        low, high = np.concatenate([low[cut], best[cut]]), np.concatenate([best[cut], high[cut]])
        wide = high - low > 1
        low, high = low[wide], high[wide]
    return np.flatnonzero(kept)


def decimal_text(x: Column, digits: int = 7) -> Column:
    """A number rounded to ``digits`` decimals (ties to even) as JSON writers give a double: 5.0, -0.25, 1.5e-05; zero has no sign."""
    exact = (F.bround(x, digits).try_cast(f"decimal(30,{digits})") * 10**digits).cast("long")
    # degrees are exact enough as doubles, but for those near a tie
    scaled = x.cast("double") * 10**digits
    sure = (F.abs(scaled) < 2e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-5)
    units = F.when(sure, F.rint(scaled).cast("long")).otherwise(exact)
    size = F.abs(units)
    fraction = F.rtrim(F.lpad((size % 10**digits).cast("string"), digits, "0"), F.lit("0"))
    plain = F.concat(((size - size % 10**digits) / 10**digits).cast("long").cast("string"), F.lit("."), F.when(fraction == "", "0").otherwise(fraction))
    shown = F.rtrim(size.cast("string"), F.lit("0"))
    mantissa = F.concat(F.substring(shown, 1, 1), F.when(F.length(shown) > 1, F.concat(F.lit("."), F.substring(shown, 2, digits))).otherwise(""))
    small = F.concat(mantissa, F.lit("e-"), F.lpad((digits + 1 - F.length(size.cast("string"))).cast("string"), 2, "0"))
    # writers turn to powers of ten below 0.0001
    text = F.when((size > 0) & (size < 10 ** (digits - 4)), small).otherwise(plain)
    return F.concat(F.when(units < 0, "-").otherwise(""), text)


def point_json(lon: Column, lat: Column) -> Column:
    """A point as JSON in seven decimals."""
    return F.concat(F.lit("["), decimal_text(lon), F.lit(","), decimal_text(lat), F.lit("]"))


def undirected_json(points: Column) -> Column:
    """Points (lon, lat) as JSON in seven decimals, in that of both directions whose text comes first."""
    return undirected_texts(F.transform(points, lambda p: point_json(p["lon"], p["lat"])))


def undirected_texts(texts: Column) -> Column:
    """The same of points that are JSON already."""
    joined = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    return F.least(joined(texts), joined(F.reverse(texts)))


def geometry_id(geometry: Column) -> Column:
    """The id of a line of either direction, from its JSON."""
    return F.concat(F.lit("geom-"), F.substring(F.sha2(geometry, 256), 1, 32))
