"""Geo sets: 52-bit interleaved scores, geohashes, distances and area searches, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import Refused

# The earth's radius in metres, the latitude limit of the projection, units and the alphabet.
RADIUS, MAX_LAT, BITS = 6372797.560856, 85.05112878, 26
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _steps(x: Column, steps: list[tuple[int, int]], spread: bool) -> Column:
    """Shift-and-mask steps as a fold: written out, each step would double the expression."""
    plan = F.array(*[F.struct(F.lit(shift).alias("by"), F.lit(mask).alias("mask")) for shift, mask in steps])
    move = "shiftleft" if spread else "shiftrightunsigned"
    return F.aggregate(plan, x, lambda v, s: v.bitwiseOR(F.call_function(move, v, s["by"])).bitwiseAND(s["mask"]))


def _spread(x: Column) -> Column:
    """The low 26 bits of a long, one free bit between neighbours."""
    return _steps(x.cast("long"), [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)], True)


def _gather(x: Column) -> Column:
    return _steps(x.bitwiseAND(F.lit(0x5555555555555555)), [(1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)], False)


def _cell(v: Column, low: float, high: float) -> Column:
    return F.least(F.floor((v - low) / (high - low) * (1 << BITS)).cast("long"), F.lit((1 << BITS) - 1))


def score(lon: Column, lat: Column, max_lat: float = MAX_LAT) -> Column:
    """Longitude in the odd bits, latitude in the even ones; null outside the projection."""
    inside = lon.between(-180, 180) & lat.between(-max_lat, max_lat)
    return F.when(inside, F.shiftleft(_spread(_cell(lon, -180, 180)), 1).bitwiseOR(_spread(_cell(lat, -max_lat, max_lat))))


def position(s: Column) -> Column:
    """(lon, lat) of the middle of a score's cell."""
    at = lambda x, low, high: F.lit(low) + (x + 0.5) / float(1 << BITS) * (high - low)
    return F.struct(at(_gather(F.shiftrightunsigned(s, 1)), -180.0, 180.0).alias("lon"), at(_gather(s), -MAX_LAT, MAX_LAT).alias("lat"))


def geohash(s: Column) -> Column:
    """Eleven characters of the standard geohash (latitude to 90 degrees) of a score's position; the last is 0."""
    p = position(s)
    bits = score(p["lon"], p["lat"], 90.0)
    chars = [F.substring(F.lit(ALPHABET), F.shiftrightunsigned(bits, 52 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(1, 11)]
    return F.concat(*chars, F.lit("0"))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """Haversine."""
    if unit not in UNITS:
        raise Refused(f"unit {unit}")
    a, b = F.radians(lat1), F.radians(lat2)
    u, v = F.sin((b - a) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return F.lit(2 * RADIUS / UNITS[unit]) * F.asin(F.sqrt(u * u + F.cos(a) * F.cos(b) * v * v))


def add(df: DataFrame) -> DataFrame:
    """(key, member, lon, lat) -> with score, and lon and lat moved to the middle of their cell."""
    s = df.withColumn("score", score(F.col("lon"), F.col("lat"))).where(F.col("score").isNotNull())
    p = position(F.col("score"))
    return s.withColumns({"lon": p["lon"], "lat": p["lat"]})


def dist(df: DataFrame, a: str, b: str, unit: str = "m") -> DataFrame:
    """Distance of two members of one set; no row unless both are there."""
    one, two = (df.where(F.col("member") == m).select(F.col("lon").alias(f"lon{k}"), F.col("lat").alias(f"lat{k}")) for k, m in ((1, a), (2, b)))
    return one.crossJoin(F.broadcast(two)).select(distance(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"), unit).alias("dist"))


def search(df: DataFrame, lon: float, lat: float, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", count: int | None = None, desc: bool | None = None) -> DataFrame:
    """Members within a radius, or a box of width and height, round a point, with `dist`.

    Limits of longitude and latitude on plain columns come first (they prune), then the exact test.
    """
    if (radius is None) == (box is None):
        raise Refused("give BYRADIUS or BYBOX")
    half_h = (radius if box is None else box[1] / 2) * UNITS[unit]
    half_w = (radius if box is None else box[0] / 2) * UNITS[unit]
    d_lat = math.degrees(half_h / RADIUS)
    far = min(89.9, abs(lat) + d_lat)
    d_lon = min(180.0, math.degrees(half_w / RADIUS / math.cos(math.radians(far))) * 1.01 + 1e-6)
    rows = df.where(F.col("lat").between(lat - d_lat - 1e-9, lat + d_lat + 1e-9))
    if lon - d_lon >= -180 and lon + d_lon <= 180:
        rows = rows.where(F.col("lon").between(lon - d_lon, lon + d_lon))
    here = (F.lit(lon), F.lit(lat))
    rows = rows.withColumn("dist", distance(*here, F.col("lon"), F.col("lat"), unit))
    if box is None:
        rows = rows.where(F.col("dist") <= radius)
    else:
        rows = rows.where((distance(F.lit(lon), F.col("lat"), F.col("lon"), F.col("lat"), unit) <= box[0] / 2) & (distance(*here, F.lit(lon), F.col("lat"), unit) <= box[1] / 2))
    if desc is not None or count is not None:
        rows = rows.orderBy(F.col("dist").desc() if desc else F.col("dist").asc(), "member")
    return rows if count is None else rows.limit(count)


def store(found: DataFrame, key: str, with_dist: bool = False) -> DataFrame:
    """A search's result as a sorted set (key, member, score): scores are cells, or distances in the search's unit."""
    return found.select(F.lit(key).alias("key"), "member", F.col("dist" if with_dist else "score").cast("double").alias("score"))


def search_by_member(df: DataFrame, member: str, **area) -> DataFrame:
    """The same round a member; no row if it isn't there. One row is read first: its position bounds the scan."""
    at = df.where(F.col("member") == member).select("lon", "lat").first()
    return search(df, at.lon, at.lat, **area) if at else df.withColumn("dist", F.lit(0.0)).limit(0)
