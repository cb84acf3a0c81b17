"""Scalar expressions of wind analytics; null in gives null out unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def number(c: Column) -> Column:
    """c as a double; null where it is no number, NaN or infinite."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """c within bounds. Null stays null, which greatest and least alone would not do."""
    out = c if low is None else F.greatest(c, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def log_roughness(w10: Column, w100: Column) -> Column:
    """ln z0 from the speeds at 10 m and 100 m; null where shear is next to none or the result is not negative."""
    shear = w100 - w10
    z = (w100 * math.log(10.0) - w10 * math.log(100.0)) / shear
    return F.when((F.abs(shear) > 1e-4) & (z < 0), z)


def roughness(log_z0: Column) -> Column:
    return F.greatest(F.exp(clip(log_z0, math.log(1e-6), math.log(2.0))), F.when(log_z0.isNotNull(), F.lit(1e-6)))


def log_profile(w100: Column, height: Column, z0: Column) -> Column:
    """The speed at a height from that at 100 m; null where the profile is undefined."""
    floor = clip(z0, 1e-6)
    down = F.log(F.lit(100.0) / floor)
    return F.when(F.abs(down) > 1e-12, w100 * F.log(height / floor) / down)


def specific_power(kw: Column, diameter: Column) -> Column:
    """W per m2 of rotor."""
    return kw * 1000.0 / (F.lit(math.pi) * F.pow(diameter / 2.0, F.lit(2.0)))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def plane_km(lon: Column, lat: Column, mean_lat: Column) -> tuple[Column, Column]:
    """Equirectangular x and y in km about a mean latitude."""
    return F.radians(lon) * F.cos(F.radians(mean_lat)) * EARTH_KM, F.radians(lat) * EARTH_KM


def extracted_number(c: Column) -> Column:
    """The first number in a string, whose decimal sign may be a comma."""
    return F.regexp_extract(F.replace(c.cast("string"), F.lit(","), F.lit(".")), r"[-+]?\d*\.?\d+", 0).try_cast("double")


def capacity_mw(c: Column) -> Column:
    """MW of a string with a number and MW, kW or W; without a unit the number is MW."""
    x, s = extracted_number(c), c.cast("string")
    return F.when(s.rlike(r"(?i)\bMW\b"), x).when(s.rlike(r"(?i)\bkW\b"), x / 1000.0).when(s.rlike(r"\bW\b"), x / 1e6).otherwise(x)


def recode(c: Column, mapping: dict[str, str]) -> Column:
    """c with the mapping's keys replaced, other values as they are."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(pairs, c), c)


def domain(c: Column) -> Column:
    """onshore or offshore from the words, flags and digits that stand for them; other values in small letters."""
    known = {"land": "onshore", "inland": "onshore", "false": "onshore", "0": "onshore", "ocean": "offshore", "1": "offshore", "sea": "offshore", "true": "offshore"}
    return recode(F.lower(F.trim(c.cast("string"))), known)


def first_word(c: Column) -> Column:
    return F.split(F.trim(c), r"\s+")[0]


def stripped(c: Column, characters: str = "123-.,") -> Column:
    return F.btrim(c, F.lit(characters))


def utm_to_lonlat(east: Column, north: Column, zone: int = 32, northern: bool = True) -> tuple[Column, Column]:
    """WGS84 degrees of UTM metres, by Krueger's series to the third order in n (under a millimetre in a zone)."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (north - (0.0 if northern else 1e7)) / (0.9996 * big)
    eta = (east - 500000.0) / (0.9996 * big)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + F.lit(d) * F.sin(2 * j * chi)
    lon = F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (zone * 6 - 183)
    return lon, F.degrees(lat)


def to_lonlat(east: Column, north: Column, epsg: int) -> tuple[Column, Column]:
    """Degrees from WGS84, UTM (326zz, 327zz, 258zz), web Mercator or Lambert-93 coordinates; other systems raise ValueError."""
    if epsg == 4326:
        return east, north
    if 32601 <= epsg <= 32660 or 25828 <= epsg <= 25838:
        return utm_to_lonlat(east, north, epsg % 100)
    if 32701 <= epsg <= 32760:
        return utm_to_lonlat(east, north, epsg % 100, northern=False)
    if epsg == 3857:
        return F.degrees(east / 6378137.0), F.degrees(2 * F.atan(F.exp(north / 6378137.0)) - math.pi / 2)
    if epsg == 2154:
        n, c, xs, ys, e = 0.7256077650532670, 11754255.4260960, 700000.0, 12655612.0498760, 0.08181919106
        r = F.sqrt(F.pow(east - xs, 2) + F.pow(north - ys, 2))
        iso = -F.log(r / c) / n
        lat = 2 * F.atan(F.exp(iso)) - math.pi / 2
        for _ in range(6):
            s = F.lit(e) * F.sin(lat)
            lat = 2 * F.atan(F.pow((1 + s) / (1 - s), F.lit(e / 2)) * F.exp(iso)) - math.pi / 2
        return F.degrees(F.atan((east - xs) / (ys - north)) / n) + 3.0, F.degrees(lat)
    raise ValueError(f"unknown coordinate system: EPSG {epsg}")
