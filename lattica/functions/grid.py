"""Expressions of map tiles, boxes and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a degree of latitude on a sphere, and by the two estimates of area.
METRES_PER_DEGREE = 111_320.0
METRES_PER_DEGREE_NORTH = 110_540.0
KM_PER_DEGREE = 111.32
#: The seven stops of the change scale, red, green and blue.
VIRIDIS = ((68, 1, 84), (72, 40, 120), (62, 74, 137), (47, 105, 141), (39, 133, 133), (92, 156, 89), (181, 172, 39))


def tile_lon(x: Column, z: Column) -> Column:
    return x / F.pow(F.lit(2.0), z) * 360.0 - 180.0


def tile_lat(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * y / F.pow(F.lit(2.0), z)))))


def tile_x(lon: Column, z: Column) -> Column:
    """Column of the map tile that holds a longitude."""
    return F.floor((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), z))


def tile_y(lat: Column, z: Column) -> Column:
    """Row of the map tile that holds a latitude."""
    t = F.tan(F.radians(lat))
    inverse = F.signum(t) * F.asinh(F.abs(t))  # Spark's own is -inf for large negative numbers, as at the south pole
    return F.floor((1 - inverse / 3.141592653589793) / 2 * F.pow(F.lit(2.0), z))


def pyramid_level(zoom: Column) -> Column:
    """Coarser by one level for two steps of zoom below 14."""
    return F.greatest(F.lit(0), F.least(F.lit(5), F.floor((F.lit(14) - zoom) / 2))).cast("int")


def box_around(lat: Column, lon: Column, width_km: float, height_km: float) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north of a box around a place."""
    half_lat = F.lit(height_km / 2 / KM_PER_DEGREE)
    half_lon = F.lit(width_km / 2) / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat)))
    return lon - half_lon, lat - half_lat, lon + half_lon, lat + half_lat


def estimated_mb(west: Column, south: Column, east: Column, north: Column, years: Column) -> Column:
    """Size of a viewport's vectors on disk."""
    middle = (south + north) / 2
    across = (east - west) * METRES_PER_DEGREE * F.cos(F.radians(middle)) / 10
    down = (north - south) * METRES_PER_DEGREE_NORTH / 10
    return across * down * 128 * 4 * 0.4 / 1048576 * 3 * years


def viridis(v: Column, channel: int) -> Column:
    """One channel of the colour of a value, clamped to 0..1."""
    stops = F.array(*(F.lit(s[channel]) for s in VIRIDIS))
    last = len(VIRIDIS) - 1
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * last
    k = F.least(F.floor(at), F.lit(last - 1)).cast("int")
    low, high = F.element_at(stops, k + 1), F.element_at(stops, k + 2)
    return F.floor(low + (high - low) * (at - k)).cast("int")


def css_channel(colour: Column, channel: int) -> Column:
    """One channel, 0 to 1, of #rrggbb, #rgb or rgb(); null for anything else."""
    long_, short = r"^#([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})$", r"^#([0-9a-fA-F])([0-9a-fA-F])([0-9a-fA-F])$"
    named = r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    part = lambda p: F.regexp_extract(colour, p, channel + 1)
    value = (
        F.when(colour.rlike(long_), F.conv(part(long_), 16, 10).cast("double"))
        .when(colour.rlike(short), F.conv(F.concat(part(short), part(short)), 16, 10).cast("double"))
        .when(colour.rlike(named), part(named).try_cast("double"))
    )
    return value / 255.0


def palette_index(code: Column, size: int = 20) -> Column:
    """Place in a palette by the 31-hash of a code, in 32-bit arithmetic."""
    letters = F.filter(F.split(code, ""), lambda x: x != "")
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    hashed = F.aggregate(letters, F.lit(0).cast("long"), lambda h, x: wrap(h * 31 + F.ascii(x)))
    return F.pmod(F.abs(hashed), F.lit(size)).cast("int")


def place_key(lat: Column, lon: Column) -> Column:
    """A place to six decimals, by which points of two sources meet."""
    return F.format_string("%.6f,%.6f", lat, lon)
