"""Values of camera metadata, given as strings: offsets, capture times, rationals, coordinates. What can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The format of capture times.
TIME_FORMAT = "yyyy:MM:dd HH:mm:ss"


def offset_seconds(raw: Column) -> Column:
    """Seconds east of UTC of ``Z`` or ``+09:00``."""
    text = F.trim(raw)
    hours, minutes = (F.regexp_extract(text, r"^[+-](\d{2}):(\d{2})$", i).try_cast("int") for i in (1, 2))
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    return F.when(text == "Z", 0).when((hours <= 23) & (minutes <= 59), sign * (hours * 3600 + minutes * 60))


def captured_at(raw: Column, offset: Column, fallback_seconds: Column) -> Column:
    """(t, lt): instant and wall clock in microseconds; a missing or empty offset gives way to the fallback."""
    lt = F.unix_micros(F.try_to_timestamp(F.concat(F.trim(raw), F.lit(" Z")), F.lit(TIME_FORMAT + " X")))
    east = F.when(F.coalesce(offset, F.lit("")) == "", fallback_seconds).otherwise(offset_seconds(offset))
    return F.when(lt.isNotNull() & east.isNotNull(), F.struct((lt - east.cast("long") * 1_000_000).alias("t"), lt.alias("lt")))


def number(value: Column) -> Column:
    """A plain number or a rational ``2234/100``; a zero denominator is no number."""
    parts = F.split(value, "/")
    return F.when(F.size(parts) == 1, F.trim(value).try_cast("double")).when(F.size(parts) == 2, F.try_divide(F.trim(parts[0]).try_cast("double"), F.trim(F.get(parts, 1)).try_cast("double")))


def coordinate(dms: Column, hemisphere: Column) -> Column:
    """Signed degrees of ``35/1, 41/1, 2234/100`` and N, S, E or W."""
    parts = F.split(dms, ",")
    d, m, s = (number(F.get(parts, i)) for i in range(3))
    ref = F.upper(F.trim(hemisphere))
    sign = F.when(ref.isin("S", "W"), -1).when(ref.isin("N", "E"), 1)
    return F.when(F.size(parts) == 3, sign * (d + m / 60 + s / 3600))


def location(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column) -> Column:
    """(lat, lon) when both can be read and lie on the globe."""
    y, x = coordinate(lat, lat_ref), coordinate(lon, lon_ref)
    return F.when(y.between(-90, 90) & x.between(-180, 180), F.struct(y.alias("lat"), x.alias("lon")))
