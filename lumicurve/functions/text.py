"""Scalar functions on names, keys, logs and packed bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_KEY = r"(\d{8}_\d{2}\.\d{2}\.\d{2}\.\d{3})"


def minute_key(name: Column) -> Column:
    """The minute key in a file or folder name; null without one."""
    return F.nullif(F.regexp_extract(name, MINUTE_KEY, 1), F.lit(""))


def key_time(key: Column) -> Column:
    """Time stamp of a minute key, null if it is none."""
    return F.try_to_timestamp(key, F.lit("yyyyMMdd_HH.mm.ss.SSS"))


def to_minute_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HH.mm.ss.SSS")


def hyphenated(obsdate: Column) -> Column:
    """yyyyMMdd as yyyy-MM-dd."""
    return F.date_format(F.try_to_timestamp(obsdate, F.lit("yyyyMMdd")), "yyyy-MM-dd")


def slashed(obsdate: Column) -> Column:
    return F.date_format(F.try_to_timestamp(obsdate, F.lit("yyyyMMdd")), "yyyy/MM/dd")


def repaired_hour(iso: Column) -> Column:
    """An ISO time whose hour may be over 23, with the hour modulo 24."""
    hour = F.regexp_extract(iso, r"T(\d{2})", 1)
    fixed = F.format_string("T%02d", F.pmod(F.coalesce(hour.try_cast("int"), F.lit(0)), F.lit(24)))
    return F.when(hour.try_cast("int") > 23, F.regexp_replace(iso, r"T\d{2}", fixed)).otherwise(iso)


def log_time(line: Column) -> Column:
    """Time stamp at the start of an observatory log line: weekday, month, day,
    time, zone (taken as UTC) and year."""
    rest = F.regexp_extract(line, r"^\w{3} (\w{3} \d{2} \d{2}:\d{2}:\d{2}) \w+ (\d{4})", 0)
    parts = F.concat_ws(" ", F.regexp_extract(rest, r"^\w{3} (\w{3} \d{2} \d{2}:\d{2}:\d{2})", 1), F.regexp_extract(rest, r"(\d{4})$", 1))
    return F.try_to_timestamp(parts, F.lit("MMM dd HH:mm:ss yyyy"))


def unpack12(data: Column) -> Column:
    """12-bit pixels of packed bytes: three bytes hold two pixels, high bits
    first; the middle byte's high half belongs to the first pixel."""
    byte = lambda k: F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("int")

    def two(k: Column) -> Column:
        a, b, c = (byte((k * 3 + o).cast("int")) for o in (1, 2, 3))
        return F.array(F.shiftleft(a, 4) + F.shiftright(b, 4), F.shiftleft(b.bitwiseAND(F.lit(15)), 8) + c)

    return F.flatten(F.transform(F.sequence(F.lit(0), (F.octet_length(data) / 3).cast("int") - 1), two))


def little_endian(data: Column, offset: int, size: int) -> Column:
    """An unsigned integer of ``size`` bytes at an offset."""
    digits = [F.hex(F.substring(data, offset + k, 1)) for k in range(size, 0, -1)]
    return F.conv(F.concat(*digits), 16, 10).cast("long")
