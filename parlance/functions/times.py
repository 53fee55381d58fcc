"""Functions of times, durations, dates and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.words import col


def clock(ms: Column | str, point: str = ",") -> Column:
    """HH:MM:SS,mmm of milliseconds."""
    ms = col(ms)
    part = lambda unit, of: F.floor(ms / unit) % of if of else F.floor(ms / unit)
    return F.format_string(f"%02d:%02d:%02d{point}%03d", part(3_600_000, 0).cast("long"), part(60_000, 60).cast("long"), part(1000, 60).cast("long"), (ms % 1000).cast("long"))


def from_clock(text: Column | str) -> Column:
    """Milliseconds of H:M:S,mmm or H:M:S.mmm; null if it isn't one."""
    found = lambda k: F.regexp_extract(col(text), r"^\s*(\d+):(\d+):(\d+)[,.](\d+)\s*$", k)
    value = found(1).try_cast("long") * 3_600_000 + found(2).try_cast("long") * 60_000 + found(3).try_cast("long") * 1000 + found(4).try_cast("long")
    return value


def iso_duration(text: Column | str) -> Column:
    """Milliseconds of PT#H#M#S, cut off; parts may be missing."""
    part = lambda unit: F.coalesce(F.regexp_extract(col(text), rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("decimal(20,6)"), F.lit(0))
    ms = part("H") * 3_600_000 + part("M") * 60_000 + part("S") * 1000
    return F.when(col(text).startswith("PT"), F.floor(ms).cast("long"))


def day_of(text: Column | str) -> Column:
    """A date of DD-MON-YYYY; null if it isn't one."""
    return F.to_date(F.try_to_timestamp(F.initcap(F.lower(col(text))), F.lit("dd-MMM-yyyy")))


def age_between(birth: Column | str, day: Column | str) -> Column:
    """Y;M.D from one day to another, days borrowed from the month before; null if it is negative."""
    birth, day = col(birth), col(day)
    months = (F.year(day) - F.year(birth)) * 12 + F.month(day) - F.month(birth)
    short = F.dayofmonth(day) < F.dayofmonth(birth)
    whole = months - F.when(short, 1).otherwise(0)
    lent = F.dayofmonth(F.last_day(F.add_months(day, -1)))
    days = F.dayofmonth(day) - F.dayofmonth(birth) + F.when(short, lent).otherwise(0)
    return F.when(day >= birth, F.format_string("%d;%02d.%02d", F.floor(whole / 12).cast("int"), (whole % 12).cast("int"), days.cast("int")))


def age_in_months(age: Column | str) -> Column:
    """Y*12+M of Y;M.D; the whole middle of two ages joined by -."""
    one = lambda x: F.regexp_extract(x, r"^\s*(\d+)", 1).try_cast("int") * 12 + F.coalesce(F.regexp_extract(x, r";(\d+)", 1).try_cast("int"), F.lit(0))
    a, b = one(F.substring_index(col(age), "-", 1)), one(F.substring_index(col(age), "-", -1))
    return F.when(F.contains(col(age), F.lit("-")), F.floor((a + b) / 2).cast("int")).otherwise(a)
