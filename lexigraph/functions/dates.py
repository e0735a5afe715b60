"""Local dates and times against UTC as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How far ahead a schedule's default slot lies, in minutes, and how times are shown.
DEFAULT_SLOT_MINUTES, SHOWN = 5, "yyyy-MM-dd HH:mm"


def to_local(utc: Column, zone: str) -> Column:
    return F.from_utc_timestamp(utc, zone)


def shown(utc: Column, zone: str = "UTC") -> Column:
    return F.coalesce(F.date_format(to_local(utc, zone), SHOWN), F.lit("Unknown"))


def local_to_utc(day: Column, time: Column, zone: str) -> Column:
    """A date and an HH:mm[:ss] text in a zone, as a UTC time; null where they make none."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.when(F.length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time))), zone)


def default_slot(now: Column | None = None) -> Column:
    return (F.current_timestamp() if now is None else now) + F.expr(f"INTERVAL {DEFAULT_SLOT_MINUTES} MINUTES")
