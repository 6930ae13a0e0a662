"""Dates, seasons and collection windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CUTOVER_MONTH


def match_date(text: Column) -> Column:
    """dd/MM/yyyy, dd/MM/yy, then ISO and dotted or dashed day-first dates; null if none fits.

    Two-digit years from 69 on are of the last century.
    """
    t = F.trim(text)
    short = F.to_date(F.try_to_timestamp(t, F.lit("d/M/yy")))
    century = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    forms = [F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.to_date(F.try_to_timestamp(t, F.lit("d/M/yyyy")))), F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), century)]
    forms += [F.when(t.rlike(shape), F.to_date(F.try_to_timestamp(t, F.lit(form)))) for shape, form in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"))]
    return F.coalesce(*forms)


def season_start(date: Column, cutover: int = CUTOVER_MONTH) -> Column:
    """The year in which the season of a date began."""
    return F.year(date) - (F.month(date) < cutover).cast("int")


def season_label(start_year: Column) -> Column:
    return F.format_string("%d/%02d", start_year, F.pmod(start_year + 1, F.lit(100)))


def season_code(start_year: Column) -> Column:
    return F.format_string("%02d%02d", F.pmod(start_year, F.lit(100)), F.pmod(start_year + 1, F.lit(100)))


def kickoff(date: Column, time: Column, zone: Column | str = "UTC") -> Column:
    """The UTC instant of a local date and HH:MM time; midnight where there is no time."""
    local = F.coalesce(F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), time), F.lit("yyyy-MM-dd HH:mm")), date.cast("timestamp"))
    return F.to_utc_timestamp(local, zone)


def decay(date: Column, as_of: Column, half_life: float) -> Column:
    """The weight of a match by its age; 1 without a half-life."""
    if half_life <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(F.datediff(as_of, date), F.lit(0)) / F.lit(float(half_life)))


def collection_window(fixture_date: Column) -> Column:
    """struct<window, collected_at>: Friday to Monday is collected on the Friday at 17:00 London time, Tuesday
    to Thursday on the Tuesday at 13:00; collected_at is in UTC."""
    day = F.weekday(fixture_date)  # Monday is 0
    weekend = day.isin(4, 5, 6, 0)
    since = F.pmod(day - F.when(weekend, 4).otherwise(1), F.lit(7))
    local = F.date_sub(fixture_date, since).cast("timestamp") + F.when(weekend, F.expr("interval 17 hours")).otherwise(F.expr("interval 13 hours"))
    return F.struct(F.when(weekend, "weekend").otherwise("midweek").alias("window"), F.to_utc_timestamp(local, "Europe/London").alias("collected_at"))
