"""Calendar expressions on a time-zone-free timestamp column.

All of them are built-in functions, so they stay inside whole-stage codegen and
do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOURS_PER_WEEK = 168


def compose_timestamp(year, month, day, hour) -> Column:
    """Timestamp from four integer columns (names or columns)."""
    return F.make_timestamp_ntz(year, month, day, hour, F.lit(0), F.lit(0))


def truncate_hour(ts) -> Column:
    """Start of the hour, without a detour through the session time zone."""
    ts = _col(ts)
    return compose_timestamp(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts))


def hour_number(ts) -> Column:
    """Whole hours since 1970-01-01; the numeric order key of all time frames."""
    ts = _col(ts)
    return (F.unix_date(F.to_date(ts)) * 24 + F.hour(ts)).cast("long")


def year_month(ts) -> Column:
    """``YYYY-MM`` label; null stays null."""
    return F.date_format(F.to_date(_col(ts)), "yyyy-MM")


def calendar_columns(ts) -> dict[str, Column]:
    """The calendar marks of one timestamp; Monday is day 0 of the week."""
    ts = _col(ts)
    day = F.to_date(ts)
    hour = F.hour(ts)
    return {
        "DATE_YYYY_MM_DD": day,
        "DATE_year": F.year(day),
        "DATE_month_year": F.month(day),
        "DATE_week_year": F.weekofyear(day),
        "DATE_day_year": F.dayofyear(day),
        "DATE_day_month": F.dayofmonth(day),
        "DATE_day_week": F.weekday(day),
        "DATE_hour_year": (F.dayofyear(day) - 1) * 24 + hour,
        "DATE_hour_week": F.weekday(day) * 24 + hour,
        "DATE_hour_day": hour,
        "DATE_weekday": F.weekday(day) < 5,
    }


def add_calendar(df: DataFrame, date_col: str = "DATE") -> DataFrame:
    """Add (or overwrite) every calendar mark."""
    return df.withColumns(calendar_columns(F.col(date_col)))


def date_marks(df: DataFrame, date_col: str = "DATE") -> DataFrame:
    """Name the time column ``DATE`` and add only the marks that are absent."""
    if date_col != "DATE":
        df = df.withColumnRenamed(date_col, "DATE")
    marks = calendar_columns(F.col("DATE"))
    return df.withColumns({k: v for k, v in marks.items() if k not in df.columns})


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
