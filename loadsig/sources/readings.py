"""Meter readings: CSV ingest, normalisation, data-quality profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadsig.functions.calendar import add_calendar, compose_timestamp

RAW_SCHEMA = T.StructType(
    [
        T.StructField("Year", T.IntegerType()),
        T.StructField("Month", T.IntegerType()),
        T.StructField("Day_Month", T.IntegerType()),
        T.StructField("Hour_Day", T.IntegerType()),
        T.StructField("Power", T.DoubleType()),
        T.StructField("Temperature", T.DoubleType()),
        T.StructField("Solar.Irradiation", T.DoubleType()),
        T.StructField("Holiday", T.StringType()),
    ]
)
READING_COLUMNS = ["building_id", "DATE", "Holiday", "Temperature", "Solar_Irradiation", "Power"]
MEASURES = ["Temperature", "Solar_Irradiation", "Power"]


def read_readings(spark: SparkSession, paths: str | list[str], schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Read one or many ``;``-separated files with a header in one scan.

    Columns are found by the names in the header, in any order, and extra ones
    are left out; a column that is absent fails. Values that cannot be read as
    their type become null and are counted by ``unreadable_values``. Files of one
    call share one header. The building is the file name without its extension.
    A folder that Spark wrote with ``partitionBy("building_id")`` brings the
    column itself.
    """
    raw = _header_columns(spark, paths)
    columns = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema]
    if "building_id" in raw.columns:
        return raw.select(*columns) if "building_id" in schema.names else raw.select("building_id", *columns)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return raw.select(stem.alias("building_id"), *columns)


def _header_columns(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.option("sep", ";").option("header", True).option("enforceSchema", False).csv(paths)


def unreadable_values(spark: SparkSession, paths: str | list[str], schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """One row: per column, how many values are present but not of its type."""
    raw = _header_columns(spark, paths)
    bad = [F.count_if(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull()).alias(f.name)
           for f in schema if f.name in raw.columns]
    return raw.agg(*bad)


def join_weather(meter: DataFrame, weather: DataFrame, by_building: bool = True) -> DataFrame:
    """Meter readings with the weather of their hour from a table of its own
    (``DATE, Temperature, Solar_Irradiation``, and ``building_id`` unless one
    station serves all). Hours without weather keep null measures; of several
    weather rows of an hour the mean counts, so no reading is multiplied."""
    keys = ["building_id", "DATE"] if by_building else ["DATE"]
    measures = ["Temperature", "Solar_Irradiation"]
    hourly = weather.groupBy(keys).agg(*[F.avg(m).alias(m) for m in measures])
    return meter.drop(*measures).join(hourly, keys, "left").select(
        *[c for c in READING_COLUMNS if c in meter.columns or c in measures])


def union_buildings(frames: dict[str, DataFrame]) -> DataFrame:
    """One portfolio table from tables by name. A table without ``building_id`` is
    one building of that name; the buildings of one that has it become
    ``name/building``."""
    def named(name: str, df: DataFrame) -> DataFrame:
        own = F.concat(F.lit(f"{name}/"), F.col("building_id")) if "building_id" in df.columns else F.lit(name)
        return df.withColumn("building_id", own)

    parts = [named(name, df) for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def from_raw(df: DataFrame) -> DataFrame:
    """Raw columns to canonical readings with calendar marks."""
    stamped = df.withColumn("Date", compose_timestamp("Year", "Month", "Day_Month", "Hour_Day"))
    return add_calendar(format_readings(keep_on_the_hour(stamped, "Date")))


def keep_on_the_hour(df: DataFrame, date_col: str = "DATE") -> DataFrame:
    return df.filter(F.minute(date_col) == 0)


def format_readings(
    df: DataFrame,
    col_date: str = "Date",
    col_holiday: str = "Holiday",
    col_temperature: str = "Temperature",
    col_solar_irradiation: str = "Solar.Irradiation",
    col_power: str = "Power",
    holiday_null: bool = True,
) -> DataFrame:
    """Project to the canonical columns and types.

    NaN becomes null: Spark orders NaN above every number, which would turn a
    missing value into an outlier. An unknown holiday mark counts as
    ``holiday_null``. The irradiation column may already be spelled with an
    underscore.
    """
    if col_solar_irradiation not in df.columns:
        col_solar_irradiation = "Solar_Irradiation"

    def measure(name):
        number = F.col(f"`{name}`").try_cast("double")
        return F.when(~F.isnan(number), number)

    mark = F.col(f"`{col_holiday}`").cast("string")
    as_number = mark.try_cast("double")
    holiday = F.coalesce(mark.try_cast("boolean"), F.when(~F.isnan(as_number), as_number != 0), F.lit(holiday_null))
    columns = [
        F.col(f"`{col_date}`").cast("timestamp_ntz").alias("DATE"),
        holiday.alias("Holiday"),
        measure(col_temperature).alias("Temperature"),
        measure(col_solar_irradiation).alias("Solar_Irradiation"),
        measure(col_power).alias("Power"),
    ]
    key = ["building_id"] if "building_id" in df.columns else []
    return df.select(*key, *columns)


def require_unique_hours(df: DataFrame) -> DataFrame:
    """Fail on a second reading of the same building and hour. Rows without a
    time repeat nothing.

    Later operators rely on it: it bounds every group of one building by the
    calendar (at most 8,784 rows a year).
    """
    twice = df.filter(F.col("DATE").isNotNull()).groupBy("building_id", "DATE").count().filter("count > 1").take(1)
    if twice:
        raise ValueError(f"more than one reading for {twice[0]['building_id']} at {twice[0]['DATE']}")
    return df


def regularize(df: DataFrame) -> DataFrame:
    """Insert absent hours between the first and last hour of each building
    as rows with null measures. Optional step before a repair."""
    span = df.groupBy("building_id").agg(F.min("DATE").alias("lo"), F.max("DATE").alias("hi"))
    hours = span.select("building_id", F.explode(F.expr("sequence(lo, hi, INTERVAL 1 HOUR)")).alias("DATE"))
    return hours.join(df, ["building_id", "DATE"], "left").select(df.columns)


def profile_readings(df: DataFrame, columns: list[str] = MEASURES + ["Holiday"]) -> DataFrame:
    """Rows, first and last year, and missing values of each building; one pass."""
    missing = [F.sum(F.col(c).isNull().cast("long")).alias(f"missing_{c}") for c in columns]
    out = df.groupBy("building_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.year("DATE")).alias("min_year"),
        F.max(F.year("DATE")).alias("max_year"),
        *missing,
    )
    total = sum((F.col(f"missing_{c}") for c in columns), F.lit(0))
    return out.withColumns({"n_columns": F.lit(len(df.columns)), "missing_total": total})
