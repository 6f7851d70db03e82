"""Readings derived from the shared test tables.

Power is taken from the tables. Weather and holidays are integer arithmetic on
the calendar, so that any engine computes the same values to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadsig.functions.calendar import compose_timestamp, truncate_hour
from loadsig.sources.readings import READING_COLUMNS


def _weather(df: DataFrame) -> DataFrame:
    dy, hh = F.dayofyear("DATE"), F.hour("DATE")
    hidx = (dy - 1) * 24 + hh
    temperature = ((dy * 13 + hh * 7) % 45) * F.lit(1.0) - 12.5
    irradiation = F.when(hh.between(6, 18), ((dy * 31 + hh * 17) % 80) * F.lit(10.0)).otherwise(0.0)
    return df.withColumns(
        {
            "Temperature": F.when(hidx % 211 != 7, temperature),
            "Solar_Irradiation": F.when(hidx % 307 != 11, irradiation),
            "Holiday": dy % 15 == 1,
        }
    ).select(READING_COLUMNS)


def events_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of ``events``, one building per event type and block of 150
    users. Hours without events are kept as rows with null power.

    A building's hours are made from its first and last one, so Spark sees a tiny
    table where there may be millions of rows. The hint keeps it from sending them
    all through the driver as a broadcast.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    power = (
        events.select(
            F.concat_ws("-", "event_type", F.expr("CAST(user_id div 150 AS string)")).alias("building_id"),
            truncate_hour("ts").alias("DATE"),
            F.col("value").cast("decimal(18,2)").alias("value"),
        )
        .groupBy("building_id", "DATE")
        .agg(F.sum("value").cast("double").alias("Power"))
    )
    span = power.groupBy("building_id").agg(F.min("DATE").alias("lo"), F.max("DATE").alias("hi"))
    hours = span.select("building_id", F.explode(F.expr("sequence(lo, hi, INTERVAL 1 HOUR)")).alias("DATE"))
    return _weather(hours.hint("merge").join(power, ["building_id", "DATE"], "left"))


def lineitem_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of ``lineitem`` over seven years, one building per 100
    suppliers. Hours without shipments have no row."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.to_date("l_shipdate")
    power = (
        items.select(
            F.expr("concat('site-', CAST(l_suppkey div 100 AS string))").alias("building_id"),
            compose_timestamp(
                F.year(day), F.month(day), F.dayofmonth(day), (F.col("l_orderkey") % 24).cast("int")
            ).alias("DATE"),
            F.col("l_quantity").cast("decimal(18,2)").alias("value"),
        )
        .groupBy("building_id", "DATE")
        .agg(F.sum("value").cast("double").alias("Power"))
    )
    return _weather(power)
