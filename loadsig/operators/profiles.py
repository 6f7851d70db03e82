"""Day profiles: 24-hour vectors of each building and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = "DATE_YYYY_MM_DD"
HOURS = list(range(24))
POWER_COLUMNS = [f"Power_{h:02d}" for h in HOURS]
# Export names of the hour columns.
EXPORT_COLUMNS = [f"Power.{h}" for h in HOURS]


def day_matrix(df: DataFrame, value: str = "Power_corrected") -> DataFrame:
    """One row per building and day with 24 hour columns and the day's ordinal.

    The hours are known, so this is one aggregation with 24 conditional
    columns, combined map-side. There is one reading per hour, so any aggregate
    returns it. Days without any value do not appear.
    """
    hour = F.hour("DATE")
    cells = [F.max(F.when(hour == h, F.col(value))).alias(c) for h, c in zip(HOURS, POWER_COLUMNS)]
    return (
        df.groupBy("building_id", F.to_date("DATE").alias(DAY))
        .agg(*cells)
        .filter(F.coalesce(*POWER_COLUMNS).isNotNull())
    )


def day_index(days: DataFrame) -> DataFrame:
    """Ordinal of each day within its building, from 0, incomplete days included.

    The window holds one row per day of a building (366 a year).
    """
    order = Window.partitionBy("building_id").orderBy(DAY)
    return days.withColumn("day_index", F.row_number().over(order) - 1)


def complete_days(days: DataFrame) -> DataFrame:
    return days.na.drop("any", subset=POWER_COLUMNS)


def normalise_vectors(points: DataFrame) -> DataFrame:
    """Scale each profile to 0 .. 1 over its own range; a constant day becomes 0."""
    lo, span = F.col("_lo"), F.col("_hi") - F.col("_lo")
    scaled = F.transform("profile", lambda x: F.when(span == 0, F.lit(0.0)).otherwise((x - lo) / span))
    return (
        points.withColumns({"_lo": F.array_min("profile"), "_hi": F.array_max("profile")})
        .withColumn("profile", scaled)
        .drop("_lo", "_hi")
    )


def wide_profiles(points: DataFrame) -> DataFrame:
    """Vectors back to 24 hour columns."""
    cells = [F.col("profile")[h].alias(c) for h, c in zip(HOURS, POWER_COLUMNS)]
    return points.select(*[c for c in points.columns if c != "profile"], *cells)


def first_days(days: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` days of each building, for the profile overview."""
    order = Window.partitionBy("building_id").orderBy(DAY)
    first = days.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
    return first.withColumn("day_index", F.col("_rank") - 1).drop("_rank")


def day_vectors(days: DataFrame) -> DataFrame:
    """Complete days as vectors: ``(building_id, day, profile array<double>)``."""
    return complete_days(days).select("building_id", DAY, F.array(*POWER_COLUMNS).alias("profile"))


def export_names(days: DataFrame) -> DataFrame:
    return days.withColumnsRenamed(dict(zip(POWER_COLUMNS, EXPORT_COLUMNS)))


def cluster_profiles(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean, spread and 5 % / 95 % quantiles of each day type and hour.

    One row per building and day enters, so the exact quantile of a group works
    on at most 366 values a year.
    """
    hour = F.posexplode("profile").alias("hour", "value")
    mean, std = F.avg("value"), F.stddev_samp("value")
    return points.select("building_id", cluster, hour).groupBy("building_id", cluster, "hour").agg(
        F.count(F.lit(1)).alias("n_days"),
        mean.alias("mean"),
        std.alias("std"),
        (mean - 1.96 * std).alias("lower"),
        (mean + 1.96 * std).alias("upper"),
        F.percentile("value", F.lit(0.05)).alias("q05"),
        F.percentile("value", F.lit(0.95)).alias("q95"),
    )
