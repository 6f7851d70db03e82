"""Residual statistics, outlier flags and their summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadsig.functions.calendar import year_month
from loadsig.functions.signature import changepoint_eval
from loadsig.session import materialise

# Fixed value: two-sided 95 % limit of the normal distribution.
Z95 = 1.96


def attach_params(df: DataFrame, params: DataFrame, key: str = "DATE_hour_week") -> DataFrame:
    """Left join of model parameters on building and model key.

    No broadcast hint: Spark broadcasts the table when its size is below the
    session's threshold and otherwise shuffles on both keys, which spreads a
    large building over its model keys.
    """
    return df.join(params, ["building_id", key], "left")


def score_readings(df: DataFrame, params: DataFrame) -> DataFrame:
    """Fitted load and residual from hour-of-week parameters; missing weather
    gives a null fit here."""
    return changepoint_eval(attach_params(df, params), on_missing="null")


def residual_stats(
    df: DataFrame, keys: list[str] | tuple[str, ...] = ("building_id",), threshold: float = Z95, ddof: int = 0
) -> DataFrame:
    """Mean, standard deviation and threshold of the residuals of each group."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    r = F.col("Power_residuals")
    return df.groupBy(*keys).agg(
        F.count(r).alias("n_residuals"),
        F.avg(r).alias("mean_residual"),
        std(r).alias("std_residual"),
        (F.lit(threshold) * std(r)).alias("threshold"),
    )


def flag_outliers(df: DataFrame, scope: str = "global", keys: list[str] | None = None,
                  threshold: float | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Flag residuals far from the mean of their group.

    ``scope="global"``: population deviation over the building, 1.96 sigma,
    column ``is_outlier_global``. ``scope="group"``: sample deviation within
    ``keys``, 2 sigma, column ``is_outlier_group``. A null residual or an
    undefined deviation is not an outlier.

    The moments are aggregated map-side and joined back, so no window gathers
    a building in one task. They are written once (or given as ``stats``), so
    Spark knows their size: below its threshold they are broadcast and the
    readings stay where they are.
    """
    if scope == "global":
        keys, ddof, name = keys or ["building_id"], 0, "is_outlier_global"
        threshold = Z95 if threshold is None else threshold
    elif scope == "group":
        keys, ddof, name = keys or ["building_id", "DATE_hour_week"], 1, "is_outlier_group"
        threshold = 2.0 if threshold is None else threshold
    else:
        raise ValueError(f"scope must be 'global' or 'group', not {scope!r}")
    if stats is None:
        stats = materialise(residual_stats(df, keys, threshold, ddof), "moments")
    stats = stats.select(*keys, "mean_residual", "threshold")
    far = F.abs(F.col("Power_residuals") - F.col("mean_residual")) > F.col("threshold")
    return (
        df.join(stats, keys, "left")
        .withColumn(name, F.coalesce(far, F.lit(False)))
        .drop("mean_residual", "threshold")
    )


def outliers_by_month(df: DataFrame, flag: str = "is_outlier_global") -> DataFrame:
    """Outliers, rows and share per building and month; rows without a date
    form a month of their own. The scaled share runs up to the largest count."""
    by_month = (
        df.groupBy("building_id", year_month("DATE").alias("Month"))
        .agg(F.sum(F.col(flag).cast("long")).alias("Sum_IS_Outlier"), F.count(F.lit(1)).alias("Total_Count"))
        .withColumn("Percentage_IS_Outlier", F.col("Sum_IS_Outlier") / F.col("Total_Count") * 100.0)
    )
    top = F.max("Sum_IS_Outlier").over(Window.partitionBy("building_id"))
    scale = F.when(top > 0, top).otherwise(1) / 100.0
    return by_month.withColumn("Scaled_Percentage", F.col("Percentage_IS_Outlier") * scale)


def residual_range(df: DataFrame) -> DataFrame:
    r = F.col("Power_residuals")
    return df.groupBy("building_id").agg(
        F.min(r).alias("lo"), F.max(r).alias("hi"), F.count(r).alias("n"),
        F.avg(r).alias("mean_residual"), F.stddev_pop(r).alias("std_residual"),
    )


def residual_histogram(df: DataFrame, bins: int = 300) -> DataFrame:
    """Equal-width density histogram of the residuals of each building.

    All bins are returned, empty ones with 0. A building with one distinct
    residual is binned over one unit around it.
    """
    stats = materialise(residual_range(df), "ranges")
    flat = F.col("lo") == F.col("hi")
    stats = stats.select(
        "building_id", "n",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    position = F.floor((F.col("Power_residuals") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    filled = (
        df.filter(F.col("Power_residuals").isNotNull())
        .select("building_id", "Power_residuals")
        .join(stats, "building_id")
        .groupBy("building_id", F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    frame = stats.filter("n > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    count = F.coalesce("count", F.lit(0))
    return frame.join(filled, ["building_id", "bin"], "left").select(
        "building_id", "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        count.cast("long").alias("count"),
        (count / (F.col("n") * width)).alias("density"),
    )


def residual_normal_curve(df: DataFrame, points: int = 500) -> DataFrame:
    """Normal density over the range of the residuals, with the 95 % limits."""
    sd = F.when(F.col("std_residual") > 0, F.col("std_residual")).otherwise(1e-9)
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    z = (F.col("x") - F.col("mean_residual")) / F.col("sd")
    return (
        residual_range(df)
        .filter("n > 0")
        .withColumn("sd", sd)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x)
        .select(
            "building_id", "i", "x",
            (F.exp(F.lit(-0.5) * z * z) / (F.col("sd") * math.sqrt(2 * math.pi))).alias("density"),
            (F.col("mean_residual") - Z95 * F.col("sd")).alias("ci_lower"),
            (F.col("mean_residual") + Z95 * F.col("sd")).alias("ci_upper"),
        )
    )


def inspect_outliers(df: DataFrame, flag: str = "is_outlier_global") -> DataFrame:
    """The columns behind the outlier scatter views."""
    return df.select("building_id", "DATE", "Power", "Power_fitted", "Temperature", F.col(flag).alias("IS_Outlier"))


def inspect_repairs(df: DataFrame) -> DataFrame:
    """The columns behind the repair scatter views."""
    return df.select("building_id", "DATE", "Power", "Power_corrected", "Temperature", "IS_Repaired")
