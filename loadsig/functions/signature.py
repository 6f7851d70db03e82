"""The energy-signature (changepoint) model as column expressions."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMETERS = ["slope_Temp", "slope_Irrad", "intercept", "minimum"]
PARAMETER_DDL = "slope_Temp double, slope_Irrad double, intercept double, minimum double"

# The temperature range over which model lines are drawn [deg C],
# and the slope below which a line has no knot.
KNOT_COLD, KNOT_WARM = -50.0, 50.0
FLAT_SLOPE = 1e-8


def linear_part() -> Column:
    return (
        F.col("intercept")
        + F.col("slope_Temp") * F.col("Temperature")
        + F.col("slope_Irrad") * F.col("Solar_Irradiation")
    )


def signature(floor: bool = True, on_missing: str = "zero") -> Column:
    """Fitted load from the weather and parameter columns of the row.

    ``greatest`` skips nulls, so missing weather is handled explicitly:
    ``on_missing="zero"`` gives 0, ``"null"`` gives null. A row without
    parameters is always null. ``floor=False`` is the plain variant that takes
    the larger of line and minimum and nothing else.
    """
    if on_missing not in ("zero", "null"):
        raise ValueError(f"on_missing must be 'zero' or 'null', not {on_missing!r}")
    no_weather = F.col("Temperature").isNull() | F.col("Solar_Irradiation").isNull()
    no_model = F.lit(False)
    for name in PARAMETERS:
        no_model = no_model | F.col(name).isNull()
    value = F.greatest(F.col("minimum"), linear_part())
    if floor:
        value = F.greatest(value, F.lit(0.0))
    missing = F.lit(0.0) if on_missing == "zero" else F.lit(None).cast("double")
    return F.when(no_model, None).when(no_weather, missing).otherwise(value)


def changepoint_eval(
    df: DataFrame,
    fitted: str = "Power_fitted",
    residuals: str | None = "Power_residuals",
    floor: bool = True,
    on_missing: str = "zero",
) -> DataFrame:
    """Add the fitted value and the residual (fitted minus actual).

    A frame without weather columns is returned unchanged with a warning; a
    frame without ``Power`` gets null residuals.
    """
    absent = {"Temperature", "Solar_Irradiation"} - set(df.columns)
    if absent:
        warnings.warn(f"no fitted values: missing column(s) {sorted(absent)}")
        return df
    df = df.withColumn(fitted, signature(floor, on_missing))
    if residuals is None:
        return df
    if "Power" not in df.columns:
        warnings.warn("no Power column: residuals are null")
        return df.withColumn(residuals, F.lit(None).cast("double"))
    return df.withColumn(residuals, F.col(fitted) - F.col("Power"))


def changepoint_eval_plain(df: DataFrame, fitted: str) -> DataFrame:
    """Variant without the floor at zero; missing weather stays null."""
    return changepoint_eval(df, fitted, residuals=None, floor=False, on_missing="null")


def cluster_hour(cluster: str, hour: str = "DATE_hour_day") -> Column:
    """Key of a day-type model: day type times 100 plus hour of the day."""
    return F.col(cluster).cast("int") * 100 + F.col(hour)


def changepoint_knots(params: DataFrame) -> DataFrame:
    """The three points of each model line against temperature.

    Models without a parameter or with a flat line have no polyline.
    """
    slope = F.col("slope_Temp")
    usable = slope.isNotNull() & (F.abs(slope) >= FLAT_SLOPE)
    for name in ("intercept", "minimum"):
        usable = usable & F.col(name).isNotNull()
    return params.filter(usable).withColumns(
        {
            "x1": F.lit(KNOT_COLD),
            "y1": F.col("intercept") + slope * KNOT_COLD,
            "x2": F.try_divide(-(F.col("intercept") - F.col("minimum")), slope),
            "y2": F.col("minimum"),
            "x3": F.lit(KNOT_WARM),
            "y3": F.col("minimum"),
        }
    )
