"""Comparison of the load models and views by climate period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadsig.functions.signature import PARAMETERS, changepoint_eval_plain, cluster_hour
from loadsig.operators.chunks import CHUNK_ROWS, chunked, own_rows
from loadsig.operators.outliers import attach_params
from loadsig.session import materialise

# The three models compared, and the working columns that are
# dropped before the comparison.
MODELS = ["TOW", "ClustH", "ClustH_PRED"]
WORKING_COLUMNS = [
    "Power_fitted", "Power_corrected", "Power_residuals", "Power_original", "IS_Outlier",
    "IS_Missing", "IS_Missing_Outlier", "IS_Repaired", "ClusterHour", "ClusterHour_PRED",
]
SERIES = ["Power"] + [f"Power_fitted_{m}" for m in MODELS]
PERIODS = {"month": "DATE_month_year", "week": "DATE_week_year"}
SPANS = (1, 3, 6)


def use_corrected(df: DataFrame) -> DataFrame:
    """Continue with the repaired power, keeping the raw one aside."""
    return df.withColumns({"Power_original": F.col("Power"), "Power": F.col("Power_corrected")})


def trusted_rows(df: DataFrame) -> DataFrame:
    """Rows that were neither missing, suspect nor repaired."""
    return df.filter(~F.col("IS_Missing_Outlier") & ~F.col("IS_Repaired"))


def drop_working(df: DataFrame) -> DataFrame:
    return df.drop(*WORKING_COLUMNS)


def attach_day_types(df: DataFrame, assignments: DataFrame, columns: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """Inner join by building and day: rows of unassigned days drop out."""
    day = "DATE_YYYY_MM_DD"
    known = assignments.na.drop("any", subset=list(columns)).select("building_id", day, *columns)
    return df.join(known, ["building_id", day])


def add_cluster_fit(df: DataFrame, params: DataFrame, cluster: str, key: str, fitted: str) -> DataFrame:
    """Fit of a day-type model; a (type, hour) without parameters gives null."""
    keyed = df.withColumn(key, cluster_hour(cluster))
    return changepoint_eval_plain(attach_params(keyed, params, key), fitted).drop(*PARAMETERS)


def model_residuals(df: DataFrame) -> DataFrame:
    return df.withColumns({f"Power_residuals_{m}": F.col(f"Power_fitted_{m}") - F.col("Power") for m in MODELS})


def cumulated_residuals(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Trailing sums of the residuals over 3 and 6 rows; nulls are skipped and
    shorter spans at the beginning are kept."""
    rows, window = chunked(model_residuals(df), max(SPANS) - 1, 0, chunk_rows)
    sums = {
        f"Power_residuals_{m}_{n}h": F.sum(f"Power_residuals_{m}").over(window.rowsBetween(1 - n, 0))
        for n in SPANS if n > 1 for m in MODELS
    }
    return own_rows(rows.withColumns(sums))


def model_metrics(df: DataFrame) -> DataFrame:
    """MAE, RMSE and sums of absolute 1 h, 3 h and 6 h residuals of each model.

    Expects :func:`cumulated_residuals`. All models are aggregated in one pass
    and only the one-row results are turned into rows per model.
    """
    aggs, parts = [], []
    for m in MODELS:
        r = F.col(f"Power_residuals_{m}")
        aggs += [
            F.count(r).alias(f"n_{m}"),
            F.avg(F.abs(r)).alias(f"mae_{m}"),
            F.sqrt(F.avg(r * r)).alias(f"rmse_{m}"),
            F.coalesce(F.sum(F.abs(r)), F.lit(0.0)).alias(f"r1_{m}"),
            F.coalesce(F.sum(F.abs(f"Power_residuals_{m}_3h")), F.lit(0.0)).alias(f"r3_{m}"),
            F.coalesce(F.sum(F.abs(f"Power_residuals_{m}_6h")), F.lit(0.0)).alias(f"r6_{m}"),
        ]
        parts.append(
            F.struct(
                F.lit(m).alias("model"), F.col(f"n_{m}").alias("n"), F.col(f"mae_{m}").alias("mae"),
                F.col(f"rmse_{m}").alias("rmse"), F.col(f"r1_{m}").alias("resid_1h"),
                F.col(f"r3_{m}").alias("resid_3h"), F.col(f"r6_{m}").alias("resid_6h"),
            )
        )
    return df.groupBy("building_id").agg(*aggs).select("building_id", F.inline(F.array(*parts)))


def extra_metrics(df: DataFrame, n_parameters: int = 4) -> DataFrame:
    """MAPE (hours with zero load left out), R2, adjusted R2 and AIC.

    Expects :func:`model_residuals`. AIC is n ln(SS_res / n) + 2 p.
    """
    aggs, parts = [], []
    p = n_parameters
    for m in MODELS:
        r, y = F.col(f"Power_residuals_{m}"), F.when(F.col(f"Power_residuals_{m}").isNotNull(), F.col("Power"))
        aggs += [
            F.count(r).alias(f"n_{m}"),
            (F.avg(F.abs(F.try_divide(r, y))) * 100.0).alias(f"mape_{m}"),
            F.sum(r * r).alias(f"res_{m}"),
            (F.var_pop(y) * F.count(y)).alias(f"tot_{m}"),
        ]
        n, r2 = F.col(f"n_{m}"), 1.0 - F.try_divide(F.col(f"res_{m}"), F.col(f"tot_{m}"))
        aic = n * F.ln(F.nullif(F.col(f"res_{m}"), F.lit(0.0)) / n) + 2.0 * p
        parts.append(
            F.struct(
                F.lit(m).alias("model"), F.col(f"mape_{m}").alias("mape"), r2.alias("r2"),
                F.when(n > p + 1, 1.0 - (1.0 - r2) * (n - 1) / (n - p - 1)).alias("adjusted_r2"),
                F.when(n > 0, aic).alias("aic"),
            )
        )
    return df.groupBy("building_id").agg(*aggs).select("building_id", F.inline(F.array(*parts)))


def common_rows(df: DataFrame, fitted: str) -> DataFrame:
    """Rows on which actual and fitted power are both known."""
    return df.filter(F.col("Power").isNotNull() & F.col(fitted).isNotNull())


def to_long(df: DataFrame, ids: list[str], series: list[str] = SERIES) -> DataFrame:
    """Wide to long: one row per variable."""
    return df.unpivot(ids, series, "Variable", "Value")


def _period_columns(unit: str, with_year: bool) -> list[str]:
    return (["DATE_year"] if with_year else []) + [PERIODS[unit]]


def monthly_load(df: DataFrame, with_year: bool = False) -> DataFrame:
    """Mean actual and fitted load by month (of all years together by default)."""
    return df.groupBy("building_id", *_period_columns("month", with_year)).agg(
        *[F.avg(c).alias(c) for c in SERIES]
    )


def climate_period(df: DataFrame, unit: str, kind: str, with_year: bool = False) -> DataFrame:
    """The coldest, hottest or temperate month or ISO week of each building.

    Means are aggregated first; the ranking sees one row per period. Temperate
    is the upper median of the mean temperatures. Ties go to the earlier period.
    """
    periods = _period_columns(unit, with_year)
    means = (
        df.groupBy("building_id", *periods).agg(F.avg("Temperature").alias("mean_temperature"))
        .filter(F.col("mean_temperature").isNotNull())
    )
    by = Window.partitionBy("building_id")
    rank = {
        "coldest": F.row_number().over(by.orderBy("mean_temperature", *periods)) == 1,
        "hottest": F.row_number().over(by.orderBy(F.desc("mean_temperature"), *periods)) == 1,
        "temperate": F.row_number().over(by.orderBy("mean_temperature", *periods))
        == F.floor(F.count(F.lit(1)).over(by) / 2) + 1,
    }[kind]
    return means.withColumn("_chosen", rank).filter("_chosen").drop("_chosen")


def in_period(df: DataFrame, unit: str, kind: str, with_year: bool = False) -> DataFrame:
    """Rows of the chosen period of each building. The choice, one row per
    building, is written once so that its size is known to the join."""
    chosen = materialise(climate_period(df, unit, kind, with_year).drop("mean_temperature"), "period")
    return df.join(chosen, chosen.columns)


def hour_of_week_profile(df: DataFrame, kind: str, unit: str = "month", with_year: bool = False) -> DataFrame:
    """Mean actual and fitted load by hour of the week in a climate period."""
    return in_period(df, unit, kind, with_year).groupBy("building_id", "DATE_hour_week").agg(
        *[F.avg(c).alias(c) for c in SERIES]
    )


def box_stats(df: DataFrame, unit: str, kind: str, by: str, with_year: bool = False) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers of actual and fitted load in a climate
    period, by day of the month or of the week.

    A group holds the hours of one weekday or day of the month of one period,
    bounded by the calendar, so its values are sorted in one array: quartiles and
    whiskers, the extreme values inside the fences, are read from it, and the rows
    are aggregated once.
    """
    rows = to_long(in_period(df, unit, kind, with_year), ["building_id", by]).filter(F.col("Value").isNotNull())
    sorted_ = rows.groupBy("building_id", by, "Variable").agg(F.array_sort(F.collect_list("Value")).alias("_values"))

    def quantile(share: float) -> Column:
        place = (F.size("_values") - 1) * share
        low = F.get("_values", F.floor(place).cast("int"))
        return low + (F.get("_values", F.ceil(place).cast("int")) - low) * (place - F.floor(place))

    boxes = sorted_.withColumns({"q1": quantile(0.25), "median": quantile(0.5), "q3": quantile(0.75)})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.filter("_values", lambda v: v.between(F.col("q1") - reach, F.col("q3") + reach))
    return boxes.select(
        "building_id", by, "Variable", F.size("_values").cast("long").alias("n"), "q1", "median", "q3",
        F.array_min(inside).alias("whisker_low"), F.array_max(inside).alias("whisker_high"))
