"""Two-stage load prediction: day type from the tree, load from its model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadsig.operators.classify import FEATURES, daily_features, predict_day_type
from loadsig.operators.evaluate import add_cluster_fit, attach_day_types
from loadsig.operators.profiles import DAY

KEY = "ClusterHour_PRED"


def predict_load(readings: DataFrame, tree: DataFrame, params: DataFrame) -> DataFrame:
    """Load of every hour from the hour's weather and its day's predicted type.
    Days that lack a feature have no prediction."""
    days = daily_features(readings).na.drop("any", subset=FEATURES)
    types = predict_day_type(days, tree)
    hours = readings.select("building_id", "DATE", "Temperature", "Solar_Irradiation",
                            F.to_date("DATE").alias(DAY), F.hour("DATE").alias("DATE_hour_day"))
    hours = attach_day_types(hours, types, ["cluster_PRED"])
    return add_cluster_fit(hours, params, "cluster_PRED", KEY, "predicted_load").select(
        "building_id", "DATE", "cluster_PRED", KEY, "predicted_load"
    )


def predict_load_daily(days: DataFrame, tree: DataFrame, params: DataFrame, hours: list[int] = list(range(24))) -> DataFrame:
    """Load of the given hours of each day from the day's features alone."""
    types = predict_day_type(days.na.drop("any", subset=FEATURES), tree)
    grid = types.withColumn("DATE_hour_day", F.explode(F.array(*[F.lit(h) for h in hours])))
    return add_cluster_fit(grid, params, "cluster_PRED", KEY, "predicted_load").select(
        "building_id", DAY, "DATE_hour_day", "cluster_PRED", "predicted_load"
    )
