"""The registered queries: one per operator, each on readings derived from the
shared test tables and keyed by building.

Model parameters and stand-in day types are integer arithmetic on the keys
found in the data (see ``hour_params``, ``type_params`` and ``stand_in_types``),
so that a SQL engine can build the very same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadsig.functions import calendar, signature
from loadsig.functions.calendar import add_calendar, hour_number
from loadsig.operators import certify, classify, daytypes, evaluate, fit, outliers, profiles, repair
from loadsig.operators.profiles import DAY, POWER_COLUMNS
from loadsig.plans import incremental, scoring
from loadsig.session import materialise, scratch_path
from loadsig.sources import readings as src
from loadsig.sources import tables
from loadsig.sources.fixtures import events_readings, lineitem_readings
from loadsig.streaming import scoring as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
HOUR_KEY = ["building_id", "DATE_hour_week"]
BASE = src.READING_COLUMNS
SILHOUETTE_KS = list(range(2, 31))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs ------------------------------------------------------------

def events_cal(spark: SparkSession, sf: str) -> DataFrame:
    return add_calendar(events_readings(spark, sf))


def lineitem_cal(spark: SparkSession, sf: str) -> DataFrame:
    return add_calendar(lineitem_readings(spark, sf))


def lost_times(df: DataFrame) -> DataFrame:
    """The readings with the times of some rows lost."""
    hour = (F.dayofyear("DATE") - 1) * 24 + F.hour("DATE")
    return df.withColumn("DATE", F.when(hour % 83 != 17, F.col("DATE")))


def _params(keys: DataFrame, key: str, t: int, i: int, b: int, m: int, base: float) -> DataFrame:
    k = F.col(key)
    return keys.select("building_id", key).distinct().withColumns(
        {
            "slope_Temp": F.lit(0.0) - (k % t + 1) * F.lit(0.25),
            "slope_Irrad": F.lit(0.0) - (k % i) * F.lit(0.0625),
            "intercept": (k % b) * F.lit(4.0) + base,
            "minimum": (k % m) * F.lit(1.0) + 2.0,
        }
    )


def hour_params(cal: DataFrame) -> DataFrame:
    return _params(cal, "DATE_hour_week", 5, 3, 7, 2, 140.0)


def type_params(keyed: DataFrame, key: str) -> DataFrame:
    if key == "ClusterHour":
        return _params(keyed, key, 4, 3, 9, 2, 150.0)
    return _params(keyed, key, 3, 5, 11, 3, 145.0)


def stand_in_type(k: int | Column = 3) -> Column:
    return F.dayofyear(DAY) % k


def stand_in_prediction() -> Column:
    return F.expr(f"(dayofyear({DAY}) * 5 div 2) % 3").cast("int")


def scored(cal: DataFrame) -> DataFrame:
    return outliers.score_readings(cal, hour_params(cal))


def flagged(cal: DataFrame) -> DataFrame:
    """Scored readings with the flag over the building. The derived readings
    are written first, since parameters, moments and rows all read them."""
    return outliers.flag_outliers(scored(materialise(cal, "readings")), "global")


def suspect(cal: DataFrame) -> DataFrame:
    """Readings with their outlier flag under the name the repair expects."""
    return flagged(cal).withColumnRenamed("is_outlier_global", "IS_Outlier").drop(*signature.PARAMETERS)


def comparison(cal: DataFrame) -> DataFrame:
    """Trusted rows with the fits of all three models."""
    rows = repair.mark_pending(suspect(cal)).withColumnRenamed("Power_fitted", "Power_fitted_TOW")
    rows = evaluate.trusted_rows(rows).withColumns({"cluster": stand_in_type(), "cluster_PRED": stand_in_prediction()})
    rows = materialise(rows, "trusted")
    keyed = rows.withColumns({"ClusterHour": signature.cluster_hour("cluster"),
                              "ClusterHour_PRED": signature.cluster_hour("cluster_PRED")})
    for cluster, key, m in (("cluster", "ClusterHour", "ClustH"), ("cluster_PRED", "ClusterHour_PRED", "ClustH_PRED")):
        rows = evaluate.add_cluster_fit(rows, type_params(keyed, key), cluster, key, f"Power_fitted_{m}")
    return rows.drop("ClusterHour", "ClusterHour_PRED")


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.day_matrix(events_readings(spark, sf), "Power")


def unit_points(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.normalise_vectors(profiles.day_vectors(matrix(spark, sf)))


def feature_days(spark: SparkSession, sf: str) -> DataFrame:
    features = classify.daily_features(events_readings(spark, sf))
    return features.na.drop("any", subset=classify.FEATURES).withColumn("cluster", stand_in_type())


def predicted_days(spark: SparkSession, sf: str) -> DataFrame:
    days = classify.stratified_split(feature_days(spark, sf))
    return days.filter("is_test").withColumn("cluster_PRED", stand_in_prediction())


def fixed_tree(days: DataFrame) -> DataFrame:
    """A three-node tree for every building, for queries that apply one."""
    rows = F.array(
        *[
            F.struct(
                F.lit(node).alias("node"), F.lit(depth).alias("depth"),
                F.lit(feature).cast("string").alias("feature"), F.lit(threshold).cast("double").alias("threshold"),
                F.lit(0).cast("long").alias("n_days"), F.lit(0.0).alias("impurity"),
                F.array().cast("array<bigint>").alias("counts"), F.lit(kind).alias("prediction"),
                F.lit(feature is None).alias("is_leaf"),
            )
            for node, depth, feature, threshold, kind in (
                (1, 0, "Temperature", 10.0, 0), (2, 1, "DATE_weekday", 0.5, 0), (3, 1, None, None, 2),
                (4, 2, None, None, 1), (5, 2, None, None, 0),
            )
        ]
    )
    return days.select("building_id").distinct().select("building_id", F.inline(rows))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def all_rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(df, *[n for n, t in df.dtypes if t == "double"], digits=digits)


# --- A: sources and sinks -----------------------------------------------------

def _raw(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("DATE")
    return events_readings(spark, sf).select(
        "building_id", F.year(d).alias("Year"), F.month(d).alias("Month"), F.dayofmonth(d).alias("Day_Month"),
        F.hour(d).alias("Hour_Day"), "Power", "Temperature",
        F.col("Solar_Irradiation").alias("Solar.Irradiation"), "Holiday",
    )


@query
def a1_read_readings(spark, sf):
    path = scratch_path(spark, "raw-csv")
    raw = _raw(spark, sf)
    raw.write.partitionBy("building_id").option("sep", ";").option("header", True).csv(path)
    schema = src.RAW_SCHEMA.add("building_id", "string")
    return src.from_raw(src.read_readings(spark, path, schema)).select(BASE)


@query
def a2_read_params(spark, sf):
    path = scratch_path(spark, "params-csv")
    tables.write_table(hour_params(events_cal(spark, sf)), path, "csv")
    return tables.read_params(spark, path)


@query
def a3_read_assignments(spark, sf):
    path = scratch_path(spark, "assignments-csv")
    days = matrix(spark, sf).select("building_id", DAY, stand_in_type().alias("cluster"))
    tables.write_table(days, path, "csv")
    return tables.read_assignments(spark, path)


@query
def a4_write_table(spark, sf):
    path = scratch_path(spark, "readings")
    tables.write_table(events_readings(spark, sf), path)
    return spark.read.parquet(path).select(BASE)


@query
def a5_save_load_model(spark, sf):
    path = scratch_path(spark, "tree")
    days = feature_days(spark, sf)
    tables.save_model(classify.fit_tree(days), path, {"features": ",".join(classify.FEATURES), "seed": "42"})
    tree, _ = tables.load_model(spark, path)
    return all_rounded(classify.tree_table(tree).withColumn("counts", F.concat_ws(",", "counts")))


@query
def a6_multi_building(spark, sf):
    events, items = events_readings(spark, sf), lineitem_readings(spark, sf)
    one = items.filter("building_id = 'site-0'").drop("building_id")
    all_rows = src.union_buildings({"events": events, "items": items, "alone": one})
    return all_rows.groupBy("building_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("DATE").alias("first_date"), F.max("DATE").alias("last_date"),
        F.sum(F.col("Power").cast("decimal(18,2)")).cast("double").alias("total_power"),
    )


@query
def a6_refresh(spark, sf):
    """A second run after one building has a corrected reading and another is
    gone: states, and totals of which only the changed ones were computed."""
    folder = scratch_path(spark, "refresh")
    first = materialise(events_readings(spark, sf), "arrivals")
    mended = F.when((F.col("building_id") == "view-0") & (F.dayofmonth("DATE") == 5), F.col("Power") + 1.0).otherwise(F.col("Power"))
    second = first.filter("building_id <> 'error-0'").withColumn("Power", mended)

    def totals(run: int):
        return lambda rows: rows.groupBy("building_id").agg(
            F.sum(F.col("Power").cast("decimal(18,2)")).cast("double").alias("total_power"), F.lit(run).alias("computed_by"))

    incremental.refresh(first, folder, totals(1))
    states = materialise(incremental.refresh(second, folder, totals(2)), "states")
    kept = incremental.current(spark, folder, "building_id string, total_power double, computed_by int")
    return states.join(kept, "building_id", "left")


@query
def a8_join_weather(spark, sf):
    base = events_readings(spark, sf)
    weather = base.filter(F.hour("DATE") % 5 > 0).select("building_id", "DATE", "Temperature", "Solar_Irradiation")
    return src.join_weather(base.drop("Temperature", "Solar_Irradiation"), weather)


@query
def a7_profile_readings(spark, sf):
    return src.profile_readings(events_readings(spark, sf)).drop("n_columns")


# --- B: projections, filters, scalar functions --------------------------------

@query
def b1_compose_timestamp(spark, sf):
    return _raw(spark, sf).select(
        "building_id", calendar.compose_timestamp("Year", "Month", "Day_Month", "Hour_Day").alias("DATE")
    )


@query
def b2_keep_on_the_hour(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "value")
    return src.keep_on_the_hour(events, "ts")


@query
def b3_format_readings(spark, sf):
    return src.format_readings(
        events_readings(spark, sf).withColumnsRenamed({"DATE": "Date", "Solar_Irradiation": "Solar.Irradiation"})
    )


@query
def b4_add_calendar(spark, sf):
    return lineitem_cal(spark, sf).drop("Holiday", "Temperature", "Solar_Irradiation")


@query
def b5_date_marks(spark, sf):
    kept = events_readings(spark, sf).select(
        "building_id", F.col("DATE").alias("stamp"), (F.hour("DATE") + 100).alias("DATE_hour_day")
    )
    return calendar.date_marks(kept, "stamp")


@query
def b6_changepoint_eval(spark, sf):
    cal = events_cal(spark, sf)
    joined = outliers.attach_params(cal, hour_params(cal))
    return all_rounded(signature.changepoint_eval(joined).select("building_id", "DATE", "Power_fitted", "Power_residuals"))


@query
def b7_changepoint_eval_plain(spark, sf):
    cal = events_cal(spark, sf)
    joined = outliers.attach_params(cal, hour_params(cal)).withColumn("minimum", F.col("minimum") - 400.0)
    return all_rounded(signature.changepoint_eval_plain(joined, "fitted").select("building_id", "DATE", "fitted"))


@query
def b8_cluster_hour(spark, sf):
    return events_cal(spark, sf).withColumn("cluster", stand_in_type()).select(
        "building_id", "DATE", "cluster", signature.cluster_hour("cluster").alias("ClusterHour")
    )


@query
def b9_pending_flags(spark, sf):
    return repair.mark_pending(suspect(events_cal(spark, sf))).select(
        "building_id", "DATE", "IS_Missing", "IS_Outlier", "IS_Missing_Outlier", "IS_Repair_Pending"
    )


@query
def b10_complete_cases(spark, sf):
    return events_readings(spark, sf).na.drop("any", subset=BASE)


@query
def b11_trusted_rows(spark, sf):
    rows = repair.repair_pass(suspect(events_cal(spark, sf)), 1, 1)
    return evaluate.trusted_rows(rows).select("building_id", "DATE", "Power")


@query
def b12_use_corrected(spark, sf):
    rows = repair.repair_pass(suspect(events_cal(spark, sf)), 1, 1)
    kept = evaluate.use_corrected(rows).withColumn("raw_power", F.col("Power_original"))
    return all_rounded(evaluate.drop_working(kept).select("building_id", "DATE", "Power", "raw_power"))


@query
def b13_normalise_days(spark, sf):
    return all_rounded(profiles.wide_profiles(unit_points(spark, sf)))


@query
def b14_one_hot(spark, sf):
    return all_rounded(classify.one_hot(feature_days(spark, sf)))


@query
def b15_changepoint_knots(spark, sf):
    return all_rounded(signature.changepoint_knots(hour_params(events_cal(spark, sf))))


@query
def b16_year_month(spark, sf):
    return lineitem_readings(spark, sf).select("building_id", "DATE", calendar.year_month("DATE").alias("Month"))


@query
def b17_inspect_outliers(spark, sf):
    return all_rounded(outliers.inspect_outliers(flagged(events_cal(spark, sf))))


@query
def b17_inspect_repairs(spark, sf):
    return all_rounded(outliers.inspect_repairs(repair.repair_pass(suspect(events_cal(spark, sf)), 1, 1)))


# --- C: joins and lookups -----------------------------------------------------

@query
def c1_attach_hour_params(spark, sf):
    cal = lineitem_cal(spark, sf)
    return outliers.attach_params(cal, hour_params(cal)).select(
        "building_id", "DATE", "DATE_hour_week", *signature.PARAMETERS
    )


@query
def c2_attach_cluster_params(spark, sf):
    rows = events_cal(spark, sf).withColumn("cluster", stand_in_type())
    keyed = rows.withColumn("ClusterHour", signature.cluster_hour("cluster"))
    known = type_params(keyed, "ClusterHour").filter("ClusterHour < 200")
    fitted = evaluate.add_cluster_fit(rows, known, "cluster", "ClusterHour", "Power_fitted_ClustH")
    return all_rounded(fitted.select("building_id", "DATE", "ClusterHour", "Power_fitted_ClustH"))


@query
def c3_attach_day_types(spark, sf):
    days = profiles.complete_days(matrix(spark, sf)).select("building_id", DAY, stand_in_type().alias("cluster"))
    return evaluate.attach_day_types(events_cal(spark, sf), days).select("building_id", "DATE", DAY, "cluster", "Power")


@query
def c4_exact_offsets(spark, sf):
    wanted = {"prev_hour": -1, "next_hour": 1, "prev_week": -168, "next_week": 168,
              "prev_week_prev_hour": -169, "prev_week_next_hour": -167,
              "next_week_prev_hour": 167, "next_week_next_hour": 169}
    return repair.offsets(lineitem_readings(spark, sf), wanted).select("building_id", "DATE", "Power", *wanted)


@query
def c5_anchors_trusted(spark, sf):
    return repair.trusted(repair.mark_pending(suspect(events_cal(spark, sf))), 1, 1).select(
        "building_id", "DATE", "IS_Repair_Pending", "trusted"
    )


@query
def c6_write_back(spark, sf):
    rows = repair.repair_pass(suspect(events_cal(spark, sf)), 1, 1)
    return all_rounded(rows.filter("IS_Repaired").select("building_id", "DATE", "Power", "Power_corrected"))


@query
def c7_common_rows(spark, sf):
    return all_rounded(evaluate.common_rows(scored(events_cal(spark, sf)), "Power_fitted").select(
        "building_id", "DATE", "Power", "Power_fitted"))


# --- D: aggregations ----------------------------------------------------------

@query
def d1_daily_features(spark, sf):
    return all_rounded(classify.daily_features(events_readings(spark, sf)))


@query
def d2_day_matrix(spark, sf):
    return matrix(spark, sf)


@query
def d3_residual_stats(spark, sf):
    return all_rounded(outliers.residual_stats(scored(events_cal(spark, sf))))


@query
def d4_fit_bounds(spark, sf):
    return all_rounded(fit.fit_bounds(lineitem_cal(spark, sf), HOUR_KEY))


@query
def d5_score_candidates(spark, sf):
    cal = events_cal(spark, sf)
    scores = fit.score_candidates(cal, fit.fit_bounds(cal, HOUR_KEY), HOUR_KEY)
    return all_rounded(scores)


@query
def d6_best_candidate(spark, sf):
    cal = materialise(lineitem_cal(spark, sf), "readings")
    scores = fit.score_candidates(cal, fit.fit_bounds(cal, HOUR_KEY), HOUR_KEY)
    return all_rounded(fit.best_candidate(scores, HOUR_KEY))


def planted_power(cal: DataFrame) -> DataFrame:
    """Readings whose power is a model of its hour of the week, with 40 added on
    every nineteenth day: least absolute errors give the model back."""
    k = F.col("DATE_hour_week")
    line = (k % 4) * 4.0 + 100.0 - (k % 3 + 2) * 0.5 * F.col("Temperature") - (k % 2 + 1) * 0.03 * F.col("Solar_Irradiation")
    power = F.greatest(line, (k % 2) * 4.0 + 90.0) + F.when(F.dayofyear("DATE") % 19 == 3, 40.0).otherwise(0.0)
    known = F.col("Temperature").isNotNull() & F.col("Solar_Irradiation").isNotNull()
    return cal.withColumn("Power", F.when(known, power))


@query
def d7_fit_changepoint(spark, sf):
    """Planted models come back, with their loss; the proof leaves little open."""
    planted = planted_power(lineitem_cal(spark, sf))
    fits = fit.fit_changepoint(planted, HOUR_KEY, effort=certify.FULL_EFFORT)
    proven = F.col("loss") - F.col("bound") <= 0.25 * F.col("loss") + 1.0
    return rounded(fits, "slope_Temp", "slope_Irrad", digits=4).withColumn("proven", proven).drop("bound").withColumns(
        {c: F.round(c, 2) for c in ("intercept", "minimum", "loss")})


@query
def d7_fit_quality(spark, sf):
    """Properties every fit must have, one row per model, beside the loss of the
    best coarse candidate: the loss is that of the returned parameters, they
    respect the bounds, no candidate is better, and the proven bound is below the
    losses of the fit and of the candidates."""
    cal = materialise(lineitem_cal(spark, sf), "readings")
    bounds = fit.fit_bounds(cal, HOUR_KEY)
    fits = materialise(fit.fit_changepoint(cal, HOUR_KEY), "fits")
    best = fit.best_candidate(fit.score_candidates(cal, bounds, HOUR_KEY), HOUR_KEY)
    fitted = signature.changepoint_eval(outliers.attach_params(cal, fits.select(*HOUR_KEY, *signature.PARAMETERS)))
    again = fitted.groupBy(HOUR_KEY).agg(F.sum(F.abs("Power_residuals")).alias("again"))
    joined = (
        fits.join(bounds.drop("n_rows"), HOUR_KEY).join(again, HOUR_KEY)
        .join(best.select(*HOUR_KEY, F.col("loss").alias("coarse")), HOUR_KEY, "left")
    )
    slack = 1e-6
    inside = (
        F.col("slope_Temp").between(F.col("slope_Temp_min") - slack, slack)
        & F.col("slope_Irrad").between(F.col("slope_Irrad_min") - slack, slack)
        & F.col("intercept").between(-slack, F.col("intercept_max") + slack)
        & F.col("minimum").between(-slack, F.col("minimum_max") + slack)
    )
    return joined.select(
        *HOUR_KEY, "n_rows", "status", F.round("coarse", 3).alias("coarse_loss"),
        (F.abs(F.col("again") - F.col("loss")) < 1e-3).alias("loss_is_that_of_params"),
        inside.alias("inside_bounds"),
        (F.col("loss") <= F.col("coarse") + 1e-3).alias("beats_candidates"),
        (F.col("bound") <= F.col("loss") + slack).alias("bound_holds"),
    )


@query
def d8_flag_outliers_group(spark, sf):
    flags = outliers.flag_outliers(scored(lineitem_cal(spark, sf)), "group", threshold=outliers.Z95)
    return flags.select("building_id", "DATE", "is_outlier_group")


@query
def d9_flag_outliers_global(spark, sf):
    return flagged(lineitem_cal(spark, sf)).select("building_id", "DATE", "is_outlier_global")


@query
def d10_outliers_by_month(spark, sf):
    return all_rounded(outliers.outliers_by_month(flagged(lineitem_cal(spark, sf))))


@query
def d11_residual_histogram(spark, sf):
    return all_rounded(outliers.residual_histogram(scored(lineitem_cal(spark, sf))))


@query
def d11_normal_curve(spark, sf):
    return all_rounded(outliers.residual_normal_curve(scored(events_cal(spark, sf))))


@query
def d12_cluster_profiles(spark, sf):
    return all_rounded(profiles.cluster_profiles(unit_points(spark, sf).withColumn("cluster", stand_in_type())))


@query
def d13_model_metrics(spark, sf):
    return all_rounded(evaluate.model_metrics(evaluate.cumulated_residuals(comparison(lineitem_cal(spark, sf)))))


@query
def d14_monthly_load(spark, sf):
    return all_rounded(evaluate.monthly_load(comparison(lineitem_cal(spark, sf))))


def _profile(kind: str) -> Query:
    def run(spark, sf):
        rows = materialise(comparison(lineitem_cal(spark, sf)), "comparison")
        return all_rounded(evaluate.hour_of_week_profile(rows, kind))

    return run


def _boxes(unit: str, kind: str) -> Query:
    by = {"month": "DATE_day_month", "week": "DATE_day_week"}[unit]

    def run(spark, sf):
        rows = materialise(comparison(lineitem_cal(spark, sf)), "comparison")
        return all_rounded(evaluate.box_stats(rows, unit, kind, by))

    return run


def _climate(unit: str) -> Query:
    def run(spark, sf):
        cal = lineitem_cal(spark, sf)
        parts = [evaluate.climate_period(cal, unit, kind).withColumn("kind", F.lit(kind))
                 for kind in ("coldest", "hottest", "temperate")]
        return all_rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))

    return run


for _kind in ("coldest", "hottest", "temperate"):
    QUERIES[f"d15_hour_of_week_{_kind}_month"] = _profile(_kind)
    for _unit in ("month", "week"):
        QUERIES[f"d16_box_stats_{_kind}_{_unit}"] = _boxes(_unit, _kind)
for _unit in ("month", "week"):
    QUERIES[f"d17_climate_{_unit}"] = _climate(_unit)


@query
def d18_confusion_matrix(spark, sf):
    return classify.confusion_matrix(classify.confusion_cells(predicted_days(spark, sf)), [0, 1, 2])


@query
def d19_classification_report(spark, sf):
    return classify.classification_report(classify.confusion_cells(predicted_days(spark, sf)))


@query
def d20_accuracy(spark, sf):
    return all_rounded(classify.accuracy(predicted_days(spark, sf)))


@query
def d20_class_counts(spark, sf):
    return classify.class_counts(feature_days(spark, sf))


@query
def d21_model_keys(spark, sf):
    return lineitem_cal(spark, sf).select(HOUR_KEY).distinct()


@query
def d22_accuracy_by_day(spark, sf):
    return classify.accuracy_by_day(feature_days(spark, sf).withColumn("cluster_PRED", stand_in_prediction()))


@query
def d23_extra_metrics(spark, sf):
    return all_rounded(evaluate.extra_metrics(evaluate.model_residuals(comparison(lineitem_cal(spark, sf)))))


# --- E: windows ---------------------------------------------------------------

def _edges(pre: int, post: int) -> Query:
    def run(spark, sf):
        return repair.edges(repair.mark_pending(suspect(events_cal(spark, sf))), pre, post).select(
            "building_id", "DATE", "IS_Repair_Pending", "gap_edge"
        )

    return run


QUERIES["e1_isolated_gap"] = _edges(1, 1)
QUERIES["e2_gap_edge"] = _edges(2, 3)


@query
def e3_offset_frames(spark, sf):
    shifted = {"week_before": -168, "week_after": 168}
    return repair.offsets(lost_times(events_readings(spark, sf)), shifted).select("building_id", "DATE", "Power", *shifted)


@query
def e4_cumulated_residuals(spark, sf):
    rows = evaluate.cumulated_residuals(comparison(lineitem_cal(spark, sf)))
    return all_rounded(rows.select("building_id", "DATE", *[f"Power_residuals_{m}_{n}h" for n in (3, 6) for m in evaluate.MODELS]))


@query
def e5_day_index(spark, sf):
    days = profiles.complete_days(profiles.day_index(matrix(spark, sf)))
    return days.select("building_id", DAY, "day_index", stand_in_type().alias("cluster"))


@query
def e6_group_moments(spark, sf):
    rows = scored(events_cal(spark, sf))
    moments = outliers.residual_stats(rows, HOUR_KEY, ddof=1).select(*HOUR_KEY, "mean_residual", "std_residual")
    return all_rounded(rows.join(moments, HOUR_KEY, "left").select("building_id", "DATE", "mean_residual", "std_residual"))


# --- F: sort, limit, reshape --------------------------------------------------

@query
def f1_sorted_export(spark, sf):
    return lineitem_readings(spark, sf).select("building_id", "DATE", "Power").orderBy("building_id", "DATE")


@query
def f2_first_days(spark, sf):
    return profiles.first_days(profiles.day_matrix(lineitem_readings(spark, sf), "Power"), 100)


@query
def f3_peak_hour(spark, sf):
    known = lineitem_readings(spark, sf).filter(F.col("Power").isNotNull())
    top = F.max_by(F.struct("DATE", "Power"), F.struct("Power", -hour_number("DATE")))
    return known.groupBy("building_id").agg(top.alias("top")).select("building_id", "top.*")


@query
def f4_union_groups(spark, sf):
    cal = events_cal(spark, sf)
    weekdays, weekends = cal.filter("DATE_weekday"), cal.filter("NOT DATE_weekday")
    return weekdays.unionByName(weekends).select("building_id", "DATE", "DATE_weekday", "Power")


@query
def f5_intersection(spark, sf):
    rows = scored(events_cal(spark, sf))
    known = rows.filter(F.col("Power").isNotNull()).select("building_id", "DATE")
    fitted = rows.filter(F.col("Power_fitted").isNotNull()).select("building_id", "DATE")
    return known.join(fitted, ["building_id", "DATE"], "left_semi")


@query
def f6_unpivot(spark, sf):
    return all_rounded(evaluate.to_long(evaluate.monthly_load(comparison(lineitem_cal(spark, sf))),
                                        ["building_id", "DATE_month_year"]))


# --- R: repair ----------------------------------------------------------------

def _repaired(df: DataFrame) -> DataFrame:
    return all_rounded(df.select("building_id", "DATE", "IS_Missing_Outlier", "IS_Repaired", "Power_corrected"))


@query
def r1_repair_pass(spark, sf):
    return _repaired(repair.repair_pass(suspect(events_cal(spark, sf)), 1, 1))


@query
def r1_repair_pass_multi(spark, sf):
    return _repaired(repair.repair_pass(suspect(events_cal(spark, sf)), 2, 3))


@query
def r2_repair(spark, sf):
    return _repaired(repair.repair(suspect(add_calendar(lost_times(events_readings(spark, sf))))))


@query
def r2_repair_summary(spark, sf):
    return repair.repair_summary(repair.repair(suspect(events_cal(spark, sf))))


# --- M: day types and tree ----------------------------------------------------

def _labelled(points: DataFrame, ks: list[int]) -> DataFrame:
    return points.withColumn("labels", F.array(*[stand_in_type(k) for k in ks]))


def _wss_by_k(points: DataFrame) -> DataFrame:
    tried = points.withColumn("k", F.explode(F.sequence(F.lit(daytypes.K_LOWEST), F.lit(daytypes.K_MAX))))
    return daytypes.wss(tried.withColumn("cluster", stand_in_type(F.col("k"))), ("building_id", "k"))


def planted_days(spark: SparkSession, sf: str) -> DataFrame:
    """The days of the data with one of four shapes each and a little noise. The
    shapes have rising means, so that labels are the numbers of the shapes."""
    s = F.dayofyear(DAY) % 4
    noise = lambda h: ((F.dayofyear(DAY) * 31 + h * 17) % 10) * 0.001
    profile = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.when(
        (h >= s * 6) & (h < s * 7 + 3), 1.0).otherwise(0.0) + noise(h))
    return materialise(matrix(spark, sf).select("building_id", DAY, profile.alias("profile")), "planted")


@query
def m1_kmeans_days(spark, sf):
    """The planted shapes come back as day types."""
    return daytypes.kmeans_days(planted_days(spark, sf), 4)


@query
def m1_kmeans_blocks(spark, sf):
    """The same over buildings that are cut into several blocks of days."""
    return daytypes.kmeans_days(planted_days(spark, sf), 4, block_days=9)


@query
def m1_kmeans_quality(spark, sf):
    """Properties of a converged k-means: labels are nearest, centres are
    means, and the sum of squares is below that of the stand-in types."""
    points = materialise(unit_points(spark, sf), "profiles")
    centres = materialise(daytypes.kmeans_search(points, [3]), "centres")
    assigned = materialise(daytypes.assign_nearest(points, centres), "assigned")
    means = daytypes.update_centres(assigned).withColumnsRenamed({"centre": "mean", "n_days": "n"})
    stand_in = daytypes.wss(points.withColumn("cluster", stand_in_type())).withColumnRenamed("wss", "stand_in")
    centre_check = centres.join(means, ["building_id", "cluster"]).groupBy("building_id").agg(
        F.sum("n").alias("n_days"), F.max("wss").alias("wss"),
        (F.max(daytypes.squared_distance(F.col("centre"), F.col("mean"))) < 1e-9).alias("centres_are_means"),
    )
    cost = assigned.groupBy("building_id").agg(F.sum("dist2").alias("cost"))
    return centre_check.join(cost, "building_id").join(stand_in, "building_id").select(
        "building_id", "n_days", (F.abs(F.col("cost") - F.col("wss")) < 1e-6).alias("labels_are_nearest"),
        "centres_are_means", (F.col("wss") <= F.col("stand_in") + 1e-6).alias("beats_stand_in"),
    )


@query
def m1_planted_types(spark, sf):
    """Days get one of four shapes, one of them constant; with k far above the
    number of distinct days each shape is a type of its own."""
    hours = F.sequence(F.lit(0), F.lit(23))
    shape = F.dayofyear(DAY) % 4
    planted = F.transform(hours, lambda h: F.when((shape > 0) & (h == shape * 6), 1.0).otherwise(0.0))
    points = materialise(unit_points(spark, sf).select("building_id", DAY, planted.alias("profile")), "planted")
    found = daytypes.kmeans_days(points, daytypes.K_MAX)
    return found.withColumn("first_day", F.min(DAY).over(Window.partitionBy("building_id", "cluster"))).drop("cluster")


@query
def m1_day_types(spark, sf):
    """Of all k up to 30 the number of planted shapes is chosen."""
    assignments, chosen, _ = daytypes.day_types(planted_days(spark, sf))
    return assignments.join(chosen.select("building_id", "k", "converged"), "building_id")


@query
def m2_lloyd_step(spark, sf):
    points = unit_points(spark, sf)
    start = daytypes.update_centres(points.withColumn("cluster", stand_in_type())).drop("n_days")
    moved = daytypes.lloyd_step(points, start)
    return all_rounded(moved.select("building_id", "cluster", "n_days", F.posexplode("centre").alias("hour", "value")))


@query
def m3_wss(spark, sf):
    return all_rounded(_wss_by_k(materialise(unit_points(spark, sf), "profiles")))


@query
def m4_elbow_k(spark, sf):
    return daytypes.elbow_k(_wss_by_k(materialise(unit_points(spark, sf), "profiles")))


@query
def m5_silhouette(spark, sf):
    return all_rounded(daytypes.silhouette(_labelled(unit_points(spark, sf), SILHOUETTE_KS), SILHOUETTE_KS))


@query
def m5_silhouette_blocks(spark, sf):
    """The same over buildings that are cut into several blocks of days."""
    points = _labelled(unit_points(spark, sf), SILHOUETTE_KS)
    return all_rounded(daytypes.silhouette(points, SILHOUETTE_KS, block_days=9))


@query
def m6_choose_k(spark, sf):
    points = materialise(unit_points(spark, sf), "profiles")
    scores = daytypes.silhouette(_labelled(points, SILHOUETTE_KS), SILHOUETTE_KS)
    return daytypes.choose_k(_wss_by_k(points), scores)


@query
def m7_stratified_split(spark, sf):
    return classify.stratified_split(feature_days(spark, sf)).select("building_id", DAY, "cluster", "is_test")


@query
def m8_best_split(spark, sf):
    rows = feature_days(spark, sf).withColumn("node", F.lit(1))
    return all_rounded(classify.best_split(rows, 3))


@query
def m8_best_split_many_types(spark, sf):
    """The same with thirty day types."""
    rows = feature_days(spark, sf).withColumns({"node": F.lit(1), "cluster": stand_in_type(30)})
    return all_rounded(classify.best_split(rows, 30, min_leaf=2))


@query
def m8_fit_tree(spark, sf):
    tree = classify.fit_tree(feature_days(spark, sf), n_classes=3)
    return all_rounded(tree.withColumn("counts", F.concat_ws(",", "counts")))


@query
def m9_predict_day_type(spark, sf):
    days = feature_days(spark, sf)
    return classify.predict_day_type(days, fixed_tree(days)).select("building_id", DAY, "cluster_PRED")


@query
def m10_tree_table(spark, sf):
    tree = classify.tree_table(classify.fit_tree(feature_days(spark, sf), n_classes=3))
    return all_rounded(tree.withColumn("counts", F.concat_ws(",", "counts")))


# --- P: prediction ------------------------------------------------------------

def _pred_params(spark: SparkSession, sf: str) -> DataFrame:
    hours = events_cal(spark, sf).select("building_id", "DATE_hour_day", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("cluster_PRED"))
    return type_params(hours.withColumn("ClusterHour_PRED", signature.cluster_hour("cluster_PRED")), "ClusterHour_PRED")


@query
def p1_predict_load(spark, sf):
    base = events_readings(spark, sf)
    return all_rounded(scoring.predict_load(base, fixed_tree(base), _pred_params(spark, sf)))


@query
def p1_predict_load_daily(spark, sf):
    days = classify.daily_features(events_readings(spark, sf))
    return all_rounded(scoring.predict_load_daily(days, fixed_tree(days), _pred_params(spark, sf)))


def _streamed(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The stream over two deliveries, the second with a run that restarts from
    the log of the first: rows out of order, some without a time, some twice in a
    file with another power, some again later."""
    base = materialise(lost_times(events_readings(spark, sf)), "arrivals")
    cal = add_calendar(base)
    params = materialise(hour_params(cal), "params")
    stats = materialise(outliers.residual_stats(outliers.score_readings(cal, params)), "moments")
    timed = base.filter("DATE IS NOT NULL")
    same_file = timed.filter(F.hour("DATE") % 11 == 5).withColumn("Power", F.col("Power") - 1.0)
    later = timed.filter(F.hour("DATE") % 7 == 0).withColumn("Power", F.col("Power") + 5.0)
    folder, out, log = (scratch_path(spark, name) for name in ("deliveries", "scored", "stream-log"))
    first = base.unionByName(same_file).repartition(4, F.xxhash64("building_id", "DATE") % 4)
    for delivery in (first, later.repartition(1)):
        delivery.write.mode("append").parquet(folder)
        arriving = streaming.read_reading_stream(spark, folder, base.schema, files_per_batch=2)
        result = streaming.score_stream(arriving, params, stats)
        streaming.run_available(result, out, log)
    return out, result


@query
def p2_score_stream(spark, sf):
    """All deliveries with their status; repeats keep their own power."""
    out, result = _streamed(spark, sf)
    return all_rounded(streaming.scored_readings(spark, out, result.schema, status=None))


@query
def p2_stream_moments(spark, sf):
    return all_rounded(streaming.stream_moments(spark, _streamed(spark, sf)[0]))
