"""Null rules, outlier flags, ingest and calendar on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from builders import hour, reading, readings
from loadsig.functions.calendar import add_calendar, date_marks
from loadsig.functions.signature import changepoint_eval, changepoint_eval_plain, changepoint_knots
from loadsig.operators import classify, evaluate, outliers, profiles
from loadsig.operators.repair import mark_pending
from loadsig.sources import readings as src
from loadsig.sources import tables


def with_params(df, s_temp=-1.0, s_irrad=-0.1, intercept=20.0, minimum=2.0):
    return df.withColumns({"slope_Temp": F.lit(s_temp), "slope_Irrad": F.lit(s_irrad),
                           "intercept": F.lit(intercept), "minimum": F.lit(minimum)})


def test_missing_weather_is_zero_or_null(spark):
    df = with_params(readings(spark, [reading(0, 7.0, None), reading(1, 7.0, 5.0, None), reading(2, 7.0, 5.0)]))
    zero = changepoint_eval(df).orderBy("DATE").collect()
    assert [(r["Power_fitted"], r["Power_residuals"]) for r in zero] == [(0.0, -7.0), (0.0, -7.0), (15.0, 8.0)]
    null = changepoint_eval(df, on_missing="null").orderBy("DATE").collect()
    assert [r["Power_fitted"] for r in null] == [None, None, 15.0]


def test_minimum_floor_and_plain_variant(spark):
    df = readings(spark, [reading(0, 1.0, 40.0)])
    assert changepoint_eval(with_params(df, minimum=-5.0)).first()["Power_fitted"] == 0.0
    assert changepoint_eval_plain(with_params(df, minimum=-5.0), "f").first()["f"] == -5.0
    assert changepoint_eval(with_params(df)).first()["Power_fitted"] == 2.0


def test_missing_columns_warn(spark):
    df = with_params(readings(spark, [reading(0, 1.0)]))
    with pytest.warns(UserWarning):
        assert "Power_fitted" not in changepoint_eval(df.drop("Temperature")).columns
    with pytest.warns(UserWarning):
        assert changepoint_eval(df.drop("Power")).first()["Power_residuals"] is None


def test_flat_models_have_no_line(spark):
    rows = [("A", 0, 0.0, 0.0, 5.0, 1.0), ("A", 1, -2.0, 0.0, 21.0, 1.0), ("A", 2, None, 0.0, 21.0, 1.0)]
    df = spark.createDataFrame(rows, "building_id string, k int, slope_Temp double, slope_Irrad double, intercept double, minimum double")
    (line,) = changepoint_knots(df).collect()
    assert (line["k"], line["x2"], line["y1"]) == (1, 10.0, 121.0)


def test_nan_becomes_null_and_is_no_outlier(spark):
    df = readings(spark, [reading(0, float("nan")), reading(1, 3.0)])
    clean = src.format_readings(df.withColumnRenamed("DATE", "Date"), col_solar_irradiation="Solar_Irradiation")
    assert clean.orderBy("DATE").first()["Power"] is None
    flagged = outliers.flag_outliers(changepoint_eval(with_params(clean)))
    assert [r["is_outlier_global"] for r in flagged.orderBy("DATE").collect()] == [False, False]


def test_one_row_group_is_no_outlier(spark):
    df = spark.createDataFrame([("A", 1, 9.0)], "building_id string, DATE_hour_week int, Power_residuals double")
    assert outliers.flag_outliers(df, "group").first()["is_outlier_group"] is False


def test_higher_threshold_never_adds_outliers(spark):
    df = spark.createDataFrame([("A", i, float(i**3 % 50)) for i in range(60)],
                               "building_id string, DATE_hour_week int, Power_residuals double")
    counts = [outliers.flag_outliers(df, threshold=t).filter("is_outlier_global").count() for t in (0.5, 1.0, 1.5, 2.0)]
    assert counts == sorted(counts, reverse=True)


def test_unknown_flag_counts_as_outlier(spark):
    rows = [("A", hour(0), False, 1.0, 1.0, 1.0, None), ("A", hour(1), False, 1.0, 1.0, 1.0, False),
            ("A", hour(2), False, None, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "building_id string, DATE timestamp_ntz, Holiday boolean, Temperature double, "
                                     "Solar_Irradiation double, Power double, IS_Outlier boolean")
    got = mark_pending(df).orderBy("DATE").collect()
    assert [r["IS_Repair_Pending"] for r in got] == [True, False, True]
    assert [r["IS_Missing"] for r in got] == [False, False, True]
    assert not mark_pending(df.drop("IS_Outlier")).filter("IS_Outlier").count()


def test_unknown_holiday_counts_as_holiday(spark):
    df = readings(spark, [reading(0, 1.0, holiday=None), reading(1, 1.0)]).withColumnRenamed("DATE", "Date")
    got = src.format_readings(df, col_solar_irradiation="Solar_Irradiation").orderBy("DATE").collect()
    assert [r["Holiday"] for r in got] == [True, False]


def test_calendar_at_the_turn_of_the_year(spark):
    df = add_calendar(readings(spark, [reading(n, 1.0, start=dt.datetime(2019, 12, 30)) for n in (0, 49, 95)]))
    got = [(r["DATE_week_year"], r["DATE_day_week"], r["DATE_hour_week"], r["DATE_hour_year"], r["DATE_weekday"])
           for r in df.orderBy("DATE").collect()]
    assert got == [(1, 0, 0, 363 * 24, True), (1, 2, 49, 1, True), (1, 3, 95, 47, True)]


def test_date_marks_keep_what_is_there(spark):
    df = readings(spark, [reading(5, 1.0)]).withColumnRenamed("DATE", "when").withColumn("DATE_hour_day", F.lit(99))
    row = date_marks(df, "when").first()
    assert (row["DATE_hour_day"], row["DATE_hour_week"]) == (99, 5)


def test_csv_round_trip(spark, tmp_path):
    lines = ["Year;Month;Day_Month;Hour_Day;Power;Temperature;Solar.Irradiation;Holiday",
             "2019;1;1;0;10.5;-1.5;0;1", "2019;1;1;1;;2;0.5;0", "2019;1;1;2;3;2;;true", "2019;1;1;3;NaN;2;1;"]
    for name in ("north", "south"):
        (tmp_path / f"{name}.csv").write_text("\n".join(lines))
    got = src.from_raw(src.read_readings(spark, str(tmp_path / "*.csv"))).orderBy("building_id", "DATE").collect()
    assert [r["building_id"] for r in got] == ["north"] * 4 + ["south"] * 4
    assert [(r["Power"], r["Solar_Irradiation"], r["Holiday"]) for r in got[:4]] == [
        (10.5, 0.0, True), (None, 0.5, False), (3.0, None, True), (None, 1.0, True)]
    assert got[0]["DATE"] == dt.datetime(2019, 1, 1) and got[0]["DATE_hour_week"] == 24


def test_duplicate_hours_are_refused(spark):
    df = readings(spark, [reading(0, 1.0), reading(0, 2.0)])
    with pytest.raises(ValueError):
        src.require_unique_hours(df)
    assert src.require_unique_hours(readings(spark, [reading(0, 1.0), reading(0, 1.0, building="B")])).count() == 2


def test_regularize_inserts_absent_hours(spark):
    got = src.regularize(readings(spark, [reading(0, 1.0), reading(3, 2.0), reading(7, 1.0, building="B")]))
    assert [r["Power"] for r in got.filter("building_id = 'A'").orderBy("DATE").collect()] == [1.0, None, None, 2.0]
    assert got.filter("building_id = 'B'").count() == 1


def test_constant_and_incomplete_days(spark):
    rows = [reading(h, 4.0) for h in range(24)] + [reading(24 + h, float(h)) for h in range(24)]
    rows += [reading(48 + h, 1.0) for h in range(23)] + [reading(72 + h, None) for h in range(24)]
    matrix = profiles.day_matrix(readings(spark, rows), "Power")
    assert matrix.count() == 3
    points = profiles.normalise_vectors(profiles.day_vectors(matrix)).orderBy(profiles.DAY).collect()
    assert points[0]["profile"] == [0.0] * 24
    assert points[1]["profile"] == [h / 23.0 for h in range(24)]
    assert len(points) == 2


def test_sum_of_nothing_is_zero_in_daily_features(spark):
    rows = [("A", hour(h), None if h < 3 else h == 3, None, None, 1.0) for h in range(24)]
    day = classify.daily_features(readings(spark, rows)).first()
    assert (day["Temperature"], day["Solar_Irradiation"], day["Holiday"]) == (None, 0.0, True)


def test_cumulated_residuals_bridge_gaps_and_chunks(spark):
    hours = [0, 1, 2, 10, 11, 40, 41, 42]
    rows = [("A", hour(h), 10.0, *(float(h),) * 3) for h in hours]
    df = spark.createDataFrame(rows, "building_id string, DATE timestamp_ntz, Power double, Power_fitted_TOW double, "
                                     "Power_fitted_ClustH double, Power_fitted_ClustH_PRED double")
    got = evaluate.cumulated_residuals(df, chunk_rows=5).orderBy("DATE").collect()
    residuals = [h - 10.0 for h in hours]
    for n in (3, 6):
        want = [sum(residuals[max(0, i - n + 1): i + 1]) for i in range(len(hours))]
        assert [r[f"Power_residuals_TOW_{n}h"] for r in got] == want
    metrics = {r["model"]: r for r in evaluate.model_metrics(evaluate.cumulated_residuals(df)).collect()}
    assert metrics["TOW"]["resid_1h"] == sum(map(abs, residuals)) == metrics["TOW"]["mae"] * len(hours)


def test_climate_periods(spark):
    means = {1: -3.0, 2: 0.0, 3: 6.0, 4: 9.0, 5: 20.0}
    df = spark.createDataFrame([("A", 2024, m, t) for m, t in means.items()],
                               "building_id string, DATE_year int, DATE_month_year int, Temperature double")
    got = {k: evaluate.climate_period(df, "month", k).first()["DATE_month_year"] for k in ("coldest", "hottest", "temperate")}
    assert got == {"coldest": 1, "hottest": 5, "temperate": 3}
    even = evaluate.climate_period(df.filter("DATE_month_year < 5"), "month", "temperate").first()
    assert even["DATE_month_year"] == 3


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", 3, -1.0, 0.0, 5.5, 0.25)], "building_id string, ClusterHour int, slope_Temp double, "
                               "slope_Irrad double, intercept double, minimum double")
    tables.write_table(df, str(tmp_path / "p"), "csv")
    assert tables.read_params(spark, str(tmp_path / "p"), "ClusterHour").collect() == df.collect()
    with pytest.raises(ValueError):
        tables.read_params(spark, str(tmp_path / "p"), "hour")
