"""Micro-batches give the same scores as one batch."""

import pytest
from builders import START, reading, readings
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadsig.functions.calendar import add_calendar
from loadsig.operators.outliers import residual_stats, score_readings
from loadsig.streaming.scoring import (
    read_reading_stream, run_available, score_stream, score_with_stored_moments, scored_readings, stream_moments)


def test_stream_equals_batch(spark, tmp_path):
    rows = [reading(h, 20.0 + (h * 7) % 11 + (60.0 if h % 37 == 0 else 0.0), 5.0 + h % 9, (h % 24) * 10.0, b)
            for h in range(96) for b in ("A", "B")]
    batch = readings(spark, rows)
    params = batch.select("building_id", (F.weekday("DATE") * 24 + F.hour("DATE")).alias("DATE_hour_week")).distinct().withColumns(
        {"slope_Temp": F.lit(-1.0), "slope_Irrad": F.lit(-0.01), "intercept": F.lit(35.0), "minimum": F.lit(3.0)}).cache()
    stats = residual_stats(score_readings(add_calendar(batch), params)).cache()
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = batch.schema
    for day in (2, 0, 3, 1):
        part = batch.filter(F.to_date("DATE") == F.lit(START.date().replace(day=1 + day)))
        if day < 2:
            part = part.unionByName(part.limit(10))
        part.coalesce(1).write.mode("append").parquet(folder)
        # one run per delivery; the second starts from the first one's log
        stream = read_reading_stream(spark, folder, schema, files_per_batch=1)
        run_available(score_stream(stream, params, stats), out, log)
    want = score_with_stored_moments(batch, params, stats)
    got = scored_readings(spark, out, T.StructType([*want.schema, T.StructField("status", T.StringType())]))
    assert got.count() == want.count() == len(rows)
    assert want.exceptAll(got.select(want.columns)).count() == 0
    assert want.filter("is_outlier").count() > 0
    repeats = scored_readings(spark, out, got.schema, "repeat")
    assert repeats.count() == 20
    moments = {r["building_id"]: r for r in stream_moments(spark, out).collect()}
    for r in stats.collect():
        assert moments[r["building_id"]]["n_residuals"] == r["n_residuals"]
        assert moments[r["building_id"]]["mean_residual"] == pytest.approx(r["mean_residual"])
        assert moments[r["building_id"]]["threshold"] == pytest.approx(r["threshold"])


def test_conflicting_repeats_and_lost_times(spark, tmp_path):
    """The first delivery of an hour wins, in a batch the largest power; rows
    without a time are kept; a restarted run finds the same rows."""
    first = [reading(0, 5.0), reading(0, 7.0), reading(0, None), reading(1, None), reading(1, None, 4.0), reading(30, 1.0),
             ("A", None, False, 1.0, 1.0, 2.0), ("A", None, False, 1.0, 1.0, 2.0), (None, None, None, None, None, None)]
    second = [reading(0, 99.0), reading(1, 3.0), reading(2, 8.0), reading(0, 4.0, building="B"), ("A", None, False, 1.0, 1.0, 3.0)]
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    params = spark.createDataFrame([], "building_id string, DATE_hour_week int, slope_Temp double, slope_Irrad double, intercept double, minimum double")
    stats = spark.createDataFrame([], "building_id string, mean_residual double, threshold double")
    for rows in (first, second):
        batch = readings(spark, rows)
        batch.coalesce(1).write.mode("append").parquet(folder)
        run_available(score_stream(read_reading_stream(spark, folder, batch.schema), params, stats), out, log)
    schema = T.StructType([*score_with_stored_moments(batch, params, stats).schema, T.StructField("status", T.StringType())])
    every = scored_readings(spark, out, schema, None)
    got = sorted((r["status"], str(r["building_id"]), str(r["DATE"])[8:13], str(r["Power"])) for r in every.collect())
    assert len(got) == len(first) + len(second)
    assert [g[1:] for g in got if g[0] == "scored"] == [
        ("A", "01 00", "7.0"), ("A", "01 01", "None"), ("A", "01 02", "8.0"), ("A", "02 06", "1.0"), ("B", "01 00", "4.0")]
    assert sorted(g[3] for g in got if g[0] == "repeat") == ["3.0", "5.0", "99.0", "None", "None"]
    assert sum(g[0] == "no_time" for g in got) == 4
