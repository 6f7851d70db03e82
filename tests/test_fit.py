"""The fit against known truth, coarse candidates and special groups."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from builders import START, reading, readings
from loadsig.functions.calendar import add_calendar
from loadsig.operators import certify
from loadsig.operators.fit import (best_candidate, candidate_fractions, candidate_losses, fit_bounds, fit_changepoint, map_groups,
                                   score_candidates, spread)
from loadsig.sources.fixtures import events_readings

KEY = ["building_id", "DATE_hour_week"]


def truth_rows(hours, weeks=52, building="A", s_temp=-1.0, s_irrad=-0.02, intercept=30.0, minimum=6.0):
    rng = random.Random(5)
    rows = []
    for h in hours:
        for w in range(weeks):
            t = 8.0 - 14.0 * math.cos(2 * math.pi * w / 52) + rng.uniform(-3, 3)
            i = 0.0 if h % 24 < 6 else rng.uniform(0, 400)
            p = max(minimum + h % 3, intercept + h % 5 + s_temp * t + s_irrad * i)
            rows.append(reading(h + 168 * w, p, t, i, building))
    return rows


@pytest.fixture(scope="module")
def known(spark):
    return add_calendar(readings(spark, truth_rows(range(0, 48, 3)))).cache()


def test_known_truth(known):
    power = {r["DATE_hour_week"]: r["s"] for r in known.groupBy("DATE_hour_week").agg(F.sum("Power").alias("s")).collect()}
    fits = fit_changepoint(known, KEY).collect()
    assert len(fits) == 16
    for r in fits:
        assert r["status"] == "ok" and r["n_rows"] == 52
        assert r["loss"] <= 0.01 * power[r["DATE_hour_week"]]


def test_never_worse_than_the_candidates_and_inside_bounds(known):
    bounds = fit_bounds(known, KEY)
    coarse = best_candidate(score_candidates(known, bounds, KEY), KEY).select(*KEY, F.col("loss").alias("coarse"))
    joined = fit_changepoint(known, KEY).join(coarse, KEY).join(bounds.drop("n_rows"), KEY)
    assert joined.filter("loss > coarse + 1e-6").count() == 0
    eps = 1e-9
    for r in joined.collect():
        assert r["slope_Temp_min"] - eps <= r["slope_Temp"] <= 0
        assert r["slope_Irrad_min"] - eps <= r["slope_Irrad"] <= 0
        assert 0 <= r["intercept"] <= r["intercept_max"] + eps
        assert 0 <= r["minimum"] <= r["minimum_max"] + eps


def test_order_and_other_buildings_do_not_matter(spark, known):
    def table(df):
        return {r["DATE_hour_week"]: tuple(r)[2:] for r in df.filter("building_id = 'A'").collect()}

    plain = table(fit_changepoint(known, KEY))
    assert table(fit_changepoint(known.orderBy(F.rand(3)).repartition(5), KEY)) == plain
    other = add_calendar(readings(spark, truth_rows([0, 3], building="B", intercept=90.0)))
    assert table(fit_changepoint(known.unionByName(other), KEY)) == plain


def test_steep_truth_needs_wide_bounds(spark):
    df = add_calendar(readings(spark, truth_rows([12], s_temp=-4.0, intercept=60.0, minimum=8.0)))
    total = df.agg(F.sum("Power")).first()[0]
    narrow, wide = (fit_changepoint(df, KEY, b).first()["loss"] for b in ("reference", "wide"))
    assert wide < narrow and wide <= 0.02 * total


def test_special_groups(spark):
    rows = [reading(168 * w, 0.0) for w in range(4)]
    rows += [reading(168 * w + 1, None) for w in range(4)]
    rows += [reading(168 * w + 2, -3.0) for w in range(4)]
    rows += [reading(168 * w + 3, 7.0, 5.0, 0.0) for w in range(4)]
    rows += [reading(168 * w + 4, 7.0, None, None) for w in range(4)]
    got = {r["DATE_hour_week"]: r for r in fit_changepoint(add_calendar(readings(spark, rows)), KEY).collect()}
    assert [got[h]["status"] for h in range(5)] == ["all_zero", "no_power", "no_power", "ok", "ok"]
    assert [got[0][c] for c in ("slope_Temp", "slope_Irrad", "intercept", "minimum", "loss")] == [0.0] * 5
    assert got[1]["slope_Temp"] is None and got[2]["loss"] is None
    assert got[3]["loss"] == pytest.approx(0.0) and got[3]["slope_Irrad"] == 0.0
    assert got[4]["loss"] == pytest.approx(28.0)


def test_bounds_of_constant_temperature(spark):
    df = add_calendar(readings(spark, [reading(0, 8.0, 5.0), reading(168, 4.0, 5.0)]))
    row = fit_bounds(df, KEY).first()
    assert (row["slope_Temp_min"], row["slope_Irrad_min"], row["intercept_max"]) == (-8.0, -8.0, 8.0)


def test_bound_is_proven_and_close():
    """No parameters of a fine grid beat the bound, and full effort leaves little open."""
    rng = np.random.default_rng(4)
    t, i = rng.uniform(-10, 30, 40), rng.uniform(0, 600, 40)
    p = np.abs(np.maximum(40.0, 90 - 1.5 * t - 0.03 * i) + rng.normal(0, 8, 40))
    lower, upper = np.array([-p.max() / np.ptp(t), -p.max() / i.max(), 0, 0]), np.array([0, 0, p.max(), p.max()])
    x = np.stack([t, i, np.ones(40)], axis=1)
    best, loss, bound = certify.solve(t, i, p, lower, upper, effort=certify.FULL_EFFORT)
    assert loss == pytest.approx(certify.losses(best[None], x, p)[0]) and 0.8 * loss < bound <= loss
    theta = lower + (upper - lower) * rng.uniform(size=(20_000, 4))
    near = np.clip(best + 0.02 * (upper - lower) * rng.normal(size=(20_000, 4)), lower, upper)
    assert min(certify.losses(theta, x, p).min(), certify.losses(near, x, p).min()) >= bound
    weak = certify.solve(t, i, p, lower, upper, effort=0)
    assert weak[2] <= bound + 1e-9 and weak[1] <= 1.01 * loss


def test_box_bounds_hold_inside_every_box():
    rng = np.random.default_rng(5)
    x = np.stack([rng.uniform(-10, 30, 30), rng.uniform(0, 600, 30), np.ones(30)], axis=1)
    p = rng.uniform(0, 100, 30)
    low = np.array([-3.0, -0.2, 0.0, 0.0]) + rng.uniform(size=(300, 4)) * np.array([3.0, 0.2, 90.0, 90.0])
    high = low + rng.uniform(size=(300, 4)) ** 3 * np.array([1.0, 0.1, 30.0, 30.0])
    bound, at_centre, corner, cut = certify.box_bounds(low, high, x, p)
    for _ in range(50):
        inside = low + rng.uniform(size=low.shape) * (high - low)
        assert (certify.losses(inside, x, p) >= bound - 1e-6).all()
    assert (certify.losses(corner, x, p) >= bound - 1e-6).all() and (at_centre >= bound - 1e-6).all()


def test_outliers_do_not_move_the_fit():
    rng = np.random.default_rng(6)
    t, i = rng.uniform(-10, 30, 60), rng.uniform(0, 600, 60)
    p = np.maximum(45.0, 90 - 1.5 * t - 0.03 * i)
    p[:6] += 30
    lower, upper = np.array([-p.max() / np.ptp(t), -p.max() / i.max(), 0, 0]), np.array([0, 0, p.max(), p.max()])
    best, loss, _ = certify.solve(t, i, p, lower, upper)
    assert best == pytest.approx([-1.5, -0.03, 90.0, 45.0], abs=1e-3) and loss == pytest.approx(180.0, abs=0.01)


def test_hours_of_a_building_are_no_broadcast(spark, tmp_path):
    """Two events a building make 4,000 hours: Spark takes them for a tiny table."""
    events = [(u, START + dt.timedelta(hours=h), "view", 2.0) for u in range(0, 1500, 150) for h in (0, 3999)]
    events += [(0, None, "view", 1.0), (None, START, "view", 1.0)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(events, "user_id bigint, ts timestamp_ntz, event_type string, value double").write.parquet(path)
    rows = add_calendar(events_readings(spark, str(tmp_path)))
    scores = score_candidates(rows, fit_bounds(rows, KEY), KEY)
    assert len(scores.collect()) == 81 * (2 * 10 + 1)
    final = scores._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert re.findall(r"(\w+)Join \[building_id#\d+, DATE#\d+\]", final) == ["SortMerge"] * 2
    assert rows.count() == 40_001


@pytest.mark.parametrize("n", [0, 1, 52, 2000])
def test_candidate_losses_are_those_of_each_candidate(n):
    rng = np.random.default_rng(n)
    t, i, p = rng.uniform(-10, 30, n), rng.uniform(0, 600, n), rng.uniform(-5, 100, n)
    t[::9], i[::13] = np.nan, np.nan
    theta = np.array([c[1:] for c in candidate_fractions(3)]) * np.array([-3.0, -0.2, 100.0, 100.0])
    fitted = np.maximum(np.maximum(theta[:, 2:3] + theta[:, :1] * t + theta[:, 1:2] * i, theta[:, 3:]), 0.0)
    millionths = np.floor(np.abs(np.where(np.isnan(t) | np.isnan(i), 0.0, fitted) - p) * 1e6 + 0.5)
    assert (candidate_losses(theta, t, i, p, 3) == millionths.sum(axis=1) / 1e6).all()


def test_box_bounds_hold_for_any_weights_and_margins():
    """Where a limit cuts a margin off, no parameters in it have a loss below the limit."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.uniform(-10, 30, 30), rng.uniform(0, 600, 30), np.ones(30)], axis=1)
    p = rng.uniform(0, 100, 30)
    low = np.array([-3.0, -0.2, 0.0, 0.0]) + rng.uniform(size=(300, 4)) * np.array([3.0, 0.2, 90.0, 90.0])
    high = low + rng.uniform(size=(300, 4)) ** 3 * np.array([1.0, 0.1, 30.0, 30.0])
    low[:20, 1] = high[:20, 1]
    for limit in (500.0, 1500.0):
        tight_low, tight_high = low.copy(), high.copy()
        bound = certify.balanced_bounds(tight_low, tight_high, x, p, rng.uniform(-1, 1, 30), limit)[0]
        assert (tight_low >= low).all() and (tight_high <= high).all() and (tight_low <= tight_high + 1e-12).all()
        cut = 0
        for _ in range(50):
            inside = low + rng.uniform(size=low.shape) * (high - low)
            loss = certify.losses(inside, x, p)
            out = ((inside < tight_low) | (inside > tight_high)).any(axis=1)
            assert (loss >= bound - 1e-6).all() and (loss[out] >= limit - 1e-6).all()
            cut += out.sum()
        assert cut > 0


def test_few_boxes_prove_a_fit(monkeypatch):
    """The fits of ``d7_fit_changepoint``: 226 readings of a model, some 40 above it."""
    boxes, bounds = [], certify.balanced_bounds
    monkeypatch.setattr(certify, "balanced_bounds", lambda low, *more: boxes.append(len(low)) or bounds(low, *more))
    rng = np.random.default_rng(9)
    for _ in range(8):
        t, i = rng.uniform(-12, 32, 226), rng.uniform(0, 790, 226)
        p = np.maximum(92.0, 104 - 1.5 * t - 0.03 * i) + 40.0 * (rng.uniform(size=226) < 0.05)
        lower, upper = np.array([-p.max() / np.ptp(t), -p.max() / i.max(), 0, 0]), np.array([0, 0, p.max(), p.max()])
        best, loss, bound = certify.solve(t, i, p, lower, upper, effort=certify.FULL_EFFORT)
        assert best == pytest.approx([-1.5, -0.03, 104.0, 92.0], abs=1e-4) and 0.98 * loss < bound <= loss
    assert sum(boxes) / 8 < 1000, boxes


def test_groups_are_whole_across_batches(spark):
    """Groups of 1 to 40 rows with batches of 7; null is a key as any other."""
    rows = [(None if b == 2 else f"B{b}", None if h == 3 else h, float(n)) for b in range(4) for h in range(5) for n in range((b * 5 + h) * 2 + 1)]
    df = spark.createDataFrame(rows + [("X", 1, None)], "building_id string, hour int, v double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        keys = ["building_id", "hour"]
        schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType())])
        once = map_groups(spread(df, keys).sortWithinPartitions(*keys), keys, ["v"], lambda v: [[len(v)], [None if np.isnan(v).all() else v.sum()]], schema)
        got = sorted(map(tuple, once.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = df.groupBy(keys).agg(F.count(F.lit(1)), F.sum("v")).collect()
    assert got == sorted(map(tuple, want), key=str) and len(got) == 21
