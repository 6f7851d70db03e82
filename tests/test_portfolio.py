"""The whole analysis on two small buildings."""

import math
import random

import pytest

from builders import reading, readings
from loadsig.plans.portfolio import characterise
from loadsig.plans.scoring import predict_load


def rows(building, weeks=5, seed=0):
    """Cold weekdays peak in the morning, weekends in the evening; one hour in
    fifty is missing and a few are far off."""
    rng = random.Random(seed)
    out = []
    for h in range(weeks * 168):
        hour, day = h % 24, h // 24
        weekend = day % 7 > 4
        t = 3.0 + 6.0 * math.sin(day / 6) + 3.0 * math.sin((hour - 9) / 24 * 2 * math.pi)
        i = max(0.0, 300.0 * math.sin((hour - 6) / 12 * math.pi)) if 6 <= hour <= 18 else 0.0
        peak = 25.0 * math.exp(-((hour - (19 if weekend else 8)) ** 2) / 8)
        power = max(4.0, 40.0 + peak - 1.2 * t - 0.02 * i) + rng.uniform(-1, 1)
        if h > 200 and h < weeks * 168 - 200 and h % 50 == 7:
            power = None if h % 100 == 7 else power * 6
        out.append(reading(h, power, t, i, building))
    return out


@pytest.fixture(scope="module")
def base(spark):
    lost = [("A", None, False, 1.0, 0.0, p) for p in (5.0, None, 7.0, 9.0)]
    return readings(spark, rows("A") + rows("B", seed=1) + lost)


@pytest.fixture(scope="module")
def result(base):
    return characterise(base, k_max=4, n_init=3)


def test_models_and_metrics(result):
    assert result.params_initial.count() == result.params_tow.count() == 2 * 168
    metrics = {(r["building_id"], r["model"]): r for r in result.metrics.collect()}
    assert len(metrics) == 6
    for r in metrics.values():
        assert r["n"] > 700 and r["mae"] <= r["rmse"]
        assert r["resid_1h"] == pytest.approx(r["mae"] * r["n"])
        assert r["mae"] < 8.0


def test_repair_touches_only_untrusted_rows(result):
    lost = result.repaired.filter("DATE IS NULL")
    assert lost.count() == 4 and lost.filter("IS_Repaired").count() == 0
    bad = result.repaired.filter("NOT IS_Missing_Outlier AND (IS_Repaired OR NOT Power_corrected <=> Power)")
    assert bad.count() == 0
    assert result.repaired.filter("IS_Repaired AND Power IS NULL AND Power_corrected IS NOT NULL").count() > 0


def test_day_types_and_tree(result):
    assert result.chosen_k.filter("k >= 3").count() == 2
    assert result.days.filter("cluster_PRED IS NULL").count() == 0
    assert result.report.filter("label = 'accuracy'").count() == 2
    keys = result.params_cluster.select("building_id", "ClusterHour").distinct().count()
    assert keys == result.params_cluster.count() == 24 * result.assignments.select("building_id", "cluster").distinct().count()


def test_views_and_lasting_tables(spark, result, tmp_path):
    tested = result.days.filter("is_test").count()
    assert result.confusion.groupBy().sum("n").first()[0] == tested
    assert result.outlier_months.groupBy().sum("Total_Count").first()[0] == result.scored.filter("DATE IS NOT NULL").count()
    assert result.monthly.select("building_id").distinct().count() == 2
    result.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "metrics")).count() == 6
    assert len(list((tmp_path / "out").iterdir())) == 19 + 9
    assert result.runs.count() == 2 * 4 and result.runs.filter("NOT converged").count() == 0
    for name, view in result.views().items():
        assert view.select("building_id").distinct().count() == 2, name


def test_prediction_from_the_results(base, result):
    params = result.params_cluster_pred.drop("loss", "bound", "n_rows", "status")
    got = predict_load(base, result.tree, params)
    assert got.count() == base.filter("DATE IS NOT NULL").count()
    assert got.filter("predicted_load IS NULL OR predicted_load < 0").count() == 0
