"""Late and odd input: null times, unusual spellings, deep trees, missing folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from builders import reading, readings
from loadsig.functions.calendar import add_calendar
from loadsig.operators import classify, daytypes
from loadsig.operators.profiles import DAY
from loadsig.operators.repair import repair_pass
from loadsig.sources.readings import format_readings, read_readings, unreadable_values
from loadsig import session


def test_rows_without_a_time_are_kept(spark):
    rows = [reading(h, float(h)) for h in range(50)] + [("A", None, False, 1.0, 1.0, 2.0)]
    df = add_calendar(readings(spark, rows)).withColumn("IS_Outlier", F.lit(False))
    assert repair_pass(df, 1, 1).count() == 51


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "B7.csv").write_text(
        "Holiday;Power;Extra;Solar.Irradiation;Temperature;Hour_Day;Day_Month;Month;Year\n"
        "0.0;12.5;x;100;3.5;4;2;1;2024\nTrue;oops;y;;NaN;5;2;1;2024\n;1;z;0;1;6;2;1;2024\n")
    raw = read_readings(spark, str(tmp_path))
    got = [tuple(r) for r in raw.select("building_id", "Power", "Temperature", "Hour_Day").orderBy("Hour_Day").collect()]
    assert got[0] == ("B7", 12.5, 3.5, 4) and got[1][1] is None and got[2][1] == 1.0
    assert unreadable_values(spark, str(tmp_path)).first()["Power"] == 1
    stamped = raw.withColumn("Date", F.make_timestamp_ntz("Year", "Month", "Day_Month", "Hour_Day", F.lit(0), F.lit(0)))
    marks = [r["Holiday"] for r in format_readings(stamped).orderBy("DATE").collect()]
    assert marks == [False, True, True]


def test_prediction_goes_as_deep_as_the_tree(spark):
    days = spark.createDataFrame(
        [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i), 0.0, False, 1 + i, i % 7, True, (i // 2) % 2)
         for i in range(64)],
        f"building_id string, {DAY} date, Temperature double, Solar_Irradiation double, Holiday boolean, "
        "DATE_day_year int, DATE_day_week int, DATE_weekday boolean, cluster int")
    tree = classify.fit_tree(days, max_depth=7, min_leaf=1).cache()
    found = classify.predict_day_type(days, tree)
    assert tree.agg(F.max("depth")).first()[0] > 5
    nodes = {r["node"]: r for r in tree.collect()}
    for day in found.collect():
        at = 1
        while not nodes[at]["is_leaf"]:
            at = 2 * at + int(float(day[nodes[at]["feature"]]) > nodes[at]["threshold"])
        assert day["cluster_PRED"] == nodes[at]["prediction"]


def test_seeds_come_from_all_distinct_days(spark):
    zero = [0.0] * 24
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i),
             zero if i >= 51 else [float(i == h) + 0.01 * i for h in range(24)]) for i in range(1000)]
    points = spark.createDataFrame(rows, f"building_id string, {DAY} date, profile array<double>")
    for block_days in (1024, 300):
        sizes = {r["k"]: r["n"] for r in daytypes.kmeans_search(points, [10, 30], n_init=4, block_days=block_days)
                 .filter("n_days > 0").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert sizes == {10: 10, 30: 30}


def test_rounds_mean_the_same_for_one_and_many_blocks(spark):
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), [((i * 7 + h) % 11) / 10 + i % 5 for h in range(24)])
            for i in range(120)]
    points = spark.createDataFrame(rows, f"building_id string, {DAY} date, profile array<double>")
    for start in (points,):
        found = [daytypes.kmeans_search(start, [6], n_init=1, block_days=b, max_rounds=2)
                 .agg(F.round(F.max("wss"), 6), F.min("converged")).first() for b in (1024, 50)]
        assert found[0] == found[1]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError):
        session.checkpoint_root(Session())


def test_confusion_has_every_class_of_its_building(spark):
    days = spark.createDataFrame([("A", 0, 0), ("A", 4, 0), ("B", 1, 2)], "building_id string, cluster int, cluster_PRED int")
    cells = classify.confusion_cells(days)
    assert classify.confusion_long(cells).count() == 4 + 4
    assert classify.confusion_matrix(cells).columns[2:] == ["Predicted_0", "Predicted_1", "Predicted_2", "Predicted_4"]


