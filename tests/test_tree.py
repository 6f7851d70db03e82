"""The decision tree against a direct greedy search, and the hold-out."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loadsig.operators import classify
from loadsig.operators.profiles import DAY
from loadsig.sources.tables import load_model, save_model

DDL = (f"building_id string, {DAY} date, Temperature double, Solar_Irradiation double, Holiday boolean, "
       "DATE_day_year int, DATE_day_week int, DATE_weekday boolean, cluster int")


def rule(t, weekday):
    return 2 if t > 12.0 else (0 if weekday else 1)


def days(n=200, building="A", noise=0.0, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        day = dt.date(2022, 1, 1) + dt.timedelta(days=i)
        t, weekday = round(rng.uniform(-5, 25), 2), day.weekday() < 5
        kind = rng.randint(0, 2) if rng.random() < noise else rule(t, weekday)
        rows.append((building, day, t, round(rng.uniform(0, 5000), 1), i % 11 == 0, i + 1, day.weekday(), weekday, kind))
    return rows


def gini(rows):
    n = len(rows)
    return 1 - sum((sum(r[8] == c for r in rows) / n) ** 2 for c in range(3))


def greedy(rows, node=1, depth=0, out=None):
    """Direct greedy search: {node: (days, feature, threshold)}."""
    out = {} if out is None else out
    best = None
    if depth < 5 and gini(rows) > 0:
        for f, name in enumerate(classify.FEATURES):
            values = sorted({float(r[2 + f]) for r in rows})
            for a, b in zip(values, values[1:]):
                left = [r for r in rows if float(r[2 + f]) <= a]
                right = [r for r in rows if float(r[2 + f]) > a]
                if min(len(left), len(right)) < 5:
                    continue
                gain = gini(rows) - (len(left) * gini(left) + len(right) * gini(right)) / len(rows)
                key = (-round(gain, 9), f, (a + b) / 2)
                if best is None or key < best[0]:
                    best = (key, name, (a + b) / 2, left, right)
    out[node] = (len(rows), best and best[1], best and best[2])
    if best:
        greedy(best[3], node * 2, depth + 1, out)
        greedy(best[4], node * 2 + 1, depth + 1, out)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(days() + days(150, "B", noise=0.4, seed=9), DDL).cache()


@pytest.fixture(scope="module")
def tree(table):
    return classify.fit_tree(table).cache()


@pytest.mark.parametrize("building,rows", [("A", days()), ("B", days(150, "B", noise=0.4, seed=9))])
def test_tree_matches_direct_search(tree, building, rows):
    got = {r["node"]: (r["n_days"], r["feature"], r["threshold"]) for r in tree.filter(F.col("building_id") == building).collect()}
    want = greedy(rows)
    assert got.keys() == want.keys()
    for node, (n, feature, threshold) in want.items():
        assert got[node][:2] == (n, feature)
        assert got[node][2] == (pytest.approx(threshold) if feature else None)


def test_rule_is_learned(table, tree):
    predicted = classify.predict_day_type(table, tree)
    assert predicted.filter("building_id = 'A' AND cluster <> cluster_PRED").count() == 0
    assert predicted.count() == table.count()


def test_prediction_follows_the_nodes(table, tree):
    nodes = {r["node"]: r for r in tree.filter("building_id = 'B'").collect()}
    for r in classify.predict_day_type(table, tree).filter("building_id = 'B'").collect():
        node = 1
        while not nodes[node]["is_leaf"]:
            node = node * 2 + (float(r[nodes[node]["feature"]]) > nodes[node]["threshold"])
        assert nodes[node]["prediction"] == r["cluster_PRED"]


def test_model_round_trip(spark, tree, tmp_path):
    save_model(tree, str(tmp_path / "m"), {"seed": 42})
    loaded, info = load_model(spark, str(tmp_path / "m"))
    assert sorted(map(str, loaded.collect())) == sorted(map(str, tree.collect()))
    assert info["seed"] == "42"


def test_published_split_sizes(spark):
    sizes, start = {0: 129, 1: 66, 2: 126}, dt.date(2019, 1, 1)
    kinds = [c for c, n in sizes.items() for _ in range(n)]
    rows = [("A", start + dt.timedelta(days=i), c) for i, c in enumerate(kinds)]
    df = spark.createDataFrame(rows, f"building_id string, {DAY} date, cluster int")
    split = classify.stratified_split(df)
    got = {r["cluster"]: r["n"] for r in split.filter("is_test").groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 26, 1: 13, 2: 26}
    again = classify.stratified_split(df.repartition(7)).filter("is_test").select(DAY)
    assert again.exceptAll(split.filter("is_test").select(DAY)).count() == 0
