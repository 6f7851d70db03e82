"""Day types on three clear shapes; blocks, silhouette and Lloyd steps."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadsig.operators import daytypes
from loadsig.operators.profiles import DAY

DDL = f"building_id string, {DAY} date, profile array<double>"
SHAPES = [
    [math.exp(-((h - 8) ** 2) / 8) for h in range(24)],
    [math.exp(-((h - 19) ** 2) / 8) for h in range(24)],
    [0.5 + 0.4 * math.sin(h / 24 * 2 * math.pi) for h in range(24)],
]


def days(n, building="A", noise=0.03, seed=1):
    rng = random.Random(seed)
    return [(building, dt.date(2022, 1, 1) + dt.timedelta(days=i),
             [x + rng.uniform(-noise, noise) for x in SHAPES[i % 3]]) for i in range(n)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(days(60) + days(45, "B", seed=2), DDL).cache()


def partition_of(df, building):
    groups = {}
    for r in df.filter(F.col("building_id") == building).collect():
        groups.setdefault(r["cluster"], set()).add(r[DAY])
    return sorted(map(sorted, groups.values()))


def expected(n):
    start = dt.date(2022, 1, 1)
    return sorted(sorted(start + dt.timedelta(days=i) for i in range(s, n, 3)) for s in range(3))


@pytest.mark.parametrize("block_days", [1024, 17])
def test_three_shapes_are_found(points, block_days):
    got = daytypes.kmeans_days(points, 3, n_init=4, block_days=block_days).cache()
    assert partition_of(got, "A") == expected(60)
    assert partition_of(got, "B") == expected(45)


def test_search_agrees_across_block_sizes(points):
    def table(block_days):
        rows = daytypes.kmeans_search(points, [1, 2, 4], n_init=3, block_days=block_days).collect()
        return {(r["building_id"], r["k"], r["cluster"]): (r["n_days"], round(r["wss"], 6)) for r in rows}

    one = table(1024)
    assert table(20) == one
    wss = {k: v[1] for k, v in one.items() if k[0] == "A"}
    assert wss[("A", 1, 0)] > wss[("A", 2, 0)] > wss[("A", 4, 0)]
    assert sum(v[0] for k, v in one.items() if k[:2] == ("A", 4)) == 60


def test_choice_of_k(points):
    assignment, chosen, runs = daytypes.day_types(points, k_max=5, n_init=4)
    assert runs.filter("converged").count() == runs.count() > 0
    assert {r["building_id"]: (r["k_silhouette"], r["k"]) for r in chosen.collect()} == {"A": (3, 3), "B": (3, 3)}
    assert partition_of(assignment, "A") == expected(60)


def test_elbow_takes_the_first_large_drop(spark):
    rows = [("A", 1, 100.0), ("A", 2, 98.0), ("A", 3, 40.0), ("A", 4, 38.0), ("B", 1, 5.0), ("B", 2, 5.0)]
    df = spark.createDataFrame(rows, "building_id string, k int, wss double")
    got = {r["building_id"]: r["k_elbow"] for r in daytypes.elbow_k(df).collect()}
    assert got == {"A": 3, "B": 3}


def brute_silhouette(rows, labels):
    total = 0.0
    for i, a in enumerate(rows):
        by = {}
        for j, b in enumerate(rows):
            by.setdefault(labels[j], []).append(math.dist(a, b))
        own = by[labels[i]]
        if len(own) == 1:
            continue
        inner = sum(own) / (len(own) - 1)
        outer = min(sum(v) / len(v) for k, v in by.items() if k != labels[i])
        total += (outer - inner) / max(inner, outer)
    return total / len(rows)


@pytest.mark.parametrize("block_days", [1024, 9])
def test_silhouette_matches_all_pairs(spark, block_days):
    rows = days(31, noise=0.3)
    labels = [[i % 3, min(i, 1), i // 16] for i in range(31)]
    df = spark.createDataFrame([(*r, lab) for r, lab in zip(rows, labels)], DDL + ", labels array<int>")
    got = {r["k"]: r["silhouette"] for r in daytypes.silhouette(df, [3, 2, 4], block_days).collect()}
    for j, k in enumerate([3, 2, 4]):
        assert got[k] == pytest.approx(brute_silhouette([r[2] for r in rows], [lab[j] for lab in labels]), abs=1e-7)


def test_lloyd_steps_never_raise_the_sum_of_squares(points):
    start = points.withColumn("cluster", F.dayofyear(DAY) % 4)
    centres = daytypes.update_centres(start)
    costs = []
    for _ in range(4):
        assigned = daytypes.assign_nearest(points, centres).cache()
        costs.append({r["building_id"]: r["c"] for r in assigned.groupBy("building_id").agg(F.sum("dist2").alias("c")).collect()})
        centres = daytypes.update_centres(assigned)
    for a, b in zip(costs, costs[1:]):
        assert all(b[k] <= a[k] + 1e-9 for k in a)


def test_fewer_days_than_types(spark):
    df = spark.createDataFrame(days(2), DDL)
    assert daytypes.kmeans_days(df, 3, n_init=2).count() == 2


def test_bounded_steps_equal_plain_steps():
    """Skipping days by the triangle inequality changes nothing."""
    rng = np.random.default_rng(11)
    for k in (1, 2, 5, 20):
        points = rng.normal(size=(300, 24)) + 3 * rng.integers(0, 3, size=(300, 1))
        centres = points[:k].copy()
        got = daytypes._lloyd(points, centres, 40)
        label = None
        for step in range(40):
            label = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.array([points[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(k)])
            if np.abs(moved - centres).max() <= daytypes.TOLERANCE or step == 39:
                break
            centres = moved
        assert (got[1] == np.bincount(label, minlength=k)).all()
        assert np.allclose(got[3], centres) and got[2].sum() == pytest.approx(((points - centres[label]) ** 2).sum())
