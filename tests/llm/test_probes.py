"""Multiprobe hashing against brute force, and on odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadsig.llm import probes

SCHEMA = "vec_id long, embedding array<float>, label int, q string, v string, t string, cell string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x", "x") for i, v in vectors], SCHEMA)


def brute(vectors, is_query, k):
    """Per query, ids and scores of all candidates, best first."""
    good, out = {}, {}
    for i, v in vectors:
        usable = v is not None and v and None not in v and np.isfinite(v).all() and any(v)
        key = None if v is None else [float(np.float32(x)) if x is not None else None for x in v]
        if i is not None and usable:
            good[i] = min(good.get(i, key), key)
    for i, q in good.items():
        if is_query(i):
            scored = [(-sum((a * b for a, b in zip(q, x)), 0.0), j) for j, x in good.items() if j != i and len(x) == len(q)]
            out[i] = [(j, -s) for s, j in sorted(scored)][:k]
    return out


def found(result):
    out = {}
    for r in result.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_few_rows_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(15)] + [
        (15, None), (16, []), (17, [0.0] * 6), (18, [1.0, None] * 3), (19, [float("nan")] * 6), (20, [1.0, float("inf")] * 3),
        (21, [1.0, 2.0]), (24, [2.0, 1.0]), (None, [1.0] * 6), (3, [-9.0] * 6), (22, [1.0] * 6), (23, [1.0] * 6)]
    got = found(probes.nearest(frame(spark, vectors), F.col("vec_id") % 3 == 0, 20))
    want = brute(vectors, lambda i: i % 3 == 0, 20)
    want = {i: w for i, w in want.items() if w}
    assert {i: [j for j, _ in w] for i, w in got.items()} == {i: [j for j, _ in w] for i, w in want.items()}
    assert all(np.allclose([s for _, s in got[i]], [s for _, s in want[i]], rtol=1e-12) for i in want)


@pytest.mark.parametrize("longer", [1.0, 30.0])
def test_recall_with_a_dense_group_and_small_pieces(spark, longer, monkeypatch):
    monkeypatch.setattr(probes, "BLOCK_ROWS", 300)
    monkeypatch.setattr(probes, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    x[:500] = x[0] + 0.05 * rng.normal(size=(500, 24))  # a third of all rows in one place
    x[::7] *= longer  # inner product is not cosine
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(probes.nearest(frame(spark, vectors), F.col("vec_id") % 20 == 0, 20))
    want = brute(vectors, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    hits = [len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want]
    assert sum(hits) / 20 / len(hits) >= 0.9
    score = {(i, j): s for i, w in brute(vectors, lambda i: i % 20 == 0, 1500).items() for j, s in w}
    assert all(s == pytest.approx(score[i, j], rel=1e-12) for i, g in got.items() for j, s in g)


def test_all_rows_equal_and_empty(spark):
    same = frame(spark, [(i, [3.0, 4.0]) for i in range(40)])
    got = found(probes.nearest(same, F.col("vec_id") == 0, 20))
    assert got == {0: [(j, 25.0) for j in range(1, 21)]}
    assert probes.nearest(frame(spark, []), F.col("vec_id") == 0).collect() == []


def test_levels_reach_the_wanted_probability():
    """Planted neighbours of a cosine fall into visited buckets as often as wanted."""
    rng = np.random.default_rng(3)
    x = probes.unit(rng.normal(size=(4000, 32)))
    h = probes.Hashing(32, 4000, 1.0)
    p = h.project(x, False)
    h.centre, h.spread = h.lengthened(x, False).mean(axis=0), p.std(axis=0)
    q, other = x[:300], rng.normal(size=(300, 32))
    other = probes.unit(other - (other * q).sum(axis=1)[:, None] * q)
    near = h.buckets(0.6 * q + 0.8 * other)
    chance, gain = h.gains(q, np.full(300, 0.6))
    level = h.levels(chance, gain, 0.9)
    total = np.take_along_axis(gain, near[..., None], axis=-1)[..., 0].sum(axis=-1)
    assert abs((total >= level).any(axis=1).mean() - 0.9) < 0.06
    assert (np.diff(probes.normal_cdf(np.linspace(-5, 5, 99))) > 0).all()
