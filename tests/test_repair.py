"""Repair and chunking against plain Python on small fixtures."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from builders import READING_DDL, hour
from loadsig.functions.calendar import hour_number
from loadsig.operators import chunks
from loadsig.operators.repair import edges, mark_pending, repair, repair_passes, repair_schedule, trusted

DDL = READING_DDL + ", IS_Outlier boolean"


def brute_force(rows, passes, strict=False):
    """Direct evaluation of the rule, one building, rows sorted by hour."""
    rows = sorted(rows)
    n = [r[0] for r in rows]
    power = {r[0]: r[1] for r in rows}
    pending = {r[0]: r[1] is None or r[2] for r in rows}
    corrected, repaired = dict(power), {h: False for h in n}
    for pre, post in passes:
        before, place = dict(pending), {h: i for i, h in enumerate(n)}
        for h in n:
            i = place[h]
            free_before = i - pre < 0 or not before[n[i - pre]]
            free_after = i + post >= len(n) or not before[n[i + post]]
            edge = before[h] and free_before and free_after
            near = [h - pre, h + post]
            weeks = [h - 168, h + 168]
            corners = [w + d for w in weeks for d in (-pre, post)]
            good = all(before.get(x) is False for x in near + weeks + corners)
            if edge and good:
                values = [[power[x] for x in group] for group in (weeks, near, corners)]
                known = all(v is not None for group in values for v in group)
                corrected[h] = sum(values[0]) / 2 + sum(values[1]) / 2 - sum(values[2]) / 4 if known else None
            if before[h] and good and (edge or not strict):
                repaired[h], pending[h] = True, False
    return {h: (corrected[h], repaired[h]) for h in n}


def frame(spark, rows, building="A"):
    return spark.createDataFrame([(building, hour(h), False, 1.0, 0.0, p, bad) for h, p, bad in rows], DDL)


def as_dict(df, building="A"):
    got = df.filter(F.col("building_id") == building).select((hour_number("DATE") - 473352).alias("h"), "Power_corrected", "IS_Repaired")
    return {r["h"]: (r["Power_corrected"], r["IS_Repaired"]) for r in got.collect()}


def random_rows(seed, weeks=6, holes=0.08, absent=0.02):
    rng = random.Random(seed)
    rows, h = [], 0
    while h < weeks * 168:
        if rng.random() < absent:
            h += rng.randint(1, 30)
        length = rng.randint(1, 6) if rng.random() < holes else 0
        for j in range(length):
            rows.append((h + j, None if rng.random() < 0.7 else rng.randint(0, 50) * 1.0, True))
        h += length
        rows.append((h, float(rng.randint(0, 400)) / 4, False))
        h += 1
    return rows


def same(got, want):
    assert got.keys() == want.keys()
    for h in want:
        assert got[h][1] == want[h][1], h
        assert got[h][0] == (pytest.approx(want[h][0]) if want[h][0] is not None else None), h


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("passes", [[(1, 1)], [(2, 3), (1, 4)]])
def test_passes_match_brute_force(spark, passes, strict):
    rows = random_rows(7)
    got = repair_passes(frame(spark, rows), passes, strict=strict)
    same(as_dict(got), brute_force(rows, passes, strict))


def test_all_passes_match_brute_force(spark):
    rows, other = random_rows(3, weeks=9), random_rows(4, weeks=5)
    df = frame(spark, rows).unionByName(frame(spark, other, "B"))
    got = repair(df).cache()
    want = brute_force(rows, repair_schedule())
    assert any(r for _, r in want.values())
    same(as_dict(got), want)
    same(as_dict(got, "B"), brute_force(other, repair_schedule()))


def test_schedule():
    assert len(repair_schedule()) == 15
    assert repair_schedule(2) == [(1, 1), (1, 2), (2, 1)]


def test_weekly_linear_signal_is_restored(spark):
    def value(h):
        return (h % 168) * 2.0 + 0.5 * h

    holes, five = {200, 230, 231}, set(range(260, 265))
    long_gap = five | set(range(290, 296))
    rows = [(h, None if h in holes | long_gap or h == 0 else value(h), False) for h in range(168 * 3)]
    got = as_dict(repair(frame(spark, rows)))
    for h in holes:
        assert got[h] == (pytest.approx(value(h)), True), h
    # In longer gaps an hour may lean on one repaired before it, whose raw
    # value is still unknown; it is then marked without a value.
    assert all(got[h][1] and (got[h][0] is None or got[h][0] == pytest.approx(value(h))) for h in five)
    assert got[260][0] == pytest.approx(value(260))
    assert not got[0][1] and got[0][0] is None
    trusted = [h for h in range(168 * 3) if h not in holes | long_gap | {0}]
    assert all(got[h] == (value(h), False) for h in trusted)


def test_value_clipped_at_zero(spark):
    rows = [(h, None if h == 200 else (50.0 if h in (199 - 168, 201 - 168, 199 + 168, 201 + 168) else 1.0), False) for h in range(504)]
    assert as_dict(repair_passes(frame(spark, rows), [(1, 1)]))[200][0] == -48.0
    assert as_dict(repair_passes(frame(spark, rows), [(1, 1)], clip_at_zero=True))[200][0] == 0.0


def test_row_index_and_halo(spark):
    rows = [(h, 1.0 * h, False) for h in range(0, 900, 3)]
    df = frame(spark, rows).unionByName(frame(spark, rows[:50], "B"))
    indexed = chunks.with_row_index(df, slab_hours=100)
    order = Window.partitionBy("building_id").orderBy("DATE")
    wrong = indexed.withColumn("want", F.row_number().over(order) - 1).filter("want <> _row")
    assert wrong.count() == 0
    halo = chunks.with_halo(indexed, 7, 4, chunk_rows=60)
    assert halo.filter("_own").count() == df.count()
    seen = halo.groupBy("building_id", "_chunk").count().filter("building_id = 'A' AND _chunk = 2").first()["count"]
    assert seen == 60 + 7 + 4


def test_rows_without_a_time_are_left_alone(spark):
    """They are no anchors of each other or of timed rows, and keep all columns."""
    rows = random_rows(8, weeks=5)
    lost = [("A", None, False, 1.0, 0.0, p, bad) for p, bad in ((5.0, False), (None, False), (7.0, False), (3.0, True))] * 3
    df = frame(spark, rows).unionByName(spark.createDataFrame(lost, DDL)).withColumns(
        {"_timeless0": F.lit("x"), "parts": F.array(F.lit(1))})
    got = repair(df).cache()
    assert got.columns[:len(df.columns)] == df.columns and got.filter("_timeless0 = 'x' AND parts[0] = 1").count() == got.count()
    same(as_dict(got.filter("DATE IS NOT NULL")), brute_force(rows, repair_schedule()))
    left = got.filter("DATE IS NULL")
    assert left.count() == len(lost) and left.filter("IS_Repaired OR NOT Power_corrected <=> Power").count() == 0
    assert edges(mark_pending(df), 1, 1).filter("DATE IS NULL AND gap_edge").count() == 0
    assert trusted(mark_pending(df), 1, 1).filter("DATE IS NULL AND trusted").count() == 0
    assert repair(df.limit(0)).count() == 0
