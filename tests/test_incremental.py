"""Only changed buildings are computed again."""

import pytest
from pyspark.sql import functions as F

from builders import reading, readings
from loadsig.plans.incremental import current, fingerprints, refresh
from loadsig.sources.readings import union_buildings

DDL = "building_id string, total double, run int"


def totals(run):
    return lambda rows: rows.groupBy("building_id").agg(F.sum("Power").alias("total"), F.lit(run).alias("run"))


def states(df):
    return {r["building_id"]: r["state"] for r in df.collect()}


def test_refresh(spark, tmp_path):
    folder = str(tmp_path)
    rows = [reading(h, float(h), building=b) for h in range(30) for b in "ABC"]
    base = readings(spark, rows)
    assert states(refresh(base, folder, totals(1))) == dict.fromkeys("ABC", "new")
    assert states(refresh(base.orderBy(F.rand(1)).repartition(7), folder, totals(2))) == dict.fromkeys("ABC", "same")
    more = readings(spark, [r for r in rows if r[0] != "C"] + [reading(31, 5.0, building="B"), reading(0, 1.0, building="D")])

    def broken(_):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        refresh(more, folder, broken)
    assert states(refresh(more, folder, totals(3))) == {"A": "same", "B": "changed", "C": "gone", "D": "new"}
    got = {r["building_id"]: (r["total"], r["run"]) for r in current(spark, folder, DDL).collect()}
    assert got == {"A": (435.0, 1), "B": (440.0, 3), "D": (1.0, 3)}


def test_a_null_and_a_value_have_other_prints(spark):
    a, b = (readings(spark, [reading(0, p)]) for p in (None, 0.0))
    assert fingerprints(a).first()["print"] != fingerprints(b).first()["print"]


def test_names_of_a_union(spark):
    two = readings(spark, [reading(0, 1.0, building="x"), reading(0, 2.0, building="y")])
    got = union_buildings({"p": two, "q": two.filter("building_id = 'x'").drop("building_id")})
    assert sorted(r["building_id"] for r in got.collect()) == ["p/x", "p/y", "q"]
