"""Small hand-made readings for tests."""

from __future__ import annotations

import datetime as dt

READING_DDL = ("building_id string, DATE timestamp_ntz, Holiday boolean, Temperature double, "
               "Solar_Irradiation double, Power double")
START = dt.datetime(2024, 1, 1)


def hour(n: int, start: dt.datetime = START) -> dt.datetime:
    return start + dt.timedelta(hours=n)


def reading(n: int, power, temperature=5.0, irradiation=0.0, building="A", holiday=False, start=START):
    return (building, hour(n, start), holiday, temperature, irradiation, power)


def readings(spark, rows):
    return spark.createDataFrame(rows, READING_DDL)
