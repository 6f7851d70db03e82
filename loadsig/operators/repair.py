"""Repair of missing or suspect hours from neighbouring hours and weeks.

A pass ``(pre, post)`` looks at hours that wait for repair and whose rows
``pre`` before and ``post`` behind do not wait. If the readings ``pre`` hours
before and ``post`` hours after, at the same hour of the previous and the next
week, and around those, are all trusted, the hour is replaced by

    mean of the two weekly neighbours + mean of the two hourly neighbours
    - mean of the four corners.

Anchor values are always the raw power, so only the waiting flags chain from
pass to pass.

The readings of a building meet once, in time order, as arrays (``hourly``); an
offset is found by binary search for all hours at once and serves every pass. One
exchange and one sort do for any number of passes. The arrays are bounded by the
calendar, since readings are unique per building and hour: 50 years are 438,000
rows.

A row without a time has no neighbours: it is no anchor, no gap edge, is never
repaired and is returned as it came. Such rows are not gathered by building.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadsig.functions.calendar import HOURS_PER_WEEK

MAX_GAP = 5


def repair_schedule(max_gap: int = MAX_GAP) -> list[tuple[int, int]]:
    """The single-hour pass, then every split of gaps of 2 .. ``max_gap`` hours."""
    return [(1, 1)] + [(pre, gap + 1 - pre) for gap in range(2, max_gap + 1) for pre in range(1, gap + 1)]


def mark_pending(df: DataFrame, outlier: str = "IS_Outlier") -> DataFrame:
    """Missing, suspect and waiting flags.

    An unknown outlier flag counts as an outlier; without such a column nothing
    is one.
    """
    is_outlier = F.coalesce(F.col(outlier), F.lit(True)) if outlier in df.columns else F.lit(False)
    done = F.coalesce(F.col("IS_Repaired"), F.lit(False)) if "IS_Repaired" in df.columns else F.lit(False)
    missing = F.col("Temperature").isNull() | F.col("Solar_Irradiation").isNull() | F.col("Power").isNull()
    df = df.withColumns({"IS_Outlier": is_outlier, "IS_Missing": missing, "IS_Repaired": done})
    df = df.withColumn("IS_Missing_Outlier", F.col("IS_Missing") | F.col("IS_Outlier"))
    return df.withColumn("IS_Repair_Pending", F.col("IS_Missing_Outlier") & ~F.col("IS_Repaired"))


class Hours:
    """The hours of one building in order. Without times no row has neighbours."""

    def __init__(self, dates: pa.Array | None, n: int) -> None:
        self.n, self.timed = n, dates is not None
        self.hour = dates.cast(pa.int64()).to_numpy() // 3_600_000_000 if self.timed else np.empty(0, np.int64)
        self._found: dict[int, np.ndarray] = {}

    def at(self, hours: int) -> np.ndarray:
        """Place of the row exactly ``hours`` later (negative: earlier); ``n``
        where there is none."""
        if hours not in self._found:
            place = np.full(self.n, self.n)
            if self.timed:
                wanted = self.hour + hours
                first = np.minimum(np.searchsorted(self.hour, wanted), self.n - 1)
                place = np.where(self.hour[first] == wanted, first, self.n)
            self._found[hours] = place
        return self._found[hours]

    def value(self, values: np.ndarray, hours: int) -> np.ndarray:
        """Values at an offset, NaN where there is no row."""
        return np.append(values, np.nan)[self.at(hours)]

    def true(self, flags: np.ndarray, hours: int) -> np.ndarray:
        """Flags at an offset, false where there is no row."""
        return np.append(flags, False)[self.at(hours)]

    def rows_away(self, flags: np.ndarray, rows: int) -> np.ndarray:
        """Flags of the row so many rows behind; false beyond either end."""
        out = np.zeros(self.n, bool)
        if self.timed and abs(rows) < self.n:
            if rows > 0:
                out[:-rows] = flags[rows:]
            else:
                out[-rows:] = flags[:rows]
        return out


def hourly(df: DataFrame, fn: Callable[[Hours, pa.Table], dict[str, pa.Array]], fields: T.StructType) -> DataFrame:
    """Add the columns ``fields`` that ``fn`` makes from the readings of a building
    in time order. Rows without a time come in groups of their own."""
    names = set(df.columns)
    mark = next(f"_timeless{n}" for n in range(len(names) + 1) if f"_timeless{n}" not in names)
    new = {f.name for f in fields}
    kept = [f.name for f in df.schema if f.name not in new]
    schema = T.StructType([f for f in df.schema if f.name not in new] + list(fields))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        timed = key[1].as_py() < 0
        if timed:
            table = table.sort_by("DATE")
        dates = table.column("DATE").combine_chunks() if timed else None
        added = fn(Hours(dates, table.num_rows), table)
        return pa.Table.from_arrays([*(table.column(c) for c in kept), *(added[f.name] for f in fields)],
                                    names=[*kept, *(f.name for f in fields)])

    timeless = F.when(F.col("DATE").isNull(), F.spark_partition_id()).otherwise(-1)
    return df.withColumn(mark, timeless).groupBy("building_id", mark).applyInArrow(run, schema)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy().astype(np.float64)


def flags(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).fill_null(False).to_numpy(zero_copy_only=False).astype(bool) if table.num_rows else np.empty(0, bool)


def doubles(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def offsets(df: DataFrame, wanted: dict[str, int], column: str = "Power") -> DataFrame:
    """Add, for each name, the value exactly so many hours later (negative:
    earlier); null if there is no row."""
    fields = T.StructType([T.StructField(name, T.DoubleType()) for name in wanted])

    def add(hours: Hours, table: pa.Table) -> dict[str, pa.Array]:
        values = numbers(table, column)
        return {name: doubles(hours.value(values, h)) for name, h in wanted.items()}

    return hourly(df, add, fields)


def anchor_offsets(pre: int, post: int) -> dict[str, list[int]]:
    week = HOURS_PER_WEEK
    return {
        "weekly": [-week, week],
        "hourly": [-pre, post],
        "corners": [-week - pre, -week + post, week - pre, week + post],
    }


def gap_edge(hours: Hours, pending: np.ndarray, pre: int, post: int) -> np.ndarray:
    """Waiting, while the rows ``pre`` before and ``post`` behind are not.
    Rows, not hours: rows beyond either end count as not waiting."""
    if not hours.timed:
        return np.zeros(hours.n, bool)
    return pending & ~hours.rows_away(pending, -pre) & ~hours.rows_away(pending, post)


def anchors_trusted(hours: Hours, pending: np.ndarray, pre: int, post: int) -> np.ndarray:
    """All eight anchor hours exist and do not wait for repair."""
    trusted = np.ones(hours.n, bool)
    for group in anchor_offsets(pre, post).values():
        for h in group:
            trusted &= hours.true(~pending, h)
    return trusted


def interpolated(hours: Hours, power: np.ndarray, pre: int, post: int) -> np.ndarray:
    """The value of a pass; NaN where an anchor is unknown."""
    def mean(offsets_: list[int]) -> np.ndarray:
        values = [hours.value(power, h) for h in offsets_]
        return sum(values[1:], values[0]) / len(values)

    anchors = anchor_offsets(pre, post)
    return mean(anchors["weekly"]) + mean(anchors["hourly"]) - mean(anchors["corners"])


def edges(df: DataFrame, pre: int, post: int) -> DataFrame:
    """Add ``gap_edge`` to rows with ``IS_Repair_Pending``."""
    fields = T.StructType([T.StructField("gap_edge", T.BooleanType())])
    return hourly(df, lambda hours, table: {
        "gap_edge": pa.array(gap_edge(hours, flags(table, "IS_Repair_Pending"), pre, post))}, fields)


def trusted(df: DataFrame, pre: int, post: int) -> DataFrame:
    """Add ``trusted``, whether all anchors of a pass are, to rows with
    ``IS_Repair_Pending``."""
    fields = T.StructType([T.StructField("trusted", T.BooleanType())])
    return hourly(df, lambda hours, table: {
        "trusted": pa.array(anchors_trusted(hours, flags(table, "IS_Repair_Pending"), pre, post))}, fields)


def repair_passes(
    df: DataFrame,
    passes: list[tuple[int, int]],
    strict: bool = False,
    clip_at_zero: bool = False,
) -> DataFrame:
    """Run passes in order on readings that are unique per building and hour.

    ``strict`` marks a row as repaired only where it also got a value.
    """
    df = mark_pending(df)
    if "Power_corrected" not in df.columns:
        df = df.withColumn("Power_corrected", F.col("Power"))
    fields = T.StructType([T.StructField("Power_corrected", T.DoubleType()), T.StructField("IS_Repaired", T.BooleanType())])

    def run(hours: Hours, table: pa.Table) -> dict[str, pa.Array]:
        power, corrected = numbers(table, "Power"), numbers(table, "Power_corrected")
        pending, repaired = flags(table, "IS_Repair_Pending"), flags(table, "IS_Repaired")
        for pre, post in passes:
            edge, good = gap_edge(hours, pending, pre, post), anchors_trusted(hours, pending, pre, post)
            value = interpolated(hours, power, pre, post)
            if clip_at_zero:
                value = np.where(value < 0, 0.0, value)
            corrected = np.where(edge & good, value, corrected)
            done = pending & good & edge if strict else pending & good
            repaired, pending = repaired | done, pending & ~done
        return {"Power_corrected": doubles(corrected), "IS_Repaired": pa.array(repaired)}

    return hourly(df, run, fields).drop("IS_Repair_Pending")


def repair_pass(df: DataFrame, pre: int = 1, post: int = 1, **options) -> DataFrame:
    """One pass; ``(1, 1)`` is the repair of single hours."""
    return repair_passes(df, [(pre, post)], **options)


def repair(df: DataFrame, max_gap: int = MAX_GAP, **options) -> DataFrame:
    """The full sequence for gaps of up to ``max_gap`` hours."""
    return repair_passes(df, repair_schedule(max_gap), **options)


def repair_summary(df: DataFrame) -> DataFrame:
    """Repaired hours of each building, and those left without a value because
    an anchor had none."""
    done = F.col("IS_Repaired")
    return df.groupBy("building_id").agg(
        F.sum(done.cast("long")).alias("n_repaired"),
        F.sum((done & F.col("Power_corrected").isNull()).cast("long")).alias("n_without_value"),
        F.sum((F.col("IS_Missing_Outlier") & ~done).cast("long")).alias("n_pending"),
    )
