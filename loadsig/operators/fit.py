"""Fitting the signature model of every group.

The loss is the sum of absolute residuals, minimised inside bounds that follow
from the group's own range. The relational part (bounds, scoring a coarse set
of candidates, picking the best) uses built-in functions. For the full fit Spark
shuffles the readings once by group and each task searches the
boxes of its groups by branch and bound with numpy (``certify.py``). It is
deterministic, and every fit comes with a proven lower bound of the loss.

Groups are bounded by the calendar: one building has at most 53 readings a year
for an hour of the week and 366 for an hour of a day type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loadsig.functions.signature import PARAMETERS
from loadsig.operators import certify

WIDE_FACTOR = 4.0
CANDIDATE_WORK = 1 << 15  # candidates times readings per step
GROUPS = 256  # groups whose results are kept as Python objects at a time


def fit_bounds(df: DataFrame, keys: list[str], bounds: str = "reference") -> DataFrame:
    """Lower and upper limit of the four parameters of each group.

    ``"reference"``: slopes down to minus the maximum power over the range of
    the temperature or the maximum irradiation, intercept and minimum up to
    the maximum power. ``"wide"`` stretches slopes and intercept fourfold.
    Groups with zero power get zero bounds, groups without usable power null.
    """
    wide = {"reference": 1.0, "wide": WIDE_FACTOR}[bounds]
    t, i, p = F.col("t_range"), F.col("irrad_max"), F.col("power_max")
    irrad = F.max("Solar_Irradiation")
    return (
        df.groupBy(keys)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.max("Power").alias("power_max"),
            F.when(irrad != 0, irrad).otherwise(1.0).alias("irrad_max"),
            F.coalesce(F.max("Temperature") - F.min("Temperature"), F.lit(0.0)).alias("t_range"),
        )
        .withColumn("power_max", F.when(p >= 0, p))
        .withColumns(
            {
                "slope_Temp_min": F.when(t != 0, -p / F.nullif(t, F.lit(0.0))).otherwise(-p) * wide,
                "slope_Irrad_min": -p / i * wide,
                "intercept_max": p * wide,
                "minimum_max": p,
            }
        )
        .drop("t_range", "irrad_max")
    )


def candidate_fractions(levels: int = 3) -> list[tuple[int, float, float, float, float]]:
    """A regular set of positions inside the bounds, numbered."""
    steps = [j / (levels - 1) for j in range(levels)]
    grid = [(a, b, c, d) for a in steps for b in steps for c in steps for d in steps]
    return [(n, *g) for n, g in enumerate(grid)]


def score_candidates(df: DataFrame, bounds: DataFrame, keys: list[str], levels: int = 3) -> DataFrame:
    """Loss of every candidate parameter set for every group.

    Readings are brought together by group once. In the task a line, one of
    ``levels`` ^ 3, is compared with the readings once for all values of the
    minimum: a reading has the error of the line where the line is the larger and
    that of the minimum elsewhere. One row per group and candidate leaves.

    Errors are added as whole millionths: integer sums do not depend on the order
    of the rows, so neither does the winner. A group without bounds has null
    losses.
    """
    edges = ["slope_Temp_min", "slope_Irrad_min", "intercept_max", "minimum_max"]
    known = df.filter(F.col("Power").isNotNull()).select(*keys, "Temperature", "Solar_Irradiation", "Power")
    rows = spread(known.join(bounds.select(*keys, *edges), keys), keys)
    schema = T.StructType(
        [df.schema[k] for k in keys] + [T.StructField("candidate", T.IntegerType())]
        + [T.StructField(name, T.DoubleType()) for name in ["loss", *PARAMETERS]])
    share = np.array([c[1:] for c in candidate_fractions(levels)])
    number = list(range(len(share)))

    def score(t: np.ndarray, i: np.ndarray, p: np.ndarray, *limits: np.ndarray) -> list[list]:
        limit = np.array([v[0] for v in limits])
        if np.isnan(limit).any():
            return [number, *[[None] * len(share)] * 5]
        theta = share * limit + 0.0
        return [number, candidate_losses(theta, t, i, p, levels).tolist(), *theta.T.tolist()]

    return map_groups(rows.sortWithinPartitions(*keys), keys, ["Temperature", "Solar_Irradiation", "Power", *edges], score, schema)


def candidate_losses(theta: np.ndarray, t: np.ndarray, i: np.ndarray, p: np.ndarray, levels: int) -> np.ndarray:
    """Losses of parameter rows of which each ``levels`` in turn differ in the
    minimum only. Readings without weather have a fitted value of 0."""
    def millionths(error: np.ndarray) -> np.ndarray:
        return np.floor(np.abs(error) * 1e6 + 0.5)

    blind = np.isnan(t) | np.isnan(i)
    without = millionths(p[blind]).sum()
    t, i, p = t[~blind], i[~blind], p[~blind]
    lines, (minima, which) = theta[::levels, :3, None], np.unique(theta[:, 3], return_inverse=True)
    total = np.zeros((len(lines), levels))
    step = max(1, CANDIDATE_WORK // len(theta))
    for at in range(0, len(p), step):
        power = p[at:at + step]
        line = lines[:, 2] + lines[:, 0] * t[at:at + step] + lines[:, 1] * i[at:at + step]
        line_error = millionths(np.maximum(line, 0.0) - power)
        floor_error = millionths(np.maximum(minima, 0.0)[:, None] - power)[which].reshape(*total.shape, -1)
        over = line[:, None] > theta[:, 3].reshape(*total.shape, 1)
        total += np.where(over, line_error[:, None], floor_error).sum(axis=2)
    return (total.ravel() + without) / 1e6


def best_candidate(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest loss per group; equal losses go to the lower candidate number."""
    order = F.struct(F.round("loss", 6), F.col("candidate"))
    chosen = F.min_by(F.struct("candidate", "loss", *PARAMETERS), order)
    return scored.groupBy(keys).agg(chosen.alias("c")).select(*keys, "c.*")


def fit_changepoint(df: DataFrame, keys: list[str], bounds: str = "reference", effort: int = certify.EFFORT) -> DataFrame:
    """Fitted parameters, loss, ``bound`` and status of every group.

    No parameters inside the bounds have a loss below ``bound``; how near it
    comes to the loss depends on ``effort``, boxes times readings per group
    (``certify.FULL_EFFORT`` proves most fits to a few per cent, 0 only searches).

    ``status``: ``ok``; ``all_zero`` (maximum power 0: parameters 0); or
    ``no_power`` (no power at all, or only negative: parameters null).
    """
    wide = {"reference": 1.0, "wide": WIDE_FACTOR}[bounds]
    data = df.select(*keys, "DATE", "Temperature", "Solar_Irradiation", "Power")
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField(name, T.DoubleType()) for name in [*PARAMETERS, "loss", "bound"]]
        + [T.StructField("n_rows", T.LongType()), T.StructField("status", T.StringType())]
    )

    def fit_group(t: np.ndarray, i: np.ndarray, p: np.ndarray) -> list[list]:
        params, loss, bound, status = fit_arrays(t, i, p, wide, effort)
        return [[v] for v in (*params, loss, bound, len(p), status)]

    rows = spread(data, keys).sortWithinPartitions(*keys, F.col("DATE").asc_nulls_last())
    return map_groups(rows, keys, ["Temperature", "Solar_Irradiation", "Power"], fit_group, schema)


def map_groups(rows: DataFrame, keys: list[str], columns: list[str], fn: Callable[..., list[list]], schema: T.StructType) -> DataFrame:
    """``fn`` of the columns of each group, as arrays with NaN for null; it returns
    the columns that follow the keys in ``schema``.

    The rows of a group must follow each other in one partition. Groups are found in
    batches of many, since a call of its own per group takes Spark about a
    millisecond; a group that a batch ends in waits for the next one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            starts = _starts(held, keys)
            if len(starts) > 1:
                yield from results(held, starts)
                # a copy, so that the rows already done do not stay in memory
                held = held.take(pa.array(np.arange(starts[-1], held.num_rows)))
        if held is not None and held.num_rows:
            yield from results(held, [0, held.num_rows])

    def results(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        arrays = [_column(table, c) for c in columns]
        fields = [*(table.schema.field(k) for k in keys),
                  *(pa.field(f.name, to_arrow_type(f.dataType)) for f in schema[len(keys):])]
        for first in range(0, len(starts) - 1, GROUPS):
            out = [[] for _ in fields]
            for at, end in zip(starts[first:first + GROUPS], starts[first + 1:]):
                values = fn(*(a[at:end] for a in arrays))
                names = [[table.column(k)[at].as_py()] * len(values[0]) for k in keys]
                for column, more in zip(out, [*names, *values]):
                    column.extend(more)
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip(out, fields)], schema=pa.schema(fields))

    return rows.mapInArrow(run, schema)


def _starts(table: pa.Table, keys: list[str]) -> list[int]:
    """Where a group begins; null is a key as any other."""
    new = np.arange(table.num_rows) == 0
    for k in keys:
        code = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new).tolist()


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition by key with a fixed number of partitions.

    The groups of a partition are fitted in one task. Fitting is bound by arithmetic,
    not by bytes, so adaptive coalescing, which goes by bytes, must not merge
    the groups into a few tasks.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.float64)


def fit_arrays(t: np.ndarray, i: np.ndarray, p: np.ndarray, wide: float = 1.0, effort: int = certify.EFFORT):
    """Parameters (in the order of ``PARAMETERS``), loss, its lower bound and
    status of one group."""
    nothing = (None, None, None, None)
    known = ~np.isnan(p)
    p_max = p[known].max() if known.any() else np.nan
    if np.isnan(p_max) or p_max < 0:
        return nothing, None, None, "no_power"
    if p_max == 0:
        loss = float(np.abs(p[known]).sum())
        return (0.0, 0.0, 0.0, 0.0), loss, loss, "all_zero"
    i_max = np.nanmax(i) if (~np.isnan(i)).any() else 0.0
    t_range = np.nanmax(t) - np.nanmin(t) if (~np.isnan(t)).any() else 0.0
    lower = np.array([-p_max * wide / (t_range or 1.0), -p_max * wide / (i_max or 1.0), 0.0, 0.0])
    upper = np.array([0.0, 0.0, p_max * wide, p_max])
    # where irradiation is negative throughout, its limit is above 0
    lower, upper = np.minimum(lower, upper), np.maximum(lower, upper)
    weather = known & ~np.isnan(t) & ~np.isnan(i)
    blind_loss = float(np.abs(p[known & ~weather]).sum())
    best, loss, bound = certify.solve(t[weather], i[weather], p[weather], lower, upper, effort=effort)
    return tuple(float(v) + 0.0 for v in best), loss + blind_loss, bound + blind_loss, "ok"
