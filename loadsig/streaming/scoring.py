"""Scoring of arriving readings with a fixed model.

Deliveries can be late, out of order, repeat an hour with the same or another
power, or lack the time. Each arriving row leaves with a status:

* ``scored``: the first delivery of its building and hour. Within one micro-batch
  the largest power is first, unknown power last, then the larger temperature and
  irradiation, then a holiday;
* ``repeat``: a later delivery of an hour;
* ``no_time``: a row without a time.

So the rows in are the rows of the three states together. The state is one number
per building and day, a bit for each hour seen; no reading is too late. Batches
are written under their number, so a restarted run replaces what it had begun.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from loadsig.functions.calendar import add_calendar
from loadsig.operators.outliers import Z95, score_readings

TIMELESS_SALTS = 1024


def score_with_stored_moments(readings: DataFrame, params: DataFrame, stats: DataFrame) -> DataFrame:
    """Fit, residual and outlier flag from parameters and stored residual
    moments ``(building_id, mean_residual, threshold)``. Works on streams and
    on tables; a ``status`` column is kept."""
    scored = score_readings(add_calendar(readings), params)
    far = F.abs(F.col("Power_residuals") - F.col("mean_residual")) > F.col("threshold")
    status = ["status"] if "status" in readings.columns else []
    return scored.join(stats.select("building_id", "mean_residual", "threshold"), "building_id", "left").select(
        "building_id", "DATE", "Power", "Power_fitted", "Power_residuals",
        F.coalesce(far, F.lit(False)).alias("is_outlier"), *status,
    )


def mark_repeats(readings: DataFrame) -> DataFrame:
    """Add ``status`` to a stream of readings; see the module."""
    schema = T.StructType([*readings.schema, T.StructField("status", T.StringType())])
    order = [c for c in ("Power", "Temperature", "Solar_Irradiation", "Holiday") if c in readings.columns]

    def first_of_hour(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[1] is None:
            for rows in parts:
                yield rows[readings_columns].assign(status="no_time")
            return
        # rows of one building and day in one micro-batch
        rows = pd.concat(list(parts)).sort_values(["_hour", *order], ascending=[True] + [False] * len(order),
                                                  na_position="last", kind="stable")
        seen = state.get[0] if state.exists else 0
        known = rows["_hour"].map(lambda h: bool(seen >> int(h) & 1))
        again = known | rows.duplicated("_hour")
        for h in rows["_hour"].unique():
            seen |= 1 << int(h)
        state.update((seen,))
        yield rows[readings_columns].assign(status=again.map({True: "repeat", False: "scored"}))

    readings_columns = readings.columns
    # rows without a time need no state and are spread
    salt = F.when(F.col("DATE").isNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in readings_columns]), F.lit(TIMELESS_SALTS)))
    keyed = readings.withColumns({"_day": F.to_date("DATE"), "_hour": F.hour("DATE"), "_salt": F.coalesce(salt, F.lit(-1))})
    return keyed.groupBy("building_id", "_day", "_salt").applyInPandasWithState(
        first_of_hour, schema, "seen long", "append", "NoTimeout")


def score_stream(readings: DataFrame, params: DataFrame, stats: DataFrame) -> DataFrame:
    """Streaming form; every arriving row is scored and carries its status."""
    return score_with_stored_moments(mark_repeats(readings), params, stats)


def scored_readings(spark: SparkSession, out: str, schema: T.StructType, status: str | None = "scored") -> DataFrame:
    """What was scored so far, each reading of a building and hour once; the
    rows of another status, or of all (``None``)."""
    written = spark.read.schema(schema).parquet(f"{out.rstrip('/')}/rows/batch=*")
    return written if status is None else written.filter(F.col("status") == status)


def read_reading_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Readings that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_batch(scored: DataFrame, batch: int, out: str) -> None:
    """The rows of a micro-batch, and what it adds to the residual moments."""
    folder = out.rstrip("/")
    scored.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
    # read back, so that the stateful step runs once
    rows = scored.sparkSession.read.schema(scored.schema).parquet(f"{folder}/rows/batch={batch}")
    r = F.col("Power_residuals")
    rows.filter("status = 'scored' AND Power_residuals IS NOT NULL").groupBy("building_id").agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.var_pop(r).alias("variance"),
    ).write.mode("overwrite").parquet(f"{folder}/moments/batch={batch}")


def stream_moments(spark: SparkSession, out: str) -> DataFrame:
    """Residual moments of all readings scored so far, from those of the batches
    (means and variances are combined, so large sums do not cancel)."""
    parts = spark.read.schema("building_id string, n long, mean double, variance double").parquet(
        f"{out.rstrip('/')}/moments/batch=*")
    by = Window.partitionBy("building_id")
    total = F.sum("n").over(by)
    mean = F.sum(F.col("n") * F.col("mean")).over(by) / total
    spread = F.sum(F.col("n") * (F.col("variance") + (F.col("mean") - F.col("all")) * (F.col("mean") - F.col("all"))))
    return (
        parts.withColumn("all", mean).groupBy("building_id")
        .agg(F.sum("n").alias("n_residuals"), F.max("all").alias("mean_residual"), F.sqrt(spread / F.sum("n")).alias("std_residual"))
        .withColumn("threshold", F.lit(Z95) * F.col("std_residual"))
    )


def run_available(scored: DataFrame, out: str, checkpoint: str) -> None:
    """Score everything that has arrived and stop; restarts continue where the
    last run ended."""
    query = (
        scored.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, out))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
