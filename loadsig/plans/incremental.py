"""Refreshing a portfolio: only buildings whose readings have changed are computed
again, and only their partitions are replaced.

Every building has a fingerprint, the number and the sum of the hashes of its
rows, so neither their order nor their files matter. Results are Parquet by
building under ``results``; the fingerprints that they belong to are under
``fingerprints/run=N``. A run writes results first and its fingerprints last: if it
breaks off, the next one finds the old fingerprints and does the same work again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loadsig.session import materialise

_PRINT = "building_id string, n_rows long, print decimal(38,0), run int"


def fingerprints(readings: DataFrame) -> DataFrame:
    """Number of rows and sum of row hashes of each building; one partial
    aggregation over the readings."""
    columns = [F.col(f"`{c}`") for c in sorted(readings.columns) if c != "building_id"]
    hashed = F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\\0")) for c in columns]).cast("decimal(38,0)")
    return readings.groupBy("building_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(hashed).alias("print"))


def stored_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprints of the last whole run; none before the first."""
    try:
        every = spark.read.schema(_PRINT).parquet(f"{folder.rstrip('/')}/fingerprints")
    except AnalysisException:
        return spark.createDataFrame([], _PRINT)
    last = every.agg(F.max("run")).first()[0]
    return every.filter(F.col("run") == F.lit(last))


def refresh(readings: DataFrame, folder: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bring the results up to date. ``compute`` makes a table with ``building_id``
    from readings, building by building.

    Returns ``(building_id, state)``: ``new``, ``changed``, ``same`` or ``gone``.
    The results of buildings that are gone stay, and are not read by ``current``.
    """
    spark, folder = readings.sparkSession, folder.rstrip("/")
    before = materialise(stored_fingerprints(spark, folder), "before")
    now = materialise(fingerprints(readings), "now")
    old = before.select(F.col("building_id").alias("_b"), F.col("n_rows").alias("_n"), F.col("print").alias("_p"))
    state = (F.when(F.col("_b").isNull(), "new").when(F.col("building_id").isNull(), "gone")
             .when((F.col("n_rows") == F.col("_n")) & (F.col("print") == F.col("_p")), "same").otherwise("changed"))
    states = materialise(now.join(old, F.col("building_id") == F.col("_b"), "full").select(
        F.coalesce("building_id", "_b").alias("building_id"), state.alias("state")), "states")
    todo = states.filter("state IN ('new', 'changed')").select("building_id")
    if not todo.isEmpty():
        result = compute(readings.join(todo, "building_id", "left_semi"))
        result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("building_id").parquet(
            f"{folder}/results")
    run = (before.agg(F.max("run")).first()[0] or 0) + 1
    now.write.parquet(f"{folder}/fingerprints/run={run}")
    return states


def current(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """The results of the buildings of the last run; ``ddl`` has their columns."""
    rows = spark.read.schema(ddl).parquet(f"{folder.rstrip('/')}/results")
    return rows.join(stored_fingerprints(spark, folder).select("building_id"), "building_id", "left_semi")
