"""Typed readers and writers for everything that is kept between steps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadsig.functions.signature import PARAMETER_DDL

ASSIGNMENT_DDL = "building_id string, DATE_YYYY_MM_DD date, cluster int"
PARAMETER_KEYS = ("DATE_hour_week", "ClusterHour", "ClusterHour_PRED")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet by building for the next step, or ``;`` CSV for export.

    Rows are clustered by building first so that each folder gets few files.
    AQE splits the partition of a very large building again.
    """
    if fmt == "csv":
        df.write.mode(mode).option("sep", ";").option("header", True).csv(path)
        return
    if fmt != "parquet":
        raise ValueError(f"unknown format {fmt!r}")
    df.hint("rebalance", "building_id").write.mode(mode).partitionBy("building_id").parquet(path)


def read_table(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(ddl)
    if fmt == "csv":
        return reader.option("sep", ";").option("header", True).csv(path)
    return reader.parquet(path)


def read_params(spark: SparkSession, path: str, key: str = "DATE_hour_week", fmt: str = "csv") -> DataFrame:
    """Model parameters by hour of week or by (actual or predicted) day type and hour.

    Files carry their size, so Spark broadcasts the table in later joins when
    it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    if key not in PARAMETER_KEYS:
        raise ValueError(f"key must be one of {PARAMETER_KEYS}")
    return read_table(spark, path, f"building_id string, {key} int, {PARAMETER_DDL}", fmt)


def read_assignments(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Day-type assignments: one row per building and day."""
    return read_table(spark, path, ASSIGNMENT_DDL, fmt)


def save_model(tree: DataFrame, path: str, info: dict[str, str]) -> None:
    """Write the tree table and one row of training information."""
    tree.write.parquet(f"{path}/tree")
    rows = [(k, str(v)) for k, v in sorted(info.items())]
    rows.append(("saved_at", dt.datetime.now(dt.timezone.utc).isoformat()))
    tree.sparkSession.createDataFrame(rows, "name string, value string").coalesce(1).write.parquet(f"{path}/info")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    from loadsig.operators.classify import TREE_SCHEMA

    tree = spark.read.schema(TREE_SCHEMA).parquet(f"{path}/tree")
    info = spark.read.schema("name string, value string").parquet(f"{path}/info")
    return tree, {r["name"]: r["value"] for r in info.select("name", F.col("value")).collect()}
