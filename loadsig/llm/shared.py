"""Helpers of the training-data operators: tables, distributed running totals
and connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadsig.session import materialise, scratch_path

MOST_BUCKETS = 50_000  # Spark takes up to 100,000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 500, size: int = 8 << 20) -> None:
    """Let Spark hand texts to Python in batches of at most so many rows and
    bytes, so that a worker's memory does not follow the length of documents.
    Smaller settings of the session stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return freed memory to the system. A Python worker stays after its task,
    and what it only has freed would be held beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def lean(parts: Iterator) -> Iterator:
    """The parts; when all are made, the memory freed by then is given back."""
    yield from parts
    give_back()


def bucketed(df: DataFrame, key: str, n: int, label: str) -> DataFrame:
    """``df`` written to the shared folder in ``n`` buckets by ``key`` and read
    back: grouping it by the key needs no shuffle. The name by which Spark
    writes buckets is dropped again; the files stay."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(min(n, MOST_BUCKETS), key).option("path", scratch_path(spark, label)).format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equality of the key columns in which nulls are equal."""
    on = F.lit(True)
    for c in columns:
        on = on & a[c].eqNullSafe(b[c])
    return on


def with_own_names(docs: DataFrame, needed: list[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fn`` of ``docs`` whose columns beside ``needed`` have names that nothing
    else uses; afterwards they have their own again. A column named like one that
    ``fn`` adds is replaced by it."""
    others = [c for c in docs.columns if c.lower() not in {n.lower() for n in needed}]
    hidden = {c: f"_own_{i}_of_{len(others)}" for i, c in enumerate(others)}
    out = fn(docs.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in docs.columns]))
    back = {h: c for c, h in hidden.items()}
    added = {c.lower() for c in out.columns if c not in back}
    return out.select(*[F.col(c).alias(back.get(c, c)) for c in out.columns if c not in back or back[c].lower() not in added])


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``keys`` up
    to and including this one, in the order of ``order``.

    No task sees a whole key: rows are range-sorted over all partitions, each
    partition is summed, and the totals of the earlier partitions are added.
    Rows that are equal in keys and order share the total of all of them.
    """
    ranged = materialise(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    part = [*keys, "_part"]
    sums = ranged.groupBy(part).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum"), "offsets"
    )
    here = Window.partitionBy(*part).orderBy(*order)
    joined = ranged.join(before, same(ranged, before, part)).select(
        *[ranged[c] for c in ranged.columns], before["_before"]
    )
    return joined.withColumn(name, F.col("_before") + F.sum(value).over(here)).drop("_before", "_part")


def lowest(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: Column) -> DataFrame:
    """The ``n`` first rows of every key in the given order.

    Each key is cut into ``SALTS`` parts by a hash of ``spread``; the first rows
    of a key are among the first of its parts. So the task that decides sees at
    most ``SALTS * n`` rows of a key, however many rows or tasks there are.
    """
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), spread), F.lit(SALTS)))
    for by in ([*keys, "_salt"], keys):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        rows = rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return rows.drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)``: one row ``(node, component)`` for
    every node that has an edge; the component is its smallest node.

    Alternating large and small stars: each round aggregates the smallest
    neighbour of every node and joins it back, so no neighbourhood is gathered.
    Null ends and loops are left out.
    """
    links = materialise(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a < b").distinct(), "links",
    )
    state = _fingerprint(links)
    while True:
        links = materialise(_small_star(_large_star(links)), "links")
        now = _fingerprint(links)
        if now == state:
            return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        state = now


def _fingerprint(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _large_star(links: DataFrame) -> DataFrame:
    """Tie the larger neighbours of each node to its smallest neighbour."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()
