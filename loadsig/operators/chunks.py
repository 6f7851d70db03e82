"""Splitting long buildings for ordered row-level work.

Windows that look at neighbouring rows would put a whole building into one
task. Here rows get their ordinal within the building, are cut into chunks of
a fixed number of rows, and each chunk also receives the neighbouring rows it
needs (its halo). Results are identical to one window over the building as
long as the halo covers the reach of the computation.

Readings are unique per building and hour, so a reach of *h* hours is at most
*h* rows, and a slab of the calendar holds a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loadsig.functions.calendar import hour_number

SLAB_HOURS = 4 * 8766
CHUNK_ROWS = 4 * 8766


def with_row_index(df: DataFrame, slab_hours: int = SLAB_HOURS) -> DataFrame:
    """Add ``_hour`` (order key) and ``_row``, the ordinal in the building from 0.

    Rows are numbered inside calendar slabs; the slabs' counts, a tiny table,
    give the offsets.
    """
    df = df.withColumn("_hour", hour_number("DATE"))
    # rows without a time come first, in a slab of their own
    slab = F.coalesce(F.expr(f"_hour div {int(slab_hours)}"), F.lit(-(1 << 40)))
    sizes = df.groupBy("building_id", slab.alias("_slab")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("building_id").orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("building_id", "_slab", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("building_id", "_slab").orderBy("_hour")
    return (
        df.withColumn("_slab", slab)
        .join(offsets, ["building_id", "_slab"])
        .withColumn("_row", F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_slab", "_offset")
    )


def with_halo(indexed: DataFrame, before: int, after: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Copy rows near a chunk border into the neighbouring chunk.

    ``before`` rows ahead of a chunk and ``after`` rows behind it are added to
    it; ``_own`` tells the rows of the chunk from its halo.
    """
    chunk_rows = max(chunk_rows, before, after)
    own = F.expr(f"_row div {chunk_rows}")
    pos = F.col("_row") % chunk_rows
    targets = F.array_compact(
        F.array(
            own,
            F.when(pos >= chunk_rows - before, own + 1),
            F.when((pos < after) & (own > 0), own - 1),
        )
    )
    return (
        indexed.withColumn("_home", own)
        .withColumn("_chunk", F.explode(targets))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home", "_row")
    )


def chunked(df: DataFrame, before: int, after: int, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, WindowSpec]:
    """Rows with halo and the time-ordered window inside a chunk."""
    rows = with_halo(with_row_index(df), before, after, chunk_rows)
    return rows, Window.partitionBy("building_id", "_chunk").orderBy("_hour")


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the halo again."""
    return df.filter("_own").drop("_own", "_chunk", "_hour")
