"""Mixing sources to target weights by weighted fair queueing.

Sources weigh 5, 2, 1, repeating in the order of their code points, null last.
They share ``budget_share`` times all words by weight; a source's target stops
at ``repeats`` times its words, and the excess is shared again by weight until
no target is above.

Each source queues its documents in the order of a hash of their id, ``repeats``
rounds after each other. A document's virtual finish time is the number of its
source's words up to its end, divided by the source's target. All documents are
range-sorted by it, and the mix ends where the running total of words reaches
the budget. Since a queue is taken from its front, the mix is a bound per source
and round, and each document is decided by its own place: the texts are neither
shuffled nor joined by id.

A null text has no words. Rows with equal ids (also null ids) share a place and
are taken together. Empty tables give empty mixes; a source without words has
target 0 and stays. Extra columns are kept by ``mix`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadsig.llm.shared import running_total, with_own_names
from loadsig.session import materialise

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
REPEATS = 2
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(id_column: Column) -> Column:
    """Place of a document in its source's queue."""
    return F.md5(F.concat(F.lit("mix|"), F.coalesce(id_column.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size, weight, target)`` from one row per source.

    Water-filling: sources fill up in the order of cap per weight, and the level
    at which the budget is used up is found by running sums over that order.
    The windows see one short row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]),
                        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", pick).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(share),
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(onward),
        "rank": F.row_number().over(order),
    }).withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    level = F.min_by("level", F.when(F.col("ratio") >= F.col("level"), F.col("rank"))).over(everything)
    return rows.withColumn("target", F.least("cap", F.coalesce(level, F.col("ratio")) * F.col("weight"))).select(
        "source", "source_size", "weight", "target")


def queue_bounds(sized: DataFrame, aims: DataFrame, share: float = BUDGET_SHARE, repeats: int = REPEATS) -> DataFrame:
    """``(source, bounds)``: for each round, the last place that is taken."""
    queued = sized.groupBy("source", "place").agg(F.sum("size").alias("size"))
    queued = running_total(queued, ["source"], ["place"], "size", "ended")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    queued = queued.withColumn("round", rounds)
    aim = aims.withColumnRenamed("source", "_source")
    finish = F.when(F.col("target") > 0,
                    (F.col("ended") + F.col("round") * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    timed = queued.join(aim, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", "place", "round", "size", finish.alias("finish"))
    total = running_total(timed, [], ["finish", "source", "round", "place"], "size", "total")
    budget = aims.agg(F.floor(F.sum("source_size") * F.lit(share)).alias("budget"))
    taken = total.join(budget, F.col("total") <= F.col("budget"))
    last = taken.groupBy("source", "round").agg(F.max("place").alias("place"))
    return last.groupBy("source").agg(
        F.map_from_entries(F.collect_list(F.struct("round", "place"))).alias("bounds"))


def copies(own_place: Column, bounds: Column, repeats: int = REPEATS) -> Column:
    """How often a document is taken."""
    return sum((F.coalesce((own_place <= F.try_element_at(bounds, F.lit(r))).cast("int"), F.lit(0))
                for r in range(repeats)), F.lit(0))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", place(F.col("doc_id")).alias("place"), words(F.col("text")).alias("size"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, repeats: int = REPEATS):
    """Written sizes of all documents, targets and bounds of all sources."""
    sized = materialise(_sized(docs), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = materialise(targets(per_source, weights, share, repeats), "targets")
    bounds = materialise(queue_bounds(sized, aims, share, repeats), "bounds")
    return sized, aims, bounds


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per document: its words, its source's words and target, how
    often it is taken, and the words that the mix takes of it."""
    sized, aims, bounds = plan(docs, weights, share, repeats)
    named = aims.withColumnRenamed("source", "_s").join(
        bounds.withColumnRenamed("source", "_b"), F.col("_s").eqNullSafe(F.col("_b")), "left"
    ).select("_s", "source_size", "target", "bounds")
    joined = sized.join(named, F.col("source").eqNullSafe(F.col("_s")))
    return joined.withColumn("copies", copies(F.col("place"), F.col("bounds"), repeats)).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated as often as they are taken."""
    return with_own_names(docs, ["doc_id", "text", "source"], lambda d: _mixed(d, weights, share, repeats))


def _mixed(docs: DataFrame, weights, share: float, repeats: int) -> DataFrame:
    _, _, bounds = plan(docs, weights, share, repeats)
    named = bounds.select(F.col("source").alias("_source"), F.col("bounds").alias("_bounds"))
    times = copies(place(docs["doc_id"]), F.col("_bounds"), repeats)
    return (
        docs.join(named, docs["source"].eqNullSafe(F.col("_source")))
        .withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)))))
        .filter(times > 0).select(*[docs[c] for c in docs.columns])
    )
