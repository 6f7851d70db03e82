"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users; system turns stay system
turns and are nobody's perspective. The mask holds the offsets (code points, end
exclusive) of the contents that the assistant says, the parts to train on.

A dialogue is rendered in parts of at most ``PART_TURNS`` turns, numbered from 0,
so a conversation of any length is split; the parts concatenate to the whole.
Turns are numbered by a running total over range-sorted rows, so no task gathers
a conversation either.

Markers cannot be forged: ``<|`` in a role or text is rendered as ``<\\|``. Offsets
are those of the rendered text. A perspective bears the rendered name, so roles
that are rendered alike are one speaker.

Turns are ordered by turn number, role and text. A row that repeats a turn
exactly is rendered once. A null role is a speaker named ``unknown``, a null text
is empty, a null turn number comes first, and rows without ``conv_id`` form one
conversation. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadsig.llm.shared import running_total
from loadsig.session import materialise

PART_TURNS = 256
SYSTEM, UNKNOWN = "system", "unknown"


def _plain(column: str, default: str) -> Column:
    return F.replace(F.coalesce(column, F.lit(default)), F.lit("<|"), F.lit("<\\|"))


def numbered_parts(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``(conv_id, part, turns)`` with the turns of a part in order."""
    rows = turns.select("conv_id", "turn", _plain("role", UNKNOWN).alias("role"), _plain("text", "").alias("text"))
    once = rows.distinct().withColumn("one", F.lit(1))
    placed = running_total(once, ["conv_id"], ["turn", "role", "text"], "one", "at")
    part = ((F.col("at") - 1) / part_turns).cast("long")
    return placed.groupBy("conv_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))


def _rendered(turns: Column, speaker: Column) -> Column:
    """Struct of the text and the mask spans of one part."""
    def step(acc: Column, t: Column) -> Column:
        mine = t["role"] == speaker
        head = F.when(t["role"] == SYSTEM, F.lit("<|system|>\n")).when(mine, F.lit("<|assistant|>\n")).otherwise(
            F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n")))
        start = acc["at"] + F.char_length(head)
        end = start + F.char_length(t["text"])
        piece = F.concat(head, t["text"], F.lit("<|end|>\n"))
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((acc["at"] + F.char_length(piece)).alias("at"),
                        F.concat(acc["pieces"], F.array(piece)).alias("pieces"),
                        F.when(mine, F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"),
                     F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    return F.aggregate(turns, empty, step, lambda a: F.struct(
        F.array_join(a["pieces"], "").alias("text"), a["mask"].alias("mask")))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``(conv_id, perspective, part, n_turns, text, mask)``."""
    parts = materialise(numbered_parts(turns, part_turns), "parts")
    speakers = turns.select(F.col("conv_id").alias("conv"), _plain("role", UNKNOWN).alias("perspective"))
    speakers = speakers.filter(F.col("perspective") != SYSTEM).distinct()
    joined = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["conv"]))
    return joined.withColumn("r", _rendered(F.col("turns"), F.col("perspective"))).select(
        "conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), "r.text", "r.mask")
