"""Removal of repeated passages: sliding spans of sentences.

Texts are cut into sentences after ``. ! ?`` with white space, and at line ends.
From every sentence the shortest run of at least ``LEAST_SENTENCES`` sentences
and ``LEAST_WORDS`` words is hashed, forward and backward, so a passage of twice
that length is covered from end to end wherever it starts. A single sentence of
``LONG_SENTENCE`` words is a run of its own. Runs are compared over all
documents; all but the first of equal runs (smallest id, then position) are
repeats, and the sentences that they cover are removed with the white space
behind them.

Words are separated by ASCII white space; letter case counts. Null and empty
texts are returned as they are. Rows that repeat an id are told apart by their
text; equal rows are one document, so they do not remove each other. Rows
without id take part after all others. Extra columns are kept by ``dedup``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadsig.llm.shared import bounded_batches, with_own_names
from loadsig.session import materialise

LEAST_SENTENCES, LEAST_WORDS, LONG_SENTENCE = 2, 24, 48
_END = re.compile(r"(?<=[.!?])[ \t\r\f\v]+|[ \t\r\f\v]*\n\s*")


def sentences(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, next)`` of the sentences of a text; ``next`` is where the
    white space behind the sentence ends."""
    out, at = [], 0
    for m in _END.finditer(text):
        if m.start() > at:
            out.append((at, m.start(), m.end()))
        elif out:
            out[-1] = (*out[-1][:2], m.end())
        at = m.end()
    if at < len(text):
        out.append((at, len(text), len(text)))
    return out


def spans(words: list[list[str]]) -> list[tuple[int, int]]:
    """First and last sentence of every run, forward and backward."""
    size = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    n, found = len(words), set()
    ends = np.searchsorted(size, size[:-1] + LEAST_WORDS)  # first end with enough words
    for i in range(n):
        j = max(int(ends[i]), i + LEAST_SENTENCES)
        if j <= n:
            found.add((i, j))
    starts = np.searchsorted(size, size[1:] - LEAST_WORDS, side="right") - 1
    for j in range(1, n + 1):
        i = min(int(starts[j - 1]), j - LEAST_SENTENCES)
        if i >= 0 and size[j] >= LEAST_WORDS:
            found.add((i, j))
    found.update((i, i + 1) for i in range(n) if len(words[i]) >= LONG_SENTENCE)
    return sorted(found)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("h", pa.int64()), ("i", pa.int32()), ("j", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("runs", kind)])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, runs = batch.slice(at, 256), []
            for value in part.column("text"):
                text = value.as_py() or ""
                words = [text[a:b].split() for a, b, _ in sentences(text)]
                each = [xxhash.xxh3_64_digest(" ".join(w)) for w in words]
                runs.append([
                    {"h": int.from_bytes(xxhash.xxh3_64_digest(b"".join(each[i:j])), "little", signed=True), "i": i, "j": j}
                    for i, j in spans(words)
                ])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("copy"), pa.array(runs, kind)], schema=schema)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, copy, covered)``: the runs of each document that repeat an
    earlier run; ``copy`` is a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    hashed = rows.filter("text <> ''").mapInArrow(
        _hashed, "doc_id long, copy long, runs array<struct<h:long,i:int,j:int>>")
    runs = materialise(hashed.select("doc_id", "copy", F.inline("runs")), "runs")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "copy", "i")
    first = runs.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = runs.join(first, "h").filter(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy"))
          & (F.col("i") == F.col("first.i"))))
    return later.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("i", "j")).alias("covered"))


def _without(text: str, covered) -> tuple[str, int, int]:
    parts = sentences(text)
    gone = np.zeros(len(parts) + 1, np.int64)
    for run in covered:
        gone[run["i"]] += 1
        gone[run["j"]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    lead = text[:parts[0][0]] if parts else text
    kept = "".join(text[a:n] for (a, _, n), g in zip(parts, gone) if not g)
    return lead + kept, len(parts), int(gone.sum())


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated sentences removed from ``text``, and the numbers
    of sentences ``_n_sentences`` and ``_n_removed``."""
    return with_own_names(docs, ["doc_id", "text"], _deduped)


def _deduped(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    repeats = materialise(repeated_runs(docs), "repeats").select(
        F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "covered")

    @F.pandas_udf("text string, n_sentences long, n_removed long")
    def cut(texts: pd.Series, covered: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [(None, 0, 0) if t is None else _without(t, [] if c is None else c) for t, c in zip(texts, covered)],
            columns=["text", "n_sentences", "n_removed"])

    joined = docs.join(repeats, docs["doc_id"].cast("long").eqNullSafe(F.col("_id"))
                       & (F.xxhash64(docs["text"]) == F.col("_copy")), "left")
    done = joined.withColumn("_cut", cut(docs["text"], F.col("covered")))
    kept = [F.col("_cut.text").alias("text") if c == "text" else docs[c] for c in docs.columns]
    return done.select(*kept, F.col("_cut.n_sentences").alias("_n_sentences"), F.col("_cut.n_removed").alias("_n_removed"))
