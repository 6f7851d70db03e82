"""Near-duplicate embeddings with a pivot-permutation index.

A bounded sample of vectors serves as pivots. Each vector is described by its
``NEAREST`` pivots in order of distance and filed in the inverted lists of these
pivots. Two vectors are candidates if they share at least ``SHARED`` pivots. The
lists are kept per set of ``SHARED`` pivots instead of per pivot, so a list holds
exactly the vectors that share these, and shared counts need no counting over
long lists. Candidates are verified by cosine in double precision.

A pair that shares several lists is counted in the first one only: the list of
the ``SHARED`` smallest pivots that both have. So lists give numbers of links and
spanning trees, never rows of pairs. Lists longer than ``BLOCK`` are cut into
blocks, and each pair of blocks is a piece of work of its own.

Equal vectors form a class with a multiplicity and are compared once. Vectors
that are null, zero or hold null or non-finite components link with nothing, and
vectors of different lengths do not link. A repeated id counts as one vector, the
smallest of its values; rows without id are left out. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadsig.llm.shared import components
from loadsig.session import materialise

LEAST_COSINE = 0.95
PIVOTS, NEAREST, SHARED = 512, 8, 4
APART = 0.5  # largest cosine of two pivots
BLOCK, BUNDLE_ROWS = 512, 20_000


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def one_per_id(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, v)`` in double precision, one row per id."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """At most ``PIVOTS`` unit vectors of each of the few vector lengths, from
    a sample four times as large. Pivots are at least ``APART``: several pivots
    within one group of near copies would order its members at random."""
    lengths = [r["n"] for r in classes.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(8).collect()]
    out = {}
    for n in lengths:
        rows = classes.filter(F.size("v") == n).orderBy(F.xxhash64("node"), "node").limit(4 * PIVOTS).select("v").collect()
        chosen = np.empty((0, n))
        for v in _unit([r["v"] for r in rows]):
            if len(chosen) < PIVOTS and not (chosen @ v > APART).any():
                chosen = np.vstack([chosen, v])
        out[n] = chosen
    return out


def nearest_pivots(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``(node, near, keys)``: pivots by distance, and a key for each list.
    Vectors of a length without pivots share one list of their length."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            length = rows["v"].map(len)
            for n, same in rows.groupby(length):
                if n not in pivots:
                    yield pd.DataFrame({"node": same["node"], "near": [[]] * len(same), "keys": [[-int(n)]] * len(same)})
                    continue
                p = pivots[n]
                take, need = min(NEAREST, len(p)), min(SHARED, len(p))
                order = np.argsort(-(_unit(same["v"]) @ p.T), axis=1, kind="stable")[:, :take]
                picks = np.array(list(combinations(range(take), need)))
                sets = np.sort(order, axis=1)[:, picks]
                keys = np.full(sets.shape[:2], int(n), np.int64)
                for j in range(need):
                    keys = keys * PIVOTS + sets[:, :, j]
                yield pd.DataFrame({"node": same["node"], "near": list(order), "keys": list(keys)})

    return classes.select("node", "v").mapInPandas(run, "node long, near array<int>, keys array<long>")


def _own_list(key: int, near: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Whether the list ``key`` is the first that each pair shares: no pivot
    outside the key that both have comes before the last one of the key."""
    if key < 0:
        return np.ones(len(rows), bool)
    need = min(SHARED, near.shape[1])
    members = [(key // PIVOTS**j) % PIVOTS for j in range(need)]
    low = np.where((near < max(members)) & ~np.isin(near, members), near, -1)
    width = max(members)
    flags = np.zeros((len(near), width + 1), np.float32)
    at, col = np.nonzero(low >= 0)
    flags[at, low[at, col]] = 1
    out = np.empty(len(rows), bool)
    for s in range(0, len(rows), 65536):
        out[s:s + 65536] = (flags[rows[s:s + 65536]] * flags[cols[s:s + 65536]]).sum(axis=1) == 0
    return out


def _compare(least: float):
    def lists(rows: pd.DataFrame) -> pd.DataFrame:
        """Links within each piece: per vector their number, and the smallest
        vector that links within the piece reach."""
        out = []
        for (key, lo, hi), piece in rows.groupby(["key", "lo", "hi"], sort=False):
            if len(piece) < 2:
                continue
            unit, node = _unit(piece["v"]), piece["node"].to_numpy()
            block, mult = piece["block"].to_numpy(), piece["mult"].to_numpy()
            cosine = unit @ unit.T
            link = cosine >= least
            np.fill_diagonal(link, False)
            if lo != hi:
                link &= block[:, None] != block[None]
            if not link.any():
                continue
            a, b = np.nonzero(np.triu(link))
            near = np.array(piece["near"].tolist(), np.int64).reshape(len(piece), -1)
            own = _own_list(int(key), near, a, b)
            count = np.bincount(a[own], mult[b[own]], len(piece)) + np.bincount(b[own], mult[a[own]], len(piece))
            low = node.copy()
            while True:
                lower = np.minimum(low, np.where(link, low[None], np.iinfo(np.int64).max).min(axis=1))
                if (lower == low).all():
                    break
                low = lower
            some = link.any(axis=1)
            out.append(pd.DataFrame({"node": node[some], "n": count[some].astype(np.int64), "low": low[some]}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "n": [], "low": []}, dtype="int64")

    return lists


def find_links(classes: DataFrame, least: float) -> DataFrame:
    """``(node, n, low)`` from all pieces of all inverted lists."""
    filed = materialise(nearest_pivots(classes, choose_pivots(classes)), "filed")
    keyed = filed.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = shared.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    listed = keyed.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pieces = listed.withColumn("other", other).select(
        "node", "key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    pieces = materialise(pieces, "pieces")
    bundles = F.lit(max(1, pieces.count() // BUNDLE_ROWS))
    full = pieces.join(classes, "node").join(filed.select("node", "near"), "node")
    return full.groupBy(F.pmod(F.xxhash64("key", "lo", "hi"), bundles).alias("bundle")).applyInPandas(
        _compare(least), "node long, n long, low long")


def near_duplicates(embeddings: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """One row per vector: number of other vectors linked directly, smallest
    vector reachable by links, and whether that is the vector itself."""
    vectors = materialise(one_per_id(embeddings), "vectors")
    good = vectors.filter(usable(F.col("v")) & F.exists("v", lambda x: x != 0))
    classes = materialise(
        good.groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("mult")), "classes")
    found = materialise(find_links(classes, least), "links")
    labels = components(found.select(F.col("low").alias("a"), F.col("node").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = classes.join(counts, "node", "left").join(labels, "node", "left").select(
        F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    joined = vectors.join(named, vectors["v"] == named["_v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"))
