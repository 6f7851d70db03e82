"""Exact top-k search with the threshold algorithm.

Vectors become integers, ``floor(1024 x)``. Candidates are dealt into blocks;
each block has a list per dimension, sorted by value. For a query the lists are
read together, from the end that raises its score; every vector met is scored in
full. The next values of the lists bound the score of all vectors not met yet,
and a block is finished when that bound is below the k-th best score (not merely
equal, since ties go to the smaller id). The best of all blocks are ranked.

Every block of candidates meets every block of queries; the queries are a stated
share of the rows. Vectors that are null or hold null or non-finite components
take no part; lengths that differ do not meet. A repeated id counts once, with
the smallest of its values; rows without id are left out. Fewer than k
candidates give fewer rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadsig.llm.pivots import one_per_id, usable
from loadsig.session import materialise

SCALE, TOP = 1024, 10
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
FIRST_DEPTH = 8
_OUT = "query_id long, vec_id long, score long"


def _score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(q).max() if len(q) else 0) * len(q) < 2.0**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


def threshold_search(ids: np.ndarray, x: np.ndarray, order: np.ndarray, own: int, q: np.ndarray, k: int):
    """Best ``k`` rows of one block: positions and scores. ``order`` holds the
    positions of each dimension's list, largest value first."""
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    n = len(ids)
    seen = ids == own
    best, score = np.empty(0, np.int64), np.empty(0, np.int64)
    depth, step = 0, FIRST_DEPTH
    while depth < n:
        to = min(n, depth + step)
        if len(up) + len(down):
            met = np.concatenate([order[up, depth:to].ravel(), order[down, n - to:n - depth].ravel()])
            met = np.unique(met)
        else:
            met, to = np.arange(n), n
        met = met[~seen[met]]
        seen[met] = True
        best = np.concatenate([best, met])
        score = np.concatenate([score, _score(x[met], q)])
        pick = np.lexsort((ids[best], -score))[:k]
        best, score = best[pick], score[pick]
        bound = sum(int(q[d]) * int(x[order[d, to - 1], d]) for d in up) + \
            sum(int(q[d]) * int(x[order[d, n - to], d]) for d in down)
        if len(best) == k and int(score[-1]) > bound:
            break
        depth, step = to, step * 2
    return best, score


def _search(k: int):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        ask, have = rows[rows["asks"]], rows[~rows["asks"]].sort_values("vec_id")
        out = []
        for n, same in have.groupby(have["x"].map(len)):
            ids, x = same["vec_id"].to_numpy(), np.array(same["x"].tolist(), np.int64).reshape(len(same), n)
            order = np.argsort(-x, axis=0, kind="stable").T
            for own, q in zip(ask["vec_id"], ask["x"]):
                if len(q) == n:
                    best, score = threshold_search(ids, x, order, own, np.asarray(q, np.int64), k)
                    out += [(own, int(i), int(s)) for i, s in zip(ids[best], score)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return block


def top_k(embeddings: DataFrame, is_query, k: int = TOP) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows that ``is_query`` names."""
    ints = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    good = one_per_id(embeddings).filter(usable(F.col("v"))).select("vec_id", ints.alias("x"))
    good = materialise(good, "integers")
    queries = good.filter(is_query)
    n_blocks = max(1, -(-good.count() // BLOCK_ROWS))
    n_asks = max(1, -(-queries.count() // QUERY_ROWS))
    spread = F.xxhash64("vec_id")

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    have = good.select("vec_id", "x", F.lit(False).alias("asks"), F.pmod(spread, F.lit(n_blocks)).cast("int").alias("b"),
                       numbers(n_asks).alias("a"))
    ask = queries.select("vec_id", "x", F.lit(True).alias("asks"), F.pmod(spread, F.lit(n_asks)).cast("int").alias("a"),
                         numbers(n_blocks).alias("b"))
    found = have.unionByName(ask).groupBy("b", "a").applyInPandas(_search(k), _OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
