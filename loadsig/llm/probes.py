"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors get one more component, so that all have the length of the longest one;
the order by inner product is then that by distance. Each of ``TABLES`` tables
projects them on Gaussian directions, which is 2-stable: the projection of a
difference is normal with the difference's length. A bucket is a row of bins of
two standard deviations. Tables hold every row; only the means and spreads of the
projections, taken over all rows, are kept on the driver.

A neighbour of cosine c lies around the point c q of a query q, moved by the mean
of all rows across q, at a known distance. So each bucket has a probability to
hold it, and a share of all rows to expect by means and spreads. Buckets are visited in the order of success
per row, down to the level at which all tables together find such a neighbour
with the wanted probability. As c is not known, rounds of rising
probability take it from the k-th best row so far. A round visits new buckets
only. Queries that have met fewer than k rows by then, visit every bucket of a
table, which is exact.

The buckets of a table are dealt by the bins of its first directions, and groups
of more than ``BLOCK_ROWS`` rows or ``BLOCK_QUERIES`` queries are cut into pieces;
a task holds one piece and sends at most k rows of each of its queries.

Candidates of all tables are scored on the original vectors in double precision,
component by component in order, so equal pairs score equally everywhere. Ties go
to the smaller id. Vectors that are null, zero or hold null or non-finite
components take no part; vectors of different lengths do not meet. A repeated id
counts once, with the smallest of its values; rows without id are left out. Fewer
candidates than k give fewer rows; an empty table gives none. Other columns are
not read. Sums beyond the double range are infinite scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadsig.llm.pivots import usable
from loadsig.session import materialise

TOP = 20
TABLES, WIDTH, BINS, SEED = 4, 2.0, 6, 13
ROUNDS = (0.5, 0.92)  # probability to find a neighbour, by round
FIRST_COSINE = 0.5
DRAWS = 512
BLOCK_ROWS, BLOCK_QUERIES, CHUNK = 32_768, 2048, 256
_INDEX = "vec_id long, v array<double>, t int, bucket long, cell long"
_PROBE = "query_id long, q array<double>, t int, cell long, cosines array<double>, levels array<double>, least double"
_FOUND = "query_id long, vec_id long, score double"


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Standard normal distribution, to about 1e-7 (Abramowitz and Stegun 7.1.26)."""
    x = np.abs(z) / np.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * (1.0 + np.sign(z) * (1.0 - poly * np.exp(-x * x)))


def _between(edges: np.ndarray) -> np.ndarray:
    """Probabilities of the bins that the edges cut."""
    below = normal_cdf(edges)
    ends = np.zeros((*below.shape[:-1], 1))
    return np.diff(np.concatenate([ends, below, ends + 1.0], axis=-1), axis=-1)


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Hashing:
    """The tables of the vectors of one length."""

    size: int
    rows: int
    longest: float
    centre: np.ndarray | None = None  # mean of the lengthened vectors
    spread: np.ndarray | None = None  # of the projections: (tables, functions)

    def __post_init__(self) -> None:
        # buckets of a few dozen rows, groups of a few thousand
        self.functions = int(np.clip(round(np.log2(max(self.rows, 48) / 24) / 1.4), 1, min(20, self.size + 1)))
        self.grouped = int(np.clip(np.log(max(self.rows / BLOCK_ROWS, 1)) / np.log(2.2), 0, self.functions))
        rng = np.random.default_rng([SEED, self.size])
        axes = [np.linalg.qr(rng.normal(size=(self.size + 1, self.size + 1)))[0] for _ in range(TABLES)]
        self.axes = np.stack([a[:, :self.functions] for a in axes]) * np.sqrt(self.size + 1)
        self.shift = rng.uniform(size=(TABLES, self.functions))
        self.draws = (np.stack([rng.permutation(DRAWS) for _ in range(self.functions)], axis=1) + 0.5) / DRAWS

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Projections (rows, tables, functions) of the lengthened vectors; a
        query counts as a unit vector."""
        return np.einsum("rd,tdf->rtf", self.lengthened(x, query), self.axes)

    def lengthened(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.hstack([unit(x), np.zeros((len(x), 1))])
        x = x / self.longest
        return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x**2).sum(axis=1)))[:, None]])

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bins (rows, tables, functions)."""
        at = np.floor((self.project(x, False) - self.mean()) / (WIDTH * self.spread) + self.shift)
        return np.clip(at.astype(np.int64) + BINS // 2, 0, BINS - 1)

    def mean(self) -> np.ndarray:
        return np.einsum("d,tdf->tf", self.centre, self.axes)

    def gains(self, q: np.ndarray, cosine: np.ndarray, tables: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Per query, table, function and bin: probability to hold a neighbour of
        this cosine, and its logarithm less that of the share of all rows.

        A neighbour is expected where the mean of all rows would be if its part
        along the query gave the cosine; the rest of its length is spread evenly.
        """
        c = np.clip(cosine, 0.0, 0.999999)
        along = self.lengthened(q, True) @ self.centre
        across = (self.centre**2).sum() - along**2
        rest = np.sqrt(np.maximum(1.0 - c * c - across, 0.1 * (1.0 - c * c)))[:, None, None, None]
        p, mean = self.project(q, True)[:, tables], self.mean()[tables]
        foot = mean[None] + (c - along)[:, None, None] * p
        inner = np.arange(1, BINS) - BINS // 2
        edges = WIDTH * (inner - self.shift[tables, :, None])  # in spreads from the mean
        at = mean[:, :, None] + self.spread[tables, :, None] * edges
        chance = _between((at[None] - foot[..., None]) / rest)
        return chance, np.log(np.maximum(chance, 1e-12)) - np.log(np.maximum(_between(edges), 1e-12))

    def levels(self, chance: np.ndarray, gain: np.ndarray, wanted: float) -> np.ndarray:
        """Per query and table the gain down to which buckets are visited, so
        that all tables together succeed with the probability ``wanted``."""
        miss = (1.0 - wanted) ** (1.0 / TABLES)
        total = np.zeros((*chance.shape[:2], DRAWS))
        upto = np.cumsum(chance, axis=-1)
        for f in range(self.functions):
            pick = (self.draws[None, None, :, f, None] > upto[:, :, None, f, :-1]).sum(axis=-1)
            total += np.take_along_axis(gain[:, :, f], pick, axis=-1)
        total.sort(axis=-1)
        return total[:, :, int(np.floor(miss * (DRAWS - 1)))]

    def cells(self, gain: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, tables and groups of buckets with a bucket to visit."""
        best = gain.max(axis=-1)
        rest = np.concatenate([np.cumsum(best[..., ::-1], axis=-1)[..., ::-1], np.zeros((*best.shape[:2], 1))], axis=-1)
        q, t = (a.ravel() for a in np.indices(level.shape))
        key, value = np.zeros(len(q), np.int64), np.zeros(len(q))
        for f in range(self.grouped):
            value = (value[:, None] + gain[q, t, f]).ravel()
            key = (key[:, None] * BINS + np.arange(BINS)).ravel()
            q, t = np.repeat(q, BINS), np.repeat(t, BINS)
            stay = value + rest[q, t, f + 1] >= level[q, t]
            q, t, key, value = q[stay], t[stay], key[stay], value[stay]
        return q, t, key


def _by_length(rows: pd.DataFrame, column: str):
    for n, same in rows.groupby(rows[column].map(len), sort=True):
        yield int(n), same


def _fit(vectors: DataFrame) -> dict[int, Hashing]:
    """Means and spreads of the projections over all rows, for each vector length."""
    def norms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for n, same in _by_length(rows, "v"):
                x = matrix(same["v"])
                most = np.abs(x).max(axis=1)
                with np.errstate(over="ignore"):
                    norm = most * np.linalg.norm(x / most[:, None], axis=1)
                yield pd.DataFrame({"n": [n], "rows": [len(x)], "longest": [norm.max()]})

    sizes = vectors.select("v").mapInPandas(norms, "n int, rows long, longest double").groupBy("n").agg(
        F.sum("rows").alias("rows"), F.max("longest").alias("longest"))
    tables = {r["n"]: Hashing(r["n"], r["rows"], min(r["longest"], 1e300)) for r in sizes.collect()}

    def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for n, same in _by_length(rows, "v"):
                x = matrix(same["v"])
                p = tables[n].project(x, False).reshape(len(same), -1)
                sums = np.concatenate([tables[n].lengthened(x, False).sum(axis=0), (p * p).sum(axis=0)])
                yield pd.DataFrame({"n": n, "j": np.arange(len(sums)), "s": sums})

    summed = vectors.select("v").mapInPandas(moments, "n int, j int, s double")
    means = {n: np.zeros(n + 1 + TABLES * h.functions) for n, h in tables.items()}
    for r in summed.groupBy("n", "j").agg(F.sum("s").alias("s")).collect():
        means[r["n"]][r["j"]] = r["s"] / tables[r["n"]].rows
    for n, h in tables.items():
        h.centre = means[n][:n + 1]
        square = means[n][n + 1:].reshape(TABLES, h.functions)
        h.spread = np.sqrt(np.maximum(square - h.mean() ** 2, 1e-12))
    return tables


def _number(bins: np.ndarray) -> np.ndarray:
    key = np.zeros(bins.shape[:-1], np.int64)
    for f in range(bins.shape[-1]):
        key = key * BINS + bins[..., f]
    return key


def _index(vectors: DataFrame, tables: dict[int, Hashing]) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for n, same in _by_length(rows, "v"):
                h = tables[n]
                b = h.buckets(matrix(same["v"]))
                bucket, cell = _number(b), _number(b[..., :h.grouped])
                for t in range(TABLES):
                    yield pd.DataFrame({"vec_id": same["vec_id"], "v": same["v"], "t": t, "bucket": bucket[:, t],
                                        "cell": cell[:, t]})

    return vectors.mapInPandas(run, _INDEX)


def _planned(state: DataFrame, tables: dict[int, Hashing], wanted: float) -> DataFrame:
    """Add this round's cosine and its levels, one per table, to those before."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for n, all_ in _by_length(rows, "q"):
                h = tables[n]
                for at in range(0, len(all_), CHUNK):
                    same = all_.iloc[at:at + CHUNK].copy()
                    x = matrix(same["q"])
                    # the k-th score as a cosine between the lengthened vectors
                    known = same["least"].to_numpy() / h.longest / np.linalg.norm(x, axis=1)
                    cosine = np.where(np.isfinite(known), known, FIRST_COSINE)
                    level = h.levels(*h.gains(x, cosine), wanted)
                    same["cosines"] = [[*old, c] for old, c in zip(same["cosines"], cosine)]
                    same["levels"] = [[*old, *new] for old, new in zip(same["levels"], level)]
                    yield same

    return state.mapInPandas(run, state.schema)


def _probes(planned: DataFrame, tables: dict[int, Hashing]) -> DataFrame:
    """Groups of buckets that each query visits in a round."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for n, all_ in _by_length(rows, "q"):
                h = tables[n]
                for at in range(0, len(all_), CHUNK):
                    same = all_.iloc[at:at + CHUNK]
                    cosine = np.array([c[-1] for c in same["cosines"]])
                    gain = h.gains(matrix(same["q"]), cosine)[1]
                    q, t, cell = h.cells(gain, matrix(same["levels"])[:, -TABLES:])
                    mine = same.iloc[q]
                    yield pd.DataFrame({
                        "query_id": mine["query_id"].to_numpy(), "q": mine["q"].to_numpy(), "t": t, "cell": cell,
                        "cosines": mine["cosines"].to_numpy(), "levels": [v[j::TABLES] for v, j in zip(mine["levels"], t)],
                        "least": mine["least"].to_numpy()})

    return planned.mapInPandas(run, _PROBE)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, added in the order of the components."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def best_rows(screen: np.ndarray, q, x, query_ids, ids, k: int, slack: float):
    """The k best candidates of each query by exact score, ties to smaller ids;
    ``screen`` has scores right to ``slack``, -inf for what was not visited."""
    i, j = np.nonzero(screen > -np.inf)
    met = np.bincount(i, minlength=len(screen))
    if met.max(initial=0) > 4 * k:
        # of long lists only what can be among the k best
        value, start = screen[i, j], np.cumsum(met) - met
        kth = [np.partition(value[s:s + n], n - k)[n - k] - slack if n > k else -np.inf for s, n in zip(start, met)]
        stay = value >= np.repeat(kth, met)
        i, j = i[stay], j[stay]
    score = exact_scores(q[i], x[j])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return pd.DataFrame({"query_id": query_ids[i], "vec_id": ids[j], "score": score})[rank < k]


def _visit(tables: dict[int, Hashing], k: int):
    def piece(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Visit the buckets of a piece. Queries without levels visit all."""
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        rows, t = rows.sort_values(["bucket", "vec_id"]), int(key[0])
        for n, have in _by_length(rows, "v"):
            mine = asked[asked["q"].map(len) == n]
            if not len(mine):
                continue
            h, x, ids = tables[n], matrix(have["v"]), have["vec_id"].to_numpy()
            bucket, first, size = np.unique(have["bucket"].to_numpy(), return_index=True, return_counts=True)
            place = {j: at for at, j in enumerate(ids)}
            digits = (bucket[:, None] // BINS ** np.arange(h.functions - 1, -1, -1)) % BINS
            for at in range(0, len(mine), CHUNK):
                ask = mine.iloc[at:at + CHUNK]
                q, query_ids = matrix(ask["q"]), ask["query_id"].to_numpy()
                visit = _to_visit(h, t, q, ask, digits)
                screen = np.full((len(q), len(x)), -np.inf)
                slack = 1e-9 * np.abs(q).max() * np.abs(x).max() * n
                known = ask["least"].to_numpy()[:, None] - slack
                for b in np.flatnonzero(visit.any(axis=0)):
                    who, here = np.flatnonzero(visit[:, b]), slice(first[b], first[b] + size[b])
                    score = q[who] @ x[here].T
                    score[score < known[who]] = -np.inf
                    screen[who, here] = score
                own = [(i, place[j]) for i, j in enumerate(query_ids) if j in place]
                if own:
                    screen[tuple(np.array(own).T)] = -np.inf
                out.append(best_rows(screen, q, x, query_ids, ids, k, slack))
        return pd.concat(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return piece


def _to_visit(h: Hashing, t: int, q: np.ndarray, ask: pd.DataFrame, digits: np.ndarray) -> np.ndarray:
    """Which query visits which bucket now: above this round's level and below
    those of the earlier rounds."""
    everything = ask["levels"].map(len).to_numpy() == 0
    visit = np.repeat(everything[:, None], len(digits), axis=1)
    some = np.flatnonzero(~everything)
    if len(some):
        table = slice(t, t + 1)
        cosines, levels = matrix(ask["cosines"].iloc[some]), matrix(ask["levels"].iloc[some])
        for r in range(levels.shape[1]):
            gain = h.gains(q[some], cosines[:, r], table)[1][:, 0]
            total = sum(gain[:, f][:, digits[:, f]] for f in range(h.functions))
            above = total >= levels[:, r, None]
            visit[some] = above & ~visit[some] if r == levels.shape[1] - 1 else visit[some] | above
    return visit


def _search(index: DataFrame, probes: DataFrame, tables: dict[int, Hashing], k: int) -> DataFrame:
    """Rows found in the visited buckets; large groups are cut into pieces."""
    keys = ["t", "cell"]
    parts = materialise(
        index.groupBy(keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")).join(
            probes.groupBy(keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("shares")), keys), "parts")

    def number(of: str, column: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("piece"), of), F.col(column)).cast("int")

    def each(column: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    rows = index.join(parts, keys).withColumn("block", number("vec_id", "blocks")).withColumn("share", each("shares"))
    asks = probes.join(parts, keys).withColumn("share", number("query_id", "shares")).withColumn("block", each("blocks"))
    piece = [*keys, "block", "share"]
    return rows.select(*piece, "vec_id", "v", "bucket").groupBy(piece).cogroup(
        asks.select(*piece, "query_id", "q", "cosines", "levels", "least").groupBy(piece)
    ).applyInPandas(_visit(tables, k), _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(embeddings: DataFrame, is_query: Column, k: int = TOP, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of largest inner product
    found for each row that ``is_query`` names, without the row itself."""
    one = embeddings.filter("vec_id IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(
        F.min(F.col("embedding").cast("array<double>")).alias("v"))
    vectors = materialise(one.filter(usable(F.col("v")) & F.exists("v", lambda x: x != 0)), "vectors")
    tables = _fit(vectors)
    index = materialise(_index(vectors, tables), "hashed")
    nothing = F.array().cast("array<double>")
    asked = vectors.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    state = asked.withColumns({"cosines": nothing, "levels": nothing, "least": F.lit(float("-inf"))})
    best = None
    for wanted in rounds:
        planned = materialise(_planned(state, tables, wanted), "planned")
        found = _search(index, materialise(_probes(planned, tables), "probes"), tables, k)
        best = materialise(_ranked(found if best is None else found.unionByName(best.drop("rank")), k), "found")
        kth = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        state = planned.drop("least").join(kth, "query_id", "left").withColumn(
            "least", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
    short = state.filter(F.col("least") == float("-inf"))
    if not short.isEmpty():
        # the exact way: these queries visit all groups of the first table
        groups = index.filter("t = 0").select(F.size("v").alias("n"), "t", "cell").distinct()
        rest = short.select("query_id", "q", "least", F.size("q").alias("n")).join(groups, "n").drop("n")
        probes = materialise(rest.withColumns({"cosines": nothing, "levels": nothing}), "probes")
        best = _ranked(_search(index, probes, tables, k).unionByName(best.drop("rank")), k)
    return best.select("query_id", "rank", "vec_id", "score")
