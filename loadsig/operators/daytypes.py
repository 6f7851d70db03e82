"""Day types: k-means on normalised day profiles, and the choice of k.

Profiles are kept in blocks of days, so vectorised arithmetic runs inside tasks
while Spark distributes blocks and combines their partial sums. A building of one
block takes all steps of a run within a task, its numbers of day types dealt over
several; longer ones take one step per round, by block and start. Both stop after
the same number of steps with the same result. A k-means task
holds one block of days and the centres of one building, a silhouette task two
blocks, and no pair of days is ever written as a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadsig.operators.fit import spread
from loadsig.operators.profiles import DAY
from loadsig.session import materialise

# Smallest and largest number of day types tried, restarts, seed,
# and the share of the largest drop that still counts as an elbow.
K_LOWEST, K_MIN, K_MAX, N_INIT, SEED = 1, 3, 30, 10, 25
ELBOW_SHARE = 0.05

BLOCK_DAYS = 1024
PARTS = 8  # tasks per building
MAX_ROUNDS = 300
TOLERANCE = 1e-9
HOURS = 24


# --- one Lloyd step in built-in functions ------------------------------------

def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def assign_nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Nearest centre of the own building for each day; ties to the lower label.

    ``centres`` has one row per building and day type; they are gathered into
    one short array per building, so each day stays one row.
    """
    listed = centres.groupBy("building_id").agg(
        F.collect_list(F.struct("cluster", "centre")).alias("_centres")
    )
    nearest = F.array_min(
        F.transform(
            "_centres",
            lambda c: F.struct(squared_distance(F.col("profile"), c["centre"]).alias("dist2"),
                               c["cluster"].alias("cluster")),
        )
    )
    return (
        points.join(listed, "building_id")
        .withColumn("_nearest", nearest)
        .select(*points.columns, "_nearest.cluster", "_nearest.dist2")
    )


def update_centres(assigned: DataFrame, keys: tuple[str, ...] = ("building_id",)) -> DataFrame:
    """Mean profile and size of each day type; 24 averages combined map-side."""
    means = F.array(*[F.avg(F.col("profile")[h]) for h in range(HOURS)])
    return assigned.groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("n_days"), means.alias("centre")
    )


def lloyd_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    return update_centres(assign_nearest(points, centres))


def wss(assigned: DataFrame, keys: tuple[str, ...] = ("building_id",)) -> DataFrame:
    """Within-cluster sum of squares of each building (or of other keys) for
    given day types."""
    centres = update_centres(assigned, keys).drop("n_days")
    return (
        assigned.select(*keys, "cluster", "profile")
        .join(centres, [*keys, "cluster"])
        .groupBy(*keys)
        .agg(F.sum(squared_distance(F.col("profile"), F.col("centre"))).alias("wss"))
    )


# --- k-means for every building, k and start ---------------------------------

def day_blocks(points: DataFrame, block_days: int = BLOCK_DAYS, extra: tuple[str, ...] = ()) -> DataFrame:
    """Days gathered into calendar blocks of bounded size per building."""
    first = points.groupBy("building_id").agg(F.min(DAY).alias("_first"))
    block = F.expr(f"datediff({DAY}, _first) div {int(block_days)}")
    rows = F.array_sort(F.collect_list(F.struct(DAY, "profile", *extra)))
    return (
        points.join(first, "building_id")
        .groupBy("building_id", block.alias("block"))
        .agg(rows.alias("_rows"))
        .select("building_id", "block", F.col(f"_rows.{DAY}").alias("days"),
                F.col("_rows.profile").alias("profiles"), *[F.col(f"_rows.{c}").alias(c) for c in extra])
    )


def seed_centres(points: DataFrame, k_max: int, n_init: int = N_INIT, seed: int = SEED) -> DataFrame:
    """Ordered starting profiles for each building and start; a search for k
    uses the first k of them.

    All distinct profiles of a building can become seeds. Even starts take them
    in hash order. Odd starts order them along a direction of their own and take
    evenly spaced ones, halves first, so that every number of first seeds is
    spread over the building. Neither depends on blocks.
    """
    distinct = points.groupBy("building_id", "profile").agg(F.min(DAY).alias(DAY))
    distinct = materialise(distinct, "distinct-days")
    weights = np.random.default_rng(seed).normal(size=(n_init, HOURS))
    direction = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
    along = F.aggregate(F.zip_with("profile", F.col("direction")[F.col("start")], lambda x, w: x * w),
                        F.lit(0.0), lambda s, x: s + x)
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col("start"), F.col("building_id"), F.col(DAY)))
    odd = F.col("start") % 2 == 1
    order = Window.partitionBy("building_id", "start").orderBy("_along", "_draw", DAY)
    group = Window.partitionBy("building_id", "start")
    placed = (
        distinct.withColumn("direction", direction)
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(n_init - 1))))
        .select("building_id", DAY, "start", draw.alias("_draw"), F.when(odd, along).otherwise(F.lit(0.0)).alias("_along"))
        .withColumn("_place", F.row_number().over(order) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(group))
    )
    take = F.least(F.lit(k_max), F.col("_n"))
    step = F.floor(F.col("_place") * take / F.col("_n"))
    first = F.col("_place") == F.ceil(step * F.col("_n") / take)
    turns = F.array(*[F.lit(t) for t in _halves_first(k_max)])
    rank = F.when(odd, turns[step.cast("int")]).otherwise(F.col("_place"))
    chosen = placed.filter(F.when(odd, first).otherwise(F.col("_place") < k_max)).select(
        "building_id", DAY, "start", rank.alias("_rank"))
    return chosen.join(distinct, ["building_id", DAY]).groupBy("building_id", "start").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "profile")))["profile"].alias("seeds"))


def _halves_first(n: int) -> list[int]:
    """Turn of each of ``n`` places when places are visited halves first."""
    bits = max(1, (n - 1).bit_length())
    visited = sorted(range(n), key=lambda i: int(f"{i:0{bits}b}"[::-1], 2))
    turn = [0] * n
    for t, place in enumerate(visited):
        turn[place] = t
    return turn


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, dtype=np.float64) for r in rows])


def _nearest_two(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre, ties to the lower one, and the distances of the two nearest."""
    square = (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2.0 * points @ centres.T
    label = square.argmin(axis=1)
    rows = np.arange(len(points))
    nearest = square[rows, label].copy()
    square[rows, label] = np.inf
    second = square.min(axis=1)
    return label, np.sqrt(np.maximum(nearest, 0.0)), np.sqrt(np.maximum(second, 0.0))


def _lloyd(points: np.ndarray, centres: np.ndarray, rounds: int):
    """Sums, counts and inertia per centre after up to ``rounds`` steps, the
    centres that the inertia belongs to, and whether they have settled.

    By the triangle inequality a day keeps its centre while the distance to it,
    plus what that centre has moved, is below the distance to the second centre
    less the largest move, or below half the way to the nearest other centre. Only
    the other days are compared again.
    """
    settled = False
    label, upper, lower = _nearest_two(points, centres)
    for step in range(rounds):
        counts = np.bincount(label, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, label, points)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        settled = bool(np.abs(moved - centres).max() <= TOLERANCE)
        if settled or step + 1 == rounds:
            break
        shift = np.sqrt(((moved - centres) ** 2).sum(axis=1))
        centres = moved
        apart = np.full(len(centres), np.inf)
        if len(centres) > 1:
            apart = _nearest_two(centres, centres)[2] / 2.0
        upper, lower = upper + shift[label], lower - shift.max()
        # the margin leaves days that are equally near to two centres to the comparison
        open_ = np.flatnonzero(upper >= np.maximum(lower, apart[label]) - 1e-7)
        label[open_], upper[open_], lower[open_] = _nearest_two(points[open_], centres)
    inertia = np.zeros(len(centres))
    np.add.at(inertia, label, ((points - centres[label]) ** 2).sum(axis=1))
    return sums, counts, inertia, centres, settled


_PARTIAL = ("building_id string, k int, start int, cluster int, centre array<double>, "
            "sums array<double>, n bigint, inertia double")
_RUNS = "building_id string, k int, start int, cluster int, centre array<double>, n bigint, inertia double, converged boolean"


def _partial_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of one block for the runs of one start of its building."""
    row, out = rows.iloc[0], []
    points = _matrix(row["profiles"])
    runs: dict[int, list] = {}
    for c in row["centres"]:
        runs.setdefault(c["k"], []).append((c["cluster"], c["centre"]))
    for k, centres in sorted(runs.items()):
        centres.sort(key=lambda c: c[0])
        sums, counts, inertia, used, _ = _lloyd(points, _matrix([c[1] for c in centres]), 1)
        out += [(key[0], k, key[2], j, used[j].tolist(), sums[j].tolist(), int(counts[j]), float(inertia[j]))
                for j in range(len(used))]
    return pd.DataFrame(out, columns=[f.split()[0] for f in _PARTIAL.split(", ")])


def _lloyd_round(blocks: DataFrame, centres: DataFrame) -> DataFrame:
    """Move all centres of the buildings of several blocks once."""
    listed = centres.groupBy("building_id", "start").agg(
        F.collect_list(F.struct("k", "cluster", "centre")).alias("centres")
    )
    partial = (
        spread(blocks.join(listed, "building_id"), ["building_id", "block", "start"])
        .groupBy("building_id", "block", "start")
        .applyInPandas(_partial_sums, _PARTIAL)
    )
    keys = ["building_id", "k", "start", "cluster"]
    merged = partial.groupBy(keys).agg(
        F.sum("n").alias("n"),
        F.sum("inertia").alias("inertia"),
        F.array(*[F.sum(F.col("sums")[h]) for h in range(HOURS)]).alias("sums"),
        F.min("centre").alias("old"),
    )
    moved = F.when(F.col("n") > 0, F.transform("sums", lambda s: s / F.col("n"))).otherwise(F.col("old"))
    shift = F.array_max(F.zip_with("centre", "old", lambda a, b: F.abs(a - b)))
    return merged.withColumn("centre", moved).withColumn("shift", shift).select(
        *keys, "centre", "old", "n", "inertia", "shift")


def _whole_runs(blocks: DataFrame, seeds: DataFrame, ks: list[int], max_rounds: int) -> DataFrame:
    """All runs of the buildings of one block. The numbers of day types are dealt
    over ``PARTS`` tasks per building, seeds are shipped once and cut in the task,
    and only the best start of each k leaves it."""
    listed = seeds.groupBy("building_id").agg(F.array_sort(F.collect_list(F.struct("start", "seeds"))).alias("starts"))
    part = F.explode(F.sequence(F.lit(0), F.lit(min(PARTS, len(ks)) - 1))).alias("part")
    dealt = blocks.join(listed, "building_id").select("building_id", "profiles", "starts", part)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        row, out = rows.iloc[0], []
        points = _matrix(row["profiles"])
        starts = [(int(s["start"]), _matrix(s["seeds"])) for s in row["starts"]]
        for k in ks[int(key[1])::min(PARTS, len(ks))]:
            best = None
            for start, seed in starts:
                result = _lloyd(points, seed[:k], max_rounds)
                if best is None or result[2].sum().round(9) < best[0]:
                    best = (result[2].sum().round(9), start, result)
            _, start, (sums, counts, inertia, used, settled) = best
            centre = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], used) if settled else used
            out += [(key[0], k, start, j, centre[j].tolist(), int(counts[j]), float(inertia[j]), settled) for j in range(len(used))]
        return pd.DataFrame(out, columns=[f.split()[0] for f in _RUNS.split(", ")])

    return spread(dealt, ["building_id", "part"]).groupBy("building_id", "part").applyInPandas(run, _RUNS)


def kmeans_search(
    points: DataFrame,
    ks: list[int],
    n_init: int = N_INIT,
    seed: int = SEED,
    block_days: int = BLOCK_DAYS,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Best of ``n_init`` k-means runs for each building and each k.

    Returns one row per building, k and day type: centre, number of days, the
    run's within-cluster sum of squares ``wss``, and whether it ``converged``
    within ``max_rounds`` steps. A building with fewer distinct days than k gets
    as many day types as it has distinct days.
    """
    blocks = day_blocks(points, block_days)
    sizes = blocks.groupBy("building_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    blocks = materialise(blocks.join(sizes, "building_id").drop("days"), "day-blocks")
    seeds = materialise(seed_centres(points, max(ks), n_init, seed), "seeds")
    ks = sorted(ks)
    done = _whole_runs(blocks.filter("n_blocks = 1"), seeds, ks, max_rounds)
    blocks = blocks.filter("n_blocks > 1")
    longer = blocks.select("building_id").distinct()
    options = F.array(*[F.lit(k) for k in ks])
    centres = (
        seeds.join(longer, "building_id", "left_semi").withColumn("k", F.explode(options))
        .select("building_id", "k", "start", F.posexplode(F.slice("seeds", F.lit(1), F.col("k"))).alias("cluster", "centre"))
    )
    run, kept = ["building_id", "k", "start"], [f.split()[0] for f in _RUNS.split(", ")]
    moved = None
    for _ in range(max_rounds):
        if centres.isEmpty():
            break
        moved = materialise(_lloyd_round(blocks, centres), "centres")
        # a run is finished when none of its centres moves any more
        settled = moved.groupBy(run).agg((F.max("shift") <= TOLERANCE).alias("converged"))
        moved = moved.join(settled, run)
        done = done.unionByName(moved.filter("converged").select(kept))
        centres = moved.filter("NOT converged").select(*run, "cluster", "centre")
    else:
        # in a run that was cut off, the sums belong to the centres before the last move
        done = done.unionByName(moved.filter("NOT converged").withColumn("centre", F.col("old")).select(kept))
    return _best_runs(materialise(done, "runs"))


def _best_runs(runs: DataFrame) -> DataFrame:
    """Keep the run with the lowest sum of squares and number its day types by
    ascending mean of the centre, since labels are arbitrary."""
    run = ["building_id", "k", "start"]
    cost = runs.groupBy(run).agg(F.sum("inertia").alias("wss"))
    best = cost.groupBy("building_id", "k").agg(
        F.min_by(F.struct("start", "wss"), F.struct(F.round("wss", 9), F.col("start"))).alias("b")
    ).select("building_id", "k", "b.start", "b.wss")
    mean = F.aggregate("centre", F.lit(0.0), lambda s, x: s + x)
    order = Window.partitionBy("building_id", "k").orderBy(mean, "centre")
    return (
        runs.join(best, run)
        .withColumn("cluster", F.row_number().over(order) - 1)
        .select("building_id", "k", "cluster", "centre", F.col("n").alias("n_days"), "wss", "converged")
    )


def kmeans_days(points: DataFrame, k: int, n_init: int = N_INIT, seed: int = SEED, **options) -> DataFrame:
    """Day-type assignment ``(building_id, day, cluster)`` with k day types."""
    centres = kmeans_search(points, [k], n_init, seed, **options)
    return assign_nearest(points, centres).select("building_id", DAY, "cluster")


# --- choosing k ---------------------------------------------------------------

def elbow_k(wss_by_k: DataFrame) -> DataFrame:
    """First k whose drop in ``wss`` exceeds 5 % of the largest drop, else 3.
    The windows see one row per k."""
    by_k = Window.partitionBy("building_id").orderBy("k")
    drop = F.abs(F.lag("wss").over(by_k) - F.col("wss"))
    top = F.max("drop").over(Window.partitionBy("building_id"))
    steep = F.when(F.col("drop") > F.lit(ELBOW_SHARE) * F.col("top"), F.col("k"))
    return (
        wss_by_k.select("building_id", "k", drop.alias("drop"))
        .withColumn("top", top)
        .groupBy("building_id")
        .agg(F.coalesce(F.min(steep), F.lit(K_MIN)).alias("k_elbow"))
    )


def silhouette(points: DataFrame, ks: list[int], block_days: int = BLOCK_DAYS) -> DataFrame:
    """Exact mean Euclidean silhouette of each building and labelling.

    ``points`` carries ``labels``, one label per entry of ``ks``. Each pair of
    blocks of a building is a row of its own, compared as matrices of bounded
    size; only sums per day and type leave the task and are added up. A day alone in its type scores 0.
    A labelling with a single type, or with every day its own type, has no score.
    """
    blocks = materialise(day_blocks(points, block_days, extra=("labels",)), "label-blocks")
    left = blocks.select("building_id", F.col("block").alias("left_block"), F.col("profiles").alias("left_profiles"),
                         F.col("labels").alias("left_labels"))
    # one matrix serves both directions, so each pair of blocks comes once
    pairs = left.join(blocks, "building_id").filter("left_block <= block").select(
        "building_id", "left_block", "block", "left_profiles", "left_labels", "profiles", "labels")
    pairs = spread(pairs, ["building_id", "left_block", "block"])

    def sums_to(dist: np.ndarray, labels) -> tuple[list, list]:
        """Per labelling, the sums of distances to each type, and its days."""
        lab = np.array([np.asarray(v) for v in labels])
        sums, sizes = [], []
        for j in range(len(ks)):
            member = np.eye(1 + int(lab[:, j].max()))[lab[:, j]]
            sums.append((dist @ member).ravel().tolist())
            sizes.append(member.sum(axis=0).astype(int).tolist())
        return sums, sizes

    def distances(parts):
        for rows in parts:
            for r in rows.itertuples(index=False):
                mine, theirs = _matrix(r.left_profiles), _matrix(r.profiles)
                square = (mine**2).sum(axis=1)[:, None] + (theirs**2).sum(axis=1) - 2.0 * mine @ theirs.T
                dist = np.sqrt(np.maximum(square, 0.0))
                out = [(r.building_id, r.left_block, *sums_to(dist, r.labels))]
                if r.left_block != r.block:
                    out.append((r.building_id, r.block, *sums_to(dist.T, r.left_labels)))
                yield pd.DataFrame(out, columns=["building_id", "left_block", "sums", "sizes"])

    summed = pairs.mapInPandas(
        distances, "building_id string, left_block long, sums array<array<double>>, sizes array<array<long>>")
    # one row per labelling and type: totals over the blocks are vectors over the days
    per_k = summed.select("building_id", "left_block", F.posexplode(F.arrays_zip("sums", "sizes")).alias("j", "z"))
    own = blocks.select("building_id", F.col("block").alias("left_block"), "labels")

    def score(key: tuple, mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        labels = np.array([np.asarray(v) for v in mine["labels"].iloc[0]])
        at, out = np.arange(len(labels)), []
        for j, parts in rows.groupby("j"):
            width = max(len(z["sizes"]) for z in parts["z"])
            total, n = np.zeros((len(labels), width)), np.zeros(width)
            for z in parts["z"]:
                w = len(z["sizes"])
                total[:, :w] += np.asarray(z["sums"]).reshape(len(labels), w)
                n[:w] += z["sizes"]
            mark = labels[:, j]
            a = total[at, mark] / np.maximum(n[mark] - 1, 1)
            mean = np.where(n > 0, total / np.maximum(n, 1), np.inf)
            mean[at, mark] = np.inf
            b = mean.min(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.where((n[mark] > 1) & (np.maximum(a, b) > 0), (b - a) / np.maximum(a, b), 0.0)
            out.append((key[0], ks[j], float(s.sum()), len(mark), int((n > 0).sum())))
        return pd.DataFrame(out, columns=["building_id", "k", "total", "n_days", "n_types"])

    keys = ["building_id", "left_block"]
    partial = own.groupBy(keys).cogroup(per_k.groupBy(keys)).applyInPandas(
        score, "building_id string, k int, total double, n_days bigint, n_types int"
    )
    return (
        partial.groupBy("building_id", "k")
        .agg((F.sum("total") / F.sum("n_days")).alias("silhouette"), F.sum("n_days").alias("n_days"),
             F.max("n_types").alias("n_types"))
        .filter((F.col("n_types") > 1) & (F.col("n_types") < F.col("n_days")))
        .select("building_id", "k", "silhouette")
    )


def best_silhouette_k(scores: DataFrame) -> DataFrame:
    return scores.groupBy("building_id").agg(
        F.min_by("k", F.struct(-F.round("silhouette", 9), F.col("k"))).alias("k_silhouette")
    )


def choose_k(wss_by_k: DataFrame, scores: DataFrame) -> DataFrame:
    """The larger of both proposals, at least 3."""
    return (
        elbow_k(wss_by_k)
        .join(best_silhouette_k(scores), "building_id", "left")
        .withColumn("k", F.greatest("k_elbow", "k_silhouette", F.lit(K_MIN)))
    )


def label_by_k(points: DataFrame, centres: DataFrame, ks: list[int]) -> DataFrame:
    """Add ``labels``: the nearest day type for every k of ``ks``, in order."""
    listed = centres.groupBy("building_id").agg(
        F.collect_list(F.struct("k", "cluster", "centre")).alias("_centres")
    )

    def label(k: int) -> Column:
        mine = F.filter("_centres", lambda c: c["k"] == k)
        return F.array_min(
            F.transform(mine, lambda c: F.struct(
                squared_distance(F.col("profile"), c["centre"]).alias("d"), c["cluster"].alias("c")))
        )["c"]

    return points.join(listed, "building_id").select(
        *points.columns, F.array(*[label(k) for k in ks]).alias("labels")
    )


def day_types(points: DataFrame, k_max: int = K_MAX, n_init: int = N_INIT, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Choose k for each building and assign its days.

    Returns the assignment ``(building_id, day, cluster)``, the chosen k with both
    proposals and whether its run had ``converged``, and for every k the best sum
    of squares and whether it had.
    """
    ks = list(range(1, k_max + 1))
    centres = materialise(kmeans_search(points, ks, n_init, seed), "best-centres")
    runs = centres.groupBy("building_id", "k").agg(F.max("wss").alias("wss"), F.min("converged").alias("converged"))
    wss_by_k = runs.drop("converged")
    scored = silhouette(label_by_k(points, centres, ks[1:]), ks[1:])
    chosen = choose_k(wss_by_k, scored).join(runs.drop("wss"), ["building_id", "k"], "left")
    chosen = materialise(chosen, "chosen-k")
    mine = centres.join(chosen.select("building_id", "k"), ["building_id", "k"])
    return assign_nearest(points, mine).select("building_id", DAY, "cluster"), chosen, runs
