"""Document quality by hierarchical empirical Bayes.

A linear classifier on hashed words and word shapes gives each document evidence
for two traits, quality and toxicity. Documents stand in a tree of sites: host,
and path below the host. The expected number of documents with the trait is
summed per path and host; a host's rate is shrunk towards the global rate, a
path's rate towards its host's. How strongly is estimated from the data: the
spread of the rates beyond what chance explains gives the size of the prior
(method of moments). A document's posterior log odds are its evidence plus what
its path's rate says beyond the global rate. Sites are only aggregated, so a host
with a third of all documents is one row of sums.

The classifier is fitted on at most ``PER_CLASS`` labelled documents of each
pair of labels, chosen by hash; a fifth of them calibrates it.

Null hosts and paths are sites of their own. Null and empty texts have no
evidence and get the rate of their site. Rows that repeat an id count each.
Without labels all evidence is zero. Extra columns are kept; columns whose names
start with ``_site`` are reserved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadsig.llm.shared import bounded_batches, lowest
from loadsig.session import materialise

TRAITS = ("quality", "toxic")
PER_CLASS = 2500
BUCKETS, EPOCHS, RATE = 1 << 18, 12, 0.5
WORD_POWER, SHAPE_WEIGHT, LEAST_COUNT = 0.5, 4.0, 10
LEAST_QUALITY, MOST_TOXIC = 0.27, 0.73  # a document goes only on clear evidence
WORD_CACHE = 200_000
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


class _Features(dict):
    """Word -> (bucket of the word, bucket of its shape)."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= WORD_CACHE:
            self.clear()
        bare = word.strip(".,;:!?\"'()|*#%&$").lower()
        shape = _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word)))
        value = self[word] = (xxhash.xxh3_64_intdigest(bare) % BUCKETS,
                              xxhash.xxh3_64_intdigest("shape " + shape) % BUCKETS)
        return value


def features(text: str | None, known: _Features) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: words count once (less in texts of many words),
    shapes by their share."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    pairs = np.array([known[w] for w in words], np.int64)
    word = np.unique(pairs[:, 0])
    shape, n = np.unique(pairs[:, 1], return_counts=True)
    return np.concatenate([word, shape]), np.concatenate(
        [np.full(len(word), len(word) ** -WORD_POWER), SHAPE_WEIGHT * n / len(words)])


def fit_linear(texts: list[str], labels: np.ndarray, seed: int = 1):
    """Weights per bucket and trait, with scale, offset and the trait's rate in
    the sample, so that scale * score + offset are log odds beyond that rate."""
    known, rng = _Features(), np.random.default_rng(seed)
    rows = [features(t, known) for t in texts]
    order = rng.permutation(len(rows))
    aside, learn = order[: len(order) // 5], order[len(order) // 5:]
    weights, scales = np.zeros((BUCKETS, len(TRAITS))), []
    # a word of fewer documents says more about these than about the trait
    often = np.zeros(BUCKETS, np.int64)
    for i in learn:
        often[rows[i][0]] += 1
    rows = [(b[often[b] >= LEAST_COUNT], v[often[b] >= LEAST_COUNT]) for b, v in rows]
    for t in range(len(TRAITS)):
        y = labels[:, t]
        w, grad2, bias = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3), 0.0
        share = np.clip(y[learn].mean() if len(learn) else 0.5, 1e-3, 1 - 1e-3)
        balance = {1: 0.5 / share, 0: 0.5 / (1 - share)}
        for epoch in range(EPOCHS):
            for i in rng.permutation(learn):
                b, v = rows[i]
                z = bias + w[b] @ v
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * balance[int(y[i])]
                g = e * v
                grad2[b] += g * g
                w[b] -= RATE * (g + 1e-5 * w[b]) / np.sqrt(grad2[b])
                bias -= 0.05 * e
        weights[:, t] = w
        pick = aside if len(np.unique(y[aside])) == 2 else order
        z = np.array([bias + w[rows[i][0]] @ rows[i][1] for i in pick])
        yy = y[pick]
        best = (np.inf, 1.0)
        rate = np.clip(yy.mean() if len(yy) else 0.5, 1e-3, 1 - 1e-3)
        prior = np.log(rate / (1 - rate))
        for scale in (0.25, 0.5, 0.75, 1, 1.5, 2, 3, 4, 6):
            p = 1 / (1 + np.exp(-np.clip(scale * z + prior, -30, 30)))
            loss = -(yy * np.log(p + 1e-12) + (1 - yy) * np.log(1 - p + 1e-12)).mean() if len(yy) else 0.0
            best = min(best, (loss, float(scale)))
        scales.append((best[1], best[1] * bias))
    return weights, scales


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    first = lowest(known, list(TRAITS), [F.xxhash64("doc_id"), F.col("doc_id")], per_class, F.col("doc_id"))
    chosen = materialise(first.select(F.col("doc_id").alias("_id"), "quality", "toxic"), "labelled")
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
    return texts.groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """Fit on the bounded sample in one task; None without labels."""
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        weights, scales = fit_linear(rows["text"].tolist(), rows[list(TRAITS)].to_numpy(float))
        some = np.flatnonzero(np.abs(weights).max(axis=1) > 1e-4)
        return pd.DataFrame({"at": [some.astype("<i8").tobytes()], "w": [weights[some].astype("<f4").tobytes()],
                             "scales": [[x for s in scales for x in s]]})

    sample = labelled_sample(docs, labels, per_class).withColumn("_all", F.lit(0))
    row = sample.groupBy("_all").applyInPandas(fit, "at binary, w binary, scales array<double>").first()
    if row is None:
        return None
    weights = np.zeros((BUCKETS, len(TRAITS)), np.float32)
    weights[np.frombuffer(bytes(row["at"]), "<i8")] = np.frombuffer(bytes(row["w"]), "<f4").reshape(-1, len(TRAITS))
    return weights, row["scales"]


def evidence(model, text: Column) -> Column:
    """Struct of the log odds of each trait that the text itself gives."""
    weights, scales = model if model else (np.zeros((BUCKETS, len(TRAITS)), np.float32), [0.0] * 2 * len(TRAITS))

    @F.pandas_udf("quality double, toxic double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Features()
        for texts in parts:
            out = np.zeros((len(texts), len(TRAITS)))
            for i, t in enumerate(texts):
                b, v = features(t, known)
                if len(b):
                    z = v @ weights[b]
                    out[i] = [scales[2 * k] * z[k] + scales[2 * k + 1] for k in range(len(TRAITS))]
            yield pd.DataFrame(out, columns=list(TRAITS))

    return score(text)


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(safe / (1 - safe))


def _logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def _strength(rates: DataFrame, trait: str, mean: str) -> Column:
    """Size of the Beta prior from the spread of group rates (one aggregate):
    between-group variance is the weighted variance minus the binomial one."""
    n, m = F.col("n"), F.col(mean)
    rate = F.col(f"s_{trait}") / n
    spread = F.sum(n * (rate - m) * (rate - m)) / F.sum(n)
    chance = F.sum(m * (1 - m)) / F.sum(n)
    between = F.greatest(spread - chance, F.lit(1e-6))
    return F.least(F.greatest(F.sum(n * m * (1 - m)) / F.sum(n) / between - 1, F.lit(2.0)), F.lit(1000.0))


def site_rates(scored: DataFrame, prior: dict[str, float]) -> tuple[DataFrame, dict[str, float]]:
    """``(host, path, <trait>)``: shrunk rates of every path, and the global
    rates. ``scored`` has ``_site_host``, ``_site_path`` and ``_site_<trait>``."""
    expected = [F.sum(_logistic(F.col(f"_site_{t}") + F.lit(prior[t]))).alias(f"s_{t}") for t in TRAITS]
    paths = materialise(scored.groupBy(F.col("_site_host").alias("host"), F.col("_site_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), *expected), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"s_{t}").alias(f"s_{t}") for t in TRAITS])
    total = hosts.agg(*[(F.sum(f"s_{t}") / F.sum("n")).alias(t) for t in TRAITS]).first()
    rates = {t: total[t] if total[t] is not None else 0.5 for t in TRAITS}
    hosts = hosts.withColumns({f"m_{t}": F.lit(rates[t]) for t in TRAITS})
    size = hosts.agg(*[_strength(hosts, t, f"m_{t}").alias(t) for t in TRAITS]).first()
    hosts = hosts.select("host", *[
        ((F.col(f"s_{t}") + F.lit(size[t] or 2.0) * rates[t]) / (F.col("n") + F.lit(size[t] or 2.0))).alias(f"h_{t}")
        for t in TRAITS])
    both = paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    size = both.agg(*[_strength(both, t, f"h_{t}").alias(t) for t in TRAITS]).first()
    return both.select("host", "path", *[F.col(f"h_{t}").alias(f"host_{t}") for t in TRAITS], *[
        ((F.col(f"s_{t}") + F.lit(size[t] or 2.0) * F.col(f"h_{t}")) / (F.col("n") + F.lit(size[t] or 2.0))).alias(f"path_{t}")
        for t in TRAITS]), rates


def classify(docs: DataFrame, model, host: Column, path: Column, id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, posterior probability of each trait, the rates
    of its host and path, and ``keep``."""
    bounded_batches(docs.sparkSession)
    scored = docs.select(F.col(id_column), host.alias("_site_host"), path.alias("_site_path"),
                         evidence(model, F.col("text")).alias("_e"))
    scored = materialise(scored.select(id_column, "_site_host", "_site_path", *[
        F.col(f"_e.{t}").alias(f"_site_{t}") for t in TRAITS]), "evidence")
    # global rates first, from evidence alone
    even = scored.agg(*[F.avg(_logistic(F.col(f"_site_{t}"))).alias(t) for t in TRAITS]).first()
    prior = {t: float(np.log(p / (1 - p))) for t in TRAITS for p in [min(max(even[t] or 0.5, 1e-4), 1 - 1e-4)]}
    rates, overall = site_rates(scored, prior)
    rates = materialise(rates, "rates")
    joined = scored.join(rates, scored["_site_host"].eqNullSafe(rates["host"]) & scored["_site_path"].eqNullSafe(rates["path"]))
    out = {}
    for t in TRAITS:
        out[f"{t}_prob"] = _logistic(F.col(f"_site_{t}") + _logit(F.col(f"path_{t}")))
    done = joined.withColumns(out)
    keep = (F.col("quality_prob") >= LEAST_QUALITY) & (F.col("toxic_prob") < MOST_TOXIC)
    return done.select(id_column, *out, *[f"{level}_{t}" for level in ("host", "path") for t in TRAITS], keep.alias("keep"))
