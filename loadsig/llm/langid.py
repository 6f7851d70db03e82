"""Language identification: averaged hashed subword embeddings with a linear
softmax, trained by stochastic gradient descent in numpy.

A text is the average of the embeddings of its character n-grams (1 to 4, over
lower-cased letters with one boundary mark between words), hashed into a fixed
number of rows. Embedding and softmax are both linear, so a prediction adds up
rows of their product.

The model is fitted on at most ``per_language`` labelled documents of each
language, chosen by hash. A fifth of them is set aside to fit the temperature of
the softmax and the confidence below which a prediction is rejected: at most
``reject_share`` of the set-aside documents fall below it, and it is never above
one half.

A softmax is sure of languages that it has never seen, too. So a prediction is
also rejected if the text is strange to the language: its mean logarithm of n-gram
frequencies lies too far below that of the language, in deviations that depend on
the length. How far is too far is calibrated on something to reject: each language
in turn is left out and its set-aside texts are judged by the other languages. The
limit lies between nearly all texts judged by their own language and four fifths of
all pieces, short ones included, judged by others; where these overlap, own texts
are kept.

A column ``language`` of the input is replaced; other columns are kept. Repeated
rows are predicted each, alike.

Texts that are null or have no letter are ``und`` with score 0 and are rejected.
Rows without text, language or id are not learned from. Whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadsig.llm.shared import bounded_batches, give_back, lean, lowest
from loadsig.session import materialise

UNDETERMINED = "und"
PER_LANGUAGE = 800
BUCKETS, WIDTH, GRAMS = 8192, 16, 4
EPOCHS, BATCH, RATE = 8, 32, 0.5
REJECT_SHARE, MOST_REJECT = 0.001, 0.5
OWN_SHARE, OTHER_SHARE, SHORT = 0.998, 0.2, 120
RESULT = "lang_pred string, score double, accepted boolean"
_MODEL = ("names array<string>, scores binary, bound double, log_share binary, centre array<double>, "
          "spread array<double>, limit double")
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Bucket of each character n-gram; empty if the text has no letter."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    points = np.where(letter, points, 0).astype(np.uint64)
    before = np.concatenate(([False], letter[:-1]))
    points = np.concatenate(([0], points[letter | before], [0])).astype(np.uint64)
    parts, mixed = [], np.zeros(len(points), np.uint64)
    for n in range(1, GRAMS + 1):
        if len(points) < n:
            break
        mixed = (mixed[:len(points) - n + 1] ^ points[n - 1:] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        parts.append((mixed % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(parts)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _pieces(text: str, rng: np.random.Generator) -> list[str]:
    """The text and two short runs of its words, so short texts are learned."""
    words = text.split()
    out = [text]
    for most in (3, 12):
        at = int(rng.integers(0, max(1, len(words) - most + 1)))
        out.append(" ".join(words[at:at + most]))
    return out


def _bag(text: str) -> np.ndarray:
    """``grams`` in the two bytes that a bucket needs; a sample of them is kept."""
    return grams(text).astype(np.uint16)


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text, each once, and how often: what a fit keeps."""
    count = np.bincount(grams(text), minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at.astype(np.uint16), count[at].astype(np.min_scalar_type(count.max()))


def _rows(counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(counted), BUCKETS), np.float32)
    for row, (at, n) in zip(out, counted):
        row[at] = n / n.sum()
    return out


class Strangeness:
    """How far a text lies below its language, in deviations."""

    def __init__(self, log_share: np.ndarray, centre: np.ndarray, spread: tuple[float, float], limit: float) -> None:
        self.log_share, self.centre, self.spread, self.limit = log_share, centre, spread, limit

    def of(self, bag: np.ndarray, lang: int) -> float:
        below = self.centre[lang] - self.log_share[bag, lang].mean()
        return float(below / np.sqrt(self.spread[0] + self.spread[1] / len(bag)))


def fit_strangeness(learned: Iterable[tuple[np.ndarray, int]], aside: list[tuple[np.ndarray, int]], table: np.ndarray) -> Strangeness:
    """Calibrate on set-aside texts and pieces, own language and left-out ones.
    What was learned is counted one text at a time and not kept."""
    n_langs = table.shape[1]
    count = np.full((BUCKETS, n_langs), 0.5)
    for bag, lang in learned:
        count[:, lang] += np.bincount(bag, minlength=BUCKETS)
    log_share = np.log(count / count.sum(axis=0))
    level = np.array([[log_share[bag, j].mean() for j in range(n_langs)] for bag, _ in aside])
    size = np.array([len(bag) for bag, _ in aside])
    truth = np.array([lang for _, lang in aside])
    own = level[np.arange(len(aside)), truth]
    centre = np.array([np.median(own[truth == j]) if (truth == j).any() else np.median(own) for j in range(n_langs)])
    off = centre[truth] - own
    long = size >= SHORT
    near = float(np.median(off[long] ** 2)) if long.any() else float(np.median(off**2))
    by_size = float(np.median(off[~long] ** 2 * size[~long])) if (~long).any() else near * SHORT
    spread = (max(near / 0.455, 1e-6), max(by_size / 0.455, 1e-6))  # the median of a squared normal is 0.455
    out = Strangeness(log_share, centre, spread, np.inf)
    scale = np.sqrt(spread[0] + spread[1] / size)
    limit = max(float(np.quantile(off / scale, OWN_SHARE)), 1.0)
    if n_langs > 1:
        # the language that would be predicted if the text's own were unknown
        logits = np.array([np.bincount(bag, minlength=BUCKETS) @ table / len(bag) for bag, _ in aside])
        logits[np.arange(len(aside)), truth] = -np.inf
        guess = logits.argmax(axis=1)
        strange = (centre[guess] - level[np.arange(len(aside)), guess]) / scale
        # nearer to the others: keeping own texts is worth more
        limit = max(limit, float(np.cbrt(limit * max(np.quantile(strange, OTHER_SHARE), 0.0) ** 2)))
    else:
        limit *= 1.5
    out.limit = limit
    return out


def fit_softmax(texts: list[str], langs: list[str], seed: int = 10):
    """Languages, score rows per bucket (already divided by the temperature),
    the least confidence and the strangeness of texts."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    aside, learn = order[: len(order) // 5], order[len(order) // 5:]
    if not len(aside):
        aside = learn
    bags, target = [], []
    for i in learn:
        for piece in _pieces(texts[i], rng):
            bag = _counted(piece)
            if len(bag[0]):
                bags.append(bag)
                target.append(names.index(langs[i]))
    y = np.array(target)
    weight = 1.0 / np.maximum(1, np.bincount(y, minlength=len(names)))
    weight = weight / weight[np.unique(y)].mean()
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32)
    for epoch in range(EPOCHS):
        turn = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(turn), BATCH):
            pick = turn[at:at + BATCH]
            x = _rows([bags[i] for i in pick])
            hidden = x @ embed
            error = _softmax(hidden @ out)
            error[np.arange(len(pick)), y[pick]] -= 1
            error *= weight[y[pick]][:, None]
            back = error @ out.T
            out -= rate / len(pick) * (hidden.T @ error)
            embed -= np.float32(rate * 20 / len(pick)) * (x.T @ back)
    del bags
    table = (embed @ out).astype(np.float64)
    held = [(_bag(texts[i]), names.index(langs[i])) for i in aside]
    logits = np.array([np.bincount(b, minlength=BUCKETS) @ table / len(b) for b, _ in held if len(b)])
    truth = np.array([t for b, t in held if len(b)])
    heats = 2.0 ** np.arange(-4, 5, 0.5)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in heats]
    table /= heats[int(np.argmin(loss))]
    sure = _softmax(logits / heats[int(np.argmin(loss))]).max(axis=1)
    bound = min(MOST_REJECT, float(np.quantile(sure, REJECT_SHARE, method="lower")))
    del held
    learned = ((_bag(texts[i]), names.index(langs[i])) for i in learn)
    pieces = [(_bag(p), names.index(langs[i])) for i in aside for p in _pieces(texts[i], rng)]
    strange = fit_strangeness(learned, [(b, t) for b, t in pieces if len(b)], table)
    return names, table, bound, strange


def sample_labelled(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` labelled texts of each language, by hash of id."""
    usable = may_learn & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
    ids = docs.filter(usable).select("doc_id", "lang").distinct()
    chosen = materialise(
        lowest(ids, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], per_language, F.col("doc_id"))
        .select(F.col("doc_id").alias("_id")).distinct(), "sample",
    )
    picked = docs.filter(usable).join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "lang", "text")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    return lowest(picked, ["lang"], order, per_language, F.col("text"))


def train(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE):
    """Fit on the bounded sample in one task; None if nothing is labelled."""
    def model_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "lang", "text"], kind="stable")
        names, table, bound, strange = fit_softmax(rows["text"].tolist(), rows["lang"].tolist())
        return pd.DataFrame({
            "names": [names], "scores": [table.astype("<f8").tobytes()], "bound": [bound],
            "log_share": [strange.log_share.astype("<f4").tobytes()], "centre": [strange.centre.tolist()],
            "spread": [list(strange.spread)], "limit": [strange.limit]})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return model_of(rows)
        finally:
            give_back()

    sample = sample_labelled(docs, may_learn, per_language).filter(F.col("text").rlike(r"\p{L}"))
    row = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, _MODEL).first()
    if row is None:
        return None
    scores = np.frombuffer(bytes(row["scores"]), "<f8").reshape(BUCKETS, len(row["names"]))
    log_share = np.frombuffer(bytes(row["log_share"]), "<f4").reshape(scores.shape)
    strange = Strangeness(log_share, np.array(row["centre"]), tuple(row["spread"]), row["limit"])
    return list(row["names"]), scores, row["bound"], strange


def language_of(model, text: Column) -> Column:
    """Struct ``(lang_pred, score, accepted)`` of a text column."""
    names, table, bound, strange = model or ([], np.zeros((BUCKETS, 0)), 0.0, None)

    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for text in texts:
                bag = grams(text)
                if not len(bag) or not names:
                    out.append((UNDETERMINED, 0.0, False))
                    continue
                p = _softmax(np.bincount(bag, minlength=BUCKETS) @ table / len(bag))
                best = int(p.argmax())
                known = p[best] >= bound and strange.of(bag, best) <= strange.limit
                out.append((names[best], float(p[best]), bool(known)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "accepted"])

    @F.pandas_udf(RESULT)
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from lean(predicted(parts))

    return predict(text)


def identify(docs: DataFrame, model) -> DataFrame:
    """``docs`` with a struct column ``language``."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn("language", language_of(model, F.col("text")))


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, mod 4 (null for a null id)."""
    return F.crc32(id_column.cast("string")) % 4


def keep_identified(docs: DataFrame, model) -> DataFrame:
    """Documents whose prediction is not rejected, with their own columns."""
    bounded_batches(docs.sparkSession)
    name = next(f"_language{n}" for n in range(len(docs.columns) + 1) if f"_language{n}" not in docs.columns)
    return docs.withColumn(name, language_of(model, F.col("text"))).filter(F.col(name)["accepted"]).drop(name)
