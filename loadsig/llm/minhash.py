"""Near-duplicate documents: MinHash bands for candidates, odd sketches to
estimate their similarity, full shingle sets to confirm it.

A document's set is its distinct runs of ``shingle`` words; words are separated
by ASCII white space and A-Z are lower-cased. A shorter document has its whole
word sequence as one shingle. Documents are linked where
``100 * |A and B| >= percent * |A or B|``.

Documents with equal sets form a class, and only class representatives are
compared. The MinHash values of a set are folded into an odd sketch: value i
flips one bit, so the XOR of two sketches holds the values in which they
differ, and its bit count estimates the similarity. High similarities leave few
bits and are estimated precisely; a pair is dropped only if it is estimated
below a bound about four standard deviations under the wanted similarity. The
whole set is folded the same way: the XOR of two such bitmaps has at most as many
bits as the sets have different members, so a pair with more bits than linked
sets of their sizes can have is dropped without loss. That is sharp for short
documents, the samples for long ones.

Within a band bucket no pairs of all members are written at first: in each star
round every member meets one pivot. Buckets whose members are in one component
are finished; members of different components that are left after the star
rounds are compared pairwise within the join, by their bitmaps and by the
number of shingles that they can share at all, so no link is lost to the rounds.

Nulls and empty texts have an empty set and are linked with nothing. Rows with
a null id are returned with a null component. Rows that repeat an id are one
row each in ``near_duplicates``. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadsig.llm.shared import bounded_batches, components, lean, with_own_names
from loadsig.session import materialise

SHINGLE, PERCENT = 5, 80
BANDS, BAND_ROWS = 36, 6
SKETCH_WORDS = 16  # of 64 bits
LEAST_ESTIMATE = 0.66
STAR_ROUNDS = 2
WORD_CACHE = 200_000
COLUMN_CHUNK = 4096


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, shingle: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``shingle`` words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    mixed = np.full(len(words) - width + 1, len(words) if width < shingle else 0, np.uint64)
    for j in range(width):
        mixed = (mixed ^ h[j:len(h) - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minhash(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest product with each factor (mod 2^64), upper 32 bits."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), COLUMN_CHUNK):
        np.minimum(low, np.multiply.outer(factors, values[at:at + COLUMN_CHUNK]).min(axis=1), out=low)
    return low >> np.uint64(32)


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(9).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(BAND_ROWS):
        key = _mix(key ^ rows[:, j] * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the numbered samples, as 64-bit words."""
    return parity(samples + (np.arange(1, len(samples) + 1, dtype=np.uint64) << np.uint64(33)))


def parity(values: np.ndarray) -> np.ndarray:
    """Parity bitmap of values: each flips one bit."""
    place = _mix(values)
    bits = np.bincount((place % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def most_bits(estimate: float) -> int:
    """Expected XOR bit count of two sketches at the given similarity."""
    n = 64 * SKETCH_WORDS
    return int(n / 2 * (1 - (1 - 2 / n) ** (2 * BANDS * BAND_ROWS * (1 - estimate))))


def _signatures(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()),
                        ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())),
                        ("parity", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = _WordHashes(), _factors(BANDS * BAND_ROWS)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                values = shingle_set(text.as_py(), shingle, hashes)
                if len(values):
                    samples = minhash(values, factors)
                    out.append((doc, len(values), xxhash.xxh3_128_digest(values.tobytes()),
                                band_keys(samples), odd_sketch(samples), parity(values)))
                else:
                    out.append((doc, 0, None, None, None, None))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in out], field.type) for i, field in enumerate(schema)], schema=schema
            )

    return lambda batches: lean(run(batches))


def _sets(shingle: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(t.as_py(), shingle, hashes).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").cast(pa.int64()), pa.array(sets, schema.field("shingles").type)],
                    schema=schema,
                )

    return lambda batches: lean(run(batches))


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: set size, fingerprint of the set, band keys, odd
    sketch and parity bitmap of the whole set (null for an empty set)."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _signatures(shingle),
        "doc_id long, n_shingles long, fp binary, bands array<long>, sketch array<long>, parity array<long>",
    )


def _bitmaps() -> list[Column]:
    """Both bitmaps as columns of words: conditions on plain numbers stay small
    enough to be compiled."""
    return [F.coalesce(F.col(c)[i], F.lit(0)).alias(f"{c}{i}") for c in ("sketch", "parity") for i in range(SKETCH_WORDS)]


def _differing(a: str, b: str) -> Column:
    """Bit count of the XOR of two bitmaps."""
    return sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))


def alike(a: str, b: str, percent: int) -> Column:
    """Whether two documents can be linked: by the estimate of their sketches,
    and by the bits in which the bitmaps of their sets (prefix ``a``, ``b``)
    differ. Linked sets differ in at most (100 - percent) / (100 + percent) of
    the sum of their sizes."""
    fewest = (100 + percent) * _differing(f"{a}parity", f"{b}parity")
    return (_differing(f"{a}sketch", f"{b}sketch") <= most_bits(LEAST_ESTIMATE)) & (
        fewest <= (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n")))


def common_counts(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """``(node, n, common)``: set size, and how many of its shingles another
    node of the open buckets has. No overlap can be larger than that."""
    rows = open_.select("node").distinct().join(sets, "node").select(
        "node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    alone = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("node", "n")).alias("o"))
    alone = alone.filter("k = 1").groupBy("o.node").agg(F.count(F.lit(1)).alias("own"))
    sizes = open_.select("node").distinct().join(sets, "node").select("node", F.size("shingles").alias("n"))
    return sizes.join(alone, "node", "left").select(
        "node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose bitmaps allow a link."""
    facts = nodes.select("node", "n", *_bitmaps())
    left, right = (facts.select(*[F.col(c).alias(end if c == "node" else f"{end}_{c}") for c in facts.columns])
                   for end in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").filter(alike("a_", "b_", percent)).select("a", "b")


def _confirmed(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` that pass on their full sets."""
    shared = F.size(F.array_intersect("xa", "xb"))
    return (
        likely.join(sets.withColumnsRenamed({"node": "a", "shingles": "xa"}), "a")
        .join(sets.withColumnsRenamed({"node": "b", "shingles": "xb"}), "b")
        .withColumn("n", shared.cast("long"))
        .filter(100 * F.col("n") >= percent * (F.size("xa") + F.size("xb") - F.col("n")))
        .select("a", "b")
    )


def _pairs_of(a: str, b: str):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(docs: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """Component ``(node, component)`` of the class representatives ``reps``
    (node, bands, n, sketch, parity) that are linked with another one."""
    keyed = reps.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = materialise(keyed.join(shared, "key"), "buckets")
    members = materialise(buckets.select("node").distinct(), "candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(members, "node")
    # an id that was repeated with other text: the representative is the text of its class
    sets = materialise(texts.mapInArrow(_sets(shingle), "node long, shingles array<long>"), "sets")
    tried, labels = None, None
    for turn in range(STAR_ROUNDS + 1):
        open_ = buckets.withColumn("component", F.col("node"))
        if labels is not None:
            # the star of a bucket of two was its only pair
            known = labels.withColumnRenamed("component", "c")
            open_ = buckets.filter("n > 2").join(known, "node", "left").select(
                "key", "node", F.coalesce("c", "node").alias("component"))
            mixed = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
            open_ = materialise(open_.join(mixed.filter("lo < hi").select("key"), "key"), "open")
            if open_.isEmpty():
                break
        if turn < STAR_ROUNDS:
            draw = F.xxhash64(F.lit(turn), "node") if turn else F.col("node")
            pivot = open_.groupBy("key").agg(
                F.min_by(F.struct("node", "component"), F.struct(draw, "node")).alias("p"))
            pairs = open_.join(pivot, "key").filter("component <> p.component").select(
                *_pairs_of("node", "p.node"))
        else:
            facts = materialise(common_counts(open_, sets).join(reps.select("node", "sketch", "parity"), "node"), "facts")
            left = open_.join(facts, "node").select("key", "node", "component", "n", "common", *_bitmaps())
            right = left.select("key", *[F.col(c).alias(f"o_{c}") for c in left.columns if c != "key"])
            most = F.least("common", "o_common")
            fits = (100 * most >= percent * (F.col("n") + F.col("o_n") - most)) & alike("", "o_", percent)
            # the tests are part of the join, so pairs that fail are not rows
            pairs = left.join(right, (left["key"] == right["key"]) & (F.col("component") < F.col("o_component")) & fits)
            pairs = pairs.select(*_pairs_of("node", "o_node"))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        likely = _likely(pairs, reps, percent) if turn < STAR_ROUNDS else pairs
        good = materialise(_confirmed(likely, sets, percent), "good")
        if labels is None or not good.isEmpty():
            # what is known so far goes on as stars
            known = good if labels is None else good.unionByName(
                labels.select(F.col("component").alias("a"), F.col("node").alias("b")))
            labels = materialise(components(known), "labels")
    return labels


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document ``(doc_id, n_shingles, component_id, kept)``: the
    smallest id that links reach, and whether that is the document itself."""
    signed = materialise(signatures(docs, shingle), "signatures")
    classes = materialise(
        signed.filter("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")),
        "classes",
    )
    own = signed.withColumnRenamed("n_shingles", "n").dropDuplicates(["doc_id", "fp"])
    reps = materialise(
        own.join(classes.withColumnRenamed("node", "doc_id"), ["fp", "doc_id"])
        .select(F.col("doc_id").alias("node"), "bands", "n", "sketch", "parity"), "representatives",
    )
    labels = links(docs, reps, shingle, percent)
    named = classes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("c"))
    slim = signed.select("doc_id", "n_shingles", "fp")
    some = slim.filter("fp IS NOT NULL").join(named, "fp").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))
    none = slim.filter("fp IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Documents without those that are near copies of another; the smallest id
    of each component stays. Of rows that repeat an id one stays; an id repeated
    with other text goes only if none of its texts stays. Null ids stay."""
    return with_own_names(docs, ["doc_id", "text"], lambda d: _first_of_each(d, shingle, percent))


def _first_of_each(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    marked = materialise(near_duplicates(docs, shingle, percent).filter("doc_id IS NOT NULL"), "marked")
    by_id = marked.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    by_id = materialise(by_id.filter("NOT kept OR n > 1").withColumnRenamed("doc_id", "_id"), "affected")
    gone, again = by_id.filter("NOT kept").select("_id"), by_id.filter("kept AND n > 1").select("_id")
    left = docs.join(gone, docs["doc_id"] == F.col("_id"), "left_anti")
    if again.isEmpty():
        return left
    repeated = left.join(again, left["doc_id"] == F.col("_id"), "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return left.join(again, left["doc_id"] == F.col("_id"), "left_anti").unionByName(
        repeated.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n"))
