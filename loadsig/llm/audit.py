"""Interaction audit of document filters, with exact duplicates from text tries.

Every document gets a mask of the filters that it fails. Four filters look at
the text alone. The fifth fails a text that a smaller ``doc_id`` has as well; it
is decided with compressed tries that hold whole texts:

1. Each task inserts the texts it reads into a trie of bounded size. Terminals
   hold the smallest id and the rows of the text, so copies that meet here are
   decided and each text leaves the task once, however many copies it has.
2. The remaining texts are range-partitioned by adaptive prefixes: a prefix that
   more than ``TRIE_BYTES`` of text begin with is replaced by longer ones, four
   times as long each time, until nothing is too large or it is a whole text.
3. Within a partition one trie is built per prefix and freed at the next one.
   Traversing its terminals flags the rows whose id is not the smallest.

The masks are then counted by part. Whatever the order of the filters, a step
depends only on its filter and the set of filters before it, so the counts of
all orders come from 2^n masks per part.

A null text is an empty text, a null part the empty string. A row without id is
no copy of another and makes none. Repeated rows are counted each; rows with one
id and one text are not copies of each other. If a label table has several rows
of an id, the largest values count. Other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadsig.llm.shared import bounded_batches
from loadsig.session import materialise

# The filters, their limits and the characters of the fourth.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ODD = re.compile(rb"[#$%&*|]")
COPY = 1 << FILTERS.index("E")

TRIE_BYTES = 16 << 20
FIRST_PREFIX, LONGER = 8, 4
MOST_PARTITIONS = 20_000


class Trie:
    """Compressed radix trie of byte strings. A node is ``[children, rows]``;
    ``children`` maps the first byte of an edge to its label and node."""

    def __init__(self) -> None:
        self.root: list = [None, None]

    def insert(self, text: bytes, row) -> None:
        node, at = self.root, 0
        while at < len(text):
            if node[0] is None:
                node[0] = {}
            edge = node[0].get(text[at])
            if edge is None:
                leaf: list = [None, None]
                node[0][text[at]] = (text[at:], leaf)
                node, at = leaf, len(text)
                break
            label, child = edge
            if not text.startswith(label, at):
                same = _common(label, text[at:at + len(label)])
                middle = [{label[same]: (label[same:], child)}, None]
                node[0][text[at]] = (label[:same], middle)
                child, label = middle, label[:same]
            node, at = child, at + len(label)
        if node[1] is None:
            node[1] = []
        node[1].append(row)

    def terminals(self) -> Iterator[list]:
        """The rows of each text."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[1] is not None:
                yield node[1]
            if node[0]:
                stack += [child for _, child in node[0].values()]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning of two different strings."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def text_mask(text: bytes, n_chars: int) -> int:
    """The filters on the text alone, one bit each."""
    words = text.split()  # bytes split at the six ASCII white-space characters
    upper = len(text) - len(text.translate(None, UPPER))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * upper > UPPER_PERCENT * n_chars,
        ODD.search(text) is not None,
    )
    return sum(1 << bit for bit, fail in enumerate(fails) if fail)


_SEEN = "doc_id long, part string, mask int, n long, text string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()),
                    ("text", pa.string())])


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 500):
        columns = zip(*rows[at:at + 500])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _own_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of a task's rows. Rows that are copies of another row here are
    decided; one row of each text keeps the text."""
    trie, size, plain = Trie(), 0, []

    def finished():
        yield from plain
        for rows in trie.terminals():
            first = min(r[0] for r in rows)
            text, same = rows[0][3], {}
            for doc_id, part, mask, _ in rows:
                if doc_id > first:
                    yield doc_id, part, mask | COPY, 1, None
                else:
                    same[part, mask] = same.get((part, mask), 0) + 1
            for (part, mask), n in same.items():
                yield first, part, mask, n, text

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            piece = batch.slice(at, 500)
            texts = pc.fill_null(piece.column("text"), "")
            rows = zip(piece.column("doc_id").to_pylist(), piece.column("part").to_pylist(),
                       texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist())
            for doc_id, part, text, n_chars in rows:
                mask = text_mask(text, n_chars)
                if doc_id is None:
                    plain.append((None, part, mask, 1, None))
                else:
                    trie.insert(text, (doc_id, part, mask, text))
                    size += len(text) + 100
        if size > TRIE_BYTES:
            yield from _batches(list(finished()))
            trie, size, plain = Trie(), 0, []
    yield from _batches(list(finished()))


def _all_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flags of rows that come sorted by prefix: a trie per prefix."""
    schema = pa.schema([f for f in _ARROW if f.name != "text"])
    trie, now, held = Trie(), None, 0

    def finished() -> Iterator[pa.RecordBatch]:
        rows = []
        for found in trie.terminals():
            first = min(r[0] for r in found)
            rows += [(i, part, mask | COPY if i > first else mask, n) for i, part, mask, n in found]
        for at in range(0, len(rows), 5000):
            columns = zip(*rows[at:at + 5000])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        rest = zip(*(batch.column(c).to_pylist() for c in ("prefix", "doc_id", "part", "mask", "n")))
        for (prefix, *row), text in zip(rest, texts):
            if prefix != now:
                # small tries are kept together until there is something to free
                if held > TRIE_BYTES // 4:
                    yield from finished()
                    trie, held = Trie(), 0
                now = prefix
            text = text.as_py()
            trie.insert(text, tuple(row))
            held += len(text) + 100
    yield from finished()


def adaptive_prefixes(rows: DataFrame, most: int = TRIE_BYTES, first: int = FIRST_PREFIX) -> DataFrame:
    """Add ``prefix``: a beginning of ``text`` that no more than ``most`` bytes
    of texts share, or the whole text. Each list of too common prefixes has at
    most (bytes of all texts) / ``most`` rows."""
    length, keyed = first, rows.withColumn("prefix", F.left("text", F.lit(first)))
    open_ = keyed
    while True:
        common = open_.filter(F.char_length("text") > length).select("prefix").distinct()
        sizes = open_.groupBy("prefix").agg(F.sum(F.octet_length("text")).alias("size")).filter(F.col("size") > most)
        common = materialise(sizes.join(common, "prefix", "left_semi").select("prefix"), "prefixes")
        if common.isEmpty():
            return keyed
        length *= LONGER
        longer = F.left("text", F.lit(length))
        known = common.select(F.col("prefix").alias("_common"))
        keyed = keyed.join(known, F.col("prefix") == F.col("_common"), "left").withColumn(
            "prefix", F.when(F.col("_common").isNotNull(), longer).otherwise(F.col("prefix"))).drop("_common")
        open_ = open_.join(common, "prefix", "left_semi").withColumn("prefix", longer)


def filter_masks(docs: DataFrame, part: Column | str = "source") -> DataFrame:
    """``(doc_id, part, mask, n)``: the filters that a document fails, as bits in
    the order of ``FILTERS``; ``n`` rows of one document are one row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    part = F.col(part) if isinstance(part, str) else part
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    seen = materialise(read.mapInArrow(_own_copies, _SEEN), "texts")
    texts = seen.filter("text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = adaptive_prefixes(texts)
    n = min(MOST_PARTITIONS, max(1, size // TRIE_BYTES * 2))
    sorted_ = keyed.repartitionByRange(n, "prefix").sortWithinPartitions("prefix")
    flagged = sorted_.mapInArrow(_all_copies, "doc_id long, part string, mask int, n long")
    return seen.filter("text IS NULL").drop("text").unionByName(flagged)


def interactions(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts of every step of every order of the filters, by part.

    ``masks`` has ``part, mask, n`` and the label columns ``good`` and ``toxic``
    (1 or 0). Per part and step: ``kept``, ``removed``, ``redundant`` (fails this
    filter, removed earlier), ``unique_fails``, ``good_lost``, ``toxic_lost`` and
    ``shapley`` (what the filter removes, over all orders).
    """
    n_filters = len(filters)

    def total(column: Column, when: Column) -> Column:
        return F.sum(F.when(when, column).otherwise(0))

    n, good, toxic = F.col("n"), F.col("n") * F.col("good"), F.col("n") * F.col("toxic")
    counted = masks.groupBy("part", "mask").agg(
        F.sum(n).alias("n"), F.sum(good).alias("good"), F.sum(toxic).alias("toxic"))
    # a row per filter and set of filters before it
    cells = (
        counted.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(n_filters - 1))))
        .withColumn("earlier", F.explode(F.sequence(F.lit(0), F.lit(2**n_filters - 1))))
        .withColumn("bit", F.expr("shiftleft(1, f)"))
        .filter(F.col("earlier").bitwiseAND(F.col("bit")) == 0)
    )
    mask, earlier, bit = F.col("mask"), F.col("earlier"), F.col("bit")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(earlier) != 0
    weight = F.create_map(*[F.lit(v) for size in range(n_filters)
                            for v in (size, factorial(size) * factorial(n_filters - 1 - size))])
    steps = cells.groupBy("part", "f", "earlier").agg(
        total(n, ~fails & ~gone).alias("kept"),
        total(n, fails & ~gone).alias("removed"),
        total(n, fails & gone).alias("redundant"),
        total(n, mask == bit).alias("unique_fails"),
        total(F.col("good"), fails & ~gone).alias("good_lost"),
        total(F.col("toxic"), fails & ~gone).alias("toxic_lost"),
    )
    shapley = steps.groupBy("part", "f").agg(
        F.sum(F.col("removed") * weight[F.bit_count("earlier")]).cast("long").alias("shapley"))
    orders = masks.sparkSession.createDataFrame(_order_steps(filters), "filter_order string, step int, f int, earlier int")
    return steps.join(shapley, ["part", "f"]).join(orders, ["f", "earlier"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _order_steps(filters: str) -> list[tuple[str, int, int, int]]:
    rows = []
    for order in permutations(range(len(filters))):
        name, earlier = "".join(filters[f] for f in order), 0
        for step, f in enumerate(order, start=1):
            rows.append((name, step, f, earlier))
            earlier |= 1 << f
    return rows


def audit(docs: DataFrame, labels: DataFrame, part: Column | str = "source") -> DataFrame:
    """All steps of all orders of the filters on ``docs``, by part."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    found = materialise(filter_masks(docs, part), "filter-masks")
    # rows without id have no labels and would meet in one task of the join
    with_id = found.filter("doc_id IS NOT NULL").join(known, "doc_id", "left")
    without = found.filter("doc_id IS NULL").withColumns({c: F.lit(0) for c in ("good", "toxic")})
    masks = with_id.unionByName(without).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    return interactions(materialise(masks.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")), "masks"))
