"""Alignment of the tokens of two tokenizers over the same bytes.

Each text is encoded by a byte-level BPE (A, on a space and the text) and a piece
model (B, on the text, to which it adds the space). Where an A and a B token end
at the same byte, the tokens are cut into groups; every A and B token of a group
are linked.

The merge is lockstep: a batch of documents is cut into lanes of some hundred
tokens, long documents into several, at common ends found by binary search. One
NumPy state vector holds the A and B pointers of all lanes. A step advances, in
every lane, the token that ends first, or both and closes a group; it emits the
cuts and the links of the closed groups, and lanes that are finished are
compacted away. So the number of steps follows the longest lane, not the longest
document.

How many documents hold an id pair is counted over the corpus. Documents are kept
in blocks with a list of the block's distinct pairs, and a document is a list of
numbers into it. Only the lists of pairs are shuffled, added up and joined back
(a pair has one row per block, so no pair is hot), and a block looks its documents
up by position. Blocks are closed after ``BLOCK_LINKS`` pairs.

A text that is null or empty, or whose tokens do not give the bytes of the space
and the text back, has no tokens: counts are 0 and lists and groups empty. Rows
need no id and repeated rows count as documents of their own. Other columns are
kept. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadsig.llm.bpe import SPECIAL, piece_bytes
from loadsig.llm.shared import bounded_batches, bucketed

LANE_TOKENS, SEARCH = 192, 24
BLOCK_LINKS = 1_000_000
WIDE_GROUP = 64
# The pattern that byte-level BPE splits text by, and the piece
# model's mark for a space.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_MARK = "▁"
LONG_WORD = re.compile(r"\S{500}|\s{500}")


@functools.lru_cache(maxsize=1)
def _load_a(content: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.encode_special_tokens = True
    return tokenizer


@functools.lru_cache(maxsize=1)
def _load_b(content: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=content)


def model_pieces(content: bytes) -> list[bytes]:
    """Bytes of the pieces of model B."""
    model = _load_b(content)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(piece.replace(SPACE_MARK, " ").encode())
    return out


def lane_starts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, n_a: np.ndarray, first_b: np.ndarray):
    """Cut documents into lanes at common ends.

    ``ends_*`` are byte ends of all tokens, documents one after another, with
    bytes counted over the whole batch. Returns the first A and B token of each
    lane. Where the ``SEARCH`` ends from a planned cut on are not common, there is
    no cut.
    """
    planned = [np.arange(LANE_TOKENS, n, LANE_TOKENS) + f - 1 for f, n in zip(first_a, n_a) if n > 2 * LANE_TOKENS]
    if not planned:
        return first_a, first_b
    tries = np.concatenate(planned)[:, None] + np.arange(SEARCH)
    wanted = ends_a[np.minimum(tries, len(ends_a) - 1)]
    at = np.searchsorted(ends_b, wanted)
    common = (ends_b[np.minimum(at, len(ends_b) - 1)] == wanted) & (tries < len(ends_a) - 1)
    some = common.any(axis=1)
    pick = common.argmax(axis=1)
    rows = np.flatnonzero(some)
    lanes_a = np.concatenate([first_a, tries[rows, pick[rows]] + 1])
    lanes_b = np.concatenate([first_b, at[rows, pick[rows]] + 1])
    lanes_a, index = np.unique(lanes_a, return_index=True)
    return lanes_a, lanes_b[index]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, lanes_a: np.ndarray, lanes_b: np.ndarray):
    """Groups of all lanes: arrays of their first and last-but-one A and B tokens.

    Both token lists are complete, so the last token of each lane ends a group.
    """
    stop_a = np.append(lanes_a[1:], len(ends_a))
    a, b = lanes_a.copy(), lanes_b.copy()
    from_a, from_b, stop = a.copy(), b.copy(), stop_a
    cuts = []
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        cut = end_a == end_b
        at = np.flatnonzero(cut)
        cuts.append((from_a[at], a[at], from_b[at], b[at]))
        from_a[at], from_b[at] = a[at], b[at]
        going = a < stop
        if not going.all():
            a, b, from_a, from_b, stop = a[going], b[going], from_a[going], from_b[going], stop[going]
    parts = [np.concatenate(c) for c in zip(*cuts)] if cuts else [np.empty(0, np.int64)] * 4
    order = np.argsort(parts[0], kind="stable")
    return tuple(p[order] for p in parts)


class Aligner:
    """Both tokenizers and the tables of their tokens, once per worker."""

    def __init__(self, vocabulary: str, model: bytes, pieces_a: list[bytes]) -> None:
        from tiktoken import Encoding

        self.model = _load_b(model)
        self.pieces = pieces_a, model_pieces(model)
        ranks = {piece: i for i, piece in enumerate(pieces_a) if piece != SPECIAL.encode()}
        self.fast = Encoding("a", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = _load_a(vocabulary)
        self.sizes = tuple(np.array([len(p) for p in pieces], np.int64) for pieces in self.pieces)
        names = [f"{i}{mark}" for mark in ",|" for i in range(len(pieces_a))]
        names += [f"{i}{mark}" for mark in (",", ";", "") for i in range(len(self.pieces[1]))]
        self.names = np.array(names, dtype=object)

    def encode_a(self, text: str) -> list[int]:
        """Ids of model A. The fast encoder takes quadratic time on long words,
        so texts with such words go to the other one; ids are the same."""
        if LONG_WORD.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, texts: list[str | None]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Positions of the texts that have tokens, and their A and B ids."""
        at = [i for i, t in enumerate(texts) if t]
        kept, ids_a, ids_b = [], [], []
        for i, b in zip(at, self.model.encode([texts[i] for i in at], num_threads=1) if at else []):
            whole = " " + texts[i]
            a, raw = self.encode_a(whole), whole.encode()
            if b"".join(map(self.pieces[0].__getitem__, a)) == raw == b"".join(map(self.pieces[1].__getitem__, b)):
                kept.append(i)
                ids_a.append(np.array(a, np.int64))
                ids_b.append(np.array(b, np.int64))
        return kept, ids_a, ids_b

    def align(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray]):
        """Per document: groups, links, group texts; and for all documents the
        distinct linked pairs as ``(document, pair, times)``."""
        n_a, n_b = (np.array([len(i) for i in ids]) for ids in (ids_a, ids_b))
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        groups = lockstep(ends_a, ends_b, *lane_starts(ends_a, ends_b, first_a, n_a, first_b))
        doc = np.searchsorted(first_a, groups[0], side="right") - 1
        size = (groups[1] - groups[0]) * (groups[3] - groups[2])
        n_groups = np.bincount(doc, minlength=len(n_a))
        n_links = np.bincount(doc, size, len(n_a)).astype(np.int64)
        texts = self._group_texts(a, b, groups, first_a, first_b, n_a, n_b)
        return n_groups, n_links, texts, self._pairs(a, b, groups, doc)

    def _pairs(self, a, b, groups, doc):
        a0, a1, b0, b1 = groups
        width = len(self.pieces[1])
        wide = np.maximum(a1 - a0, b1 - b0) > WIDE_GROUP
        pick = np.flatnonzero(~wide)
        n_b = b1[pick] - b0[pick]
        size = (a1[pick] - a0[pick]) * n_b
        group = np.repeat(np.arange(len(pick)), size)
        at = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        pair = a[a0[pick][group] + at // n_b[group]] * width + b[b0[pick][group] + at % n_b[group]]
        key, times = np.unique((doc[pick][group] << 32) + pair, return_counts=True)
        if wide.any():
            # ids of a very wide group are counted before they are paired
            keys, counts = [key], [times]
            for g in np.flatnonzero(wide):
                (ia, ca), (ib, cb) = (np.unique(x[s:e], return_counts=True) for x, s, e in ((a, a0[g], a1[g]), (b, b0[g], b1[g])))
                keys.append((int(doc[g]) << 32) + (ia[:, None] * width + ib[None]).ravel())
                counts.append((ca[:, None] * cb[None]).ravel())
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        return key >> 32, key & 0xFFFFFFFF, times

    def _group_texts(self, a, b, groups, first_a, first_b, n_a, n_b) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        a0, a1, b0, b1 = groups
        size_a, size_b = len(self.pieces[0]), len(self.pieces[1])
        name_a, name_b = a.copy(), b + 2 * size_a
        name_a[a1 - 1] += size_a
        name_b[b1 - 1] += size_b
        name_b[first_b + n_b - 1] += size_b
        merged = np.empty(len(a) + len(b), np.int64)
        merged[np.arange(len(a)) + np.repeat(b0, a1 - a0)] = name_a
        merged[np.arange(len(b)) + np.repeat(a1, b1 - b0)] = name_b
        start = first_a + first_b
        return ["".join(self.names[merged[s:e]].tolist()) for s, e in zip(start, start + n_a + n_b)]


@functools.lru_cache(maxsize=1)
def _aligner(vocabulary: str, model: bytes, pieces_a: tuple[bytes, ...]) -> Aligner:
    return Aligner(vocabulary, model, list(pieces_a))


def _squeeze(numbers: np.ndarray) -> bytes:
    """Non-negative numbers below 2^32 by byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return _packer().compress(planes.tobytes())


def _spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacker().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


@functools.lru_cache(maxsize=1)
def _packer():
    import zstandard

    return zstandard.ZstdCompressor(level=1)


@functools.lru_cache(maxsize=1)
def _unpacker():
    import zstandard

    return zstandard.ZstdDecompressor()


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
LIST_ROWS = 20_000


class _Block:
    """Documents of a block until it is closed."""

    def __init__(self, name: str, schema: pa.Schema) -> None:
        self.name, self.schema = name, schema
        self.rows, self.pairs, self.times, self.links = [], [], [], 0

    def add(self, row, counts: tuple, text: str, pairs: np.ndarray, times: np.ndarray) -> None:
        self.rows.append((row, *counts, _packer().compress(text.encode())))
        self.pairs.append(pairs)
        self.times.append(times)
        self.links += len(pairs) + 1

    def finished(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        distinct, number, docs = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        at, rows = 0, []
        for row, pairs, times in zip(self.rows, self.pairs, self.times):
            mine = number[at:at + len(pairs)]  # ascending, as pairs are
            at += len(pairs)
            rows.append((self.name, *row, _squeeze(np.diff(mine, prepend=0)), _squeeze(times), None, None, None))
        for s in range(0, len(distinct), LIST_ROWS):
            rows.append((self.name, *[None] * 8, s, distinct[s:s + LIST_ROWS], docs[s:s + LIST_ROWS]))
        for s in range(0, len(rows), 200):
            columns = zip(*rows[s:s + 200])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def _align_blocks(schema: pa.Schema, block_links: int, *models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, part, done = _aligner(*models), TaskContext.get().partitionId(), 0
        block, none = _Block(f"{part}-0", schema), np.empty(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                rows = piece.column("_tok_row").to_pylist()
                kept, ids_a, ids_b = aligner.encode(piece.column("_tok_text").to_pylist())
                for i in set(range(len(rows))) - set(kept):
                    block.add(rows[i], (0, 0, 0, 0), "", none, none)
                if not kept:
                    continue
                n_groups, n_links, texts, (doc, pair, times) = aligner.align(ids_a, ids_b)
                cut = np.searchsorted(doc, np.arange(len(kept) + 1))
                for j, i in enumerate(kept):
                    mine = slice(cut[j], cut[j + 1])
                    block.add(rows[i], (len(ids_a[j]), len(ids_b[j]), int(n_groups[j]), int(n_links[j])), texts[j],
                              pair[mine], times[mine])
                    if block.links >= block_links:
                        yield from block.finished()
                        done += 1
                        block = _Block(f"{part}-{done}", schema)
        yield from block.finished()

    return run


def _add_counts(schema: pa.Schema):
    def join(docs: pa.Table, values: pa.Table) -> pa.Table:
        """Look the counts of a block's pairs up by position."""
        number = values.column("number").to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), bool)
        count[number] = values.column("count").to_numpy()
        best[number] = values.column("best").to_numpy(zero_copy_only=False)
        n_best, sums, texts = [], [], []
        for pairs, times, text in zip(*(docs.column(c).to_pylist() for c in ("pairs", "times", "groups"))):
            pairs, times = np.cumsum(_spread(pairs)), _spread(times)
            n_best.append(int(times[best[pairs]].sum()))
            sums.append(int((times * count[pairs]).sum()))
            texts.append(_unpacker().decompress(text).decode())
        columns = [docs.column("row"), *(docs.column(c) for c in COUNTS), pa.array(n_best, pa.int64()),
                   pa.array(sums, pa.int64()), pa.array(texts, pa.string())]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)

    return join


def align(docs: DataFrame, vocabulary: str, model: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """``docs`` without ``text``, with ``n_a, n_b, n_groups, n_links, n_best,
    count_sum`` and ``groups``, the ids of all groups as ``a1,a2|b1;a3|b2,b3``.

    ``n_best`` counts the links whose pair has the highest document count of its
    A id, ``count_sum`` adds the document counts over the links. ``vocabulary``
    and ``model`` are paths on the driver; tasks get the contents. Columns that
    have one of these names already are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    with open(model, "rb") as f:
        pieces = f.read()
    new = (*COUNTS, "n_best", "count_sum", "groups")
    kept = [c for c in docs.columns if c not in ("text", *new)]
    row = F.struct(*[docs[f"`{c}`"] for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    read = docs.select(row.alias("_tok_row"), docs["text"].alias("_tok_text"))
    row_schema = read.schema["_tok_row"].dataType
    row_type = to_arrow_type(row_schema)
    arrow = pa.schema([("block", pa.string()), ("row", row_type), *((c, pa.int64()) for c in COUNTS), ("groups", pa.binary()),
                       ("pairs", pa.binary()), ("times", pa.binary()), ("start", pa.int64()),
                       ("distinct", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
    schema = T.StructType().add("block", "string").add("row", row_schema)
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("groups", "binary").add("pairs", "binary").add("times", "binary").add("start", "long") \
        .add("distinct", T.ArrayType(T.LongType())).add("docs", T.ArrayType(T.LongType()))
    tables = tuple(piece_bytes(vocabulary))
    coded = bucketed(read.mapInArrow(_align_blocks(arrow, block_links, content, pieces, tables), schema), "block",
                     max(16, 4 * read.rdd.getNumPartitions()), "aligned")
    lists = coded.filter("start IS NOT NULL").select(
        "block", "start", F.posexplode(F.arrays_zip("distinct", "docs")).alias("at", "z")).select(
        "block", (F.col("start") + F.col("at")).alias("number"), F.col("z.distinct").alias("pair"), F.col("z.docs").alias("docs"))
    counts = lists.groupBy("pair").agg(F.sum("docs").alias("count"))
    width = len(model_pieces(pieces))
    counts = counts.withColumn("a", F.expr(f"pair div {width}"))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    marked = counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    values = lists.join(marked, "pair").select(F.col("block").alias("of"), "number", "count", "best")
    out = T.StructType().add("row", row_schema)
    for c in new[:-1]:
        out = out.add(c, "long")
    out = out.add("groups", "string")
    result = pa.schema([("row", row_type), *((c, pa.int64()) for c in new[:-1]), ("groups", pa.string())])
    joined = coded.filter("start IS NULL").select("block", "row", *COUNTS, "groups", "pairs", "times").groupBy("block").cogroup(
        values.groupBy("of")).applyInArrow(_add_counts(result), out)
    return joined.select(*[F.col("row").getField(c).alias(c) for c in kept], *new)

