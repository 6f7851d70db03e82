"""BPE encoding over a table of distinct words, decoding over a table of pieces.

Spark splits every text into words by the tokenizer's own pattern (special
tokens first). A block of documents is stored as numbers into the block's list
of distinct words. The lists are cut by word hash, so that each distinct word of
the corpus meets in one place and is encoded there once; its ids go back to the
blocks that have it and are joined to the documents by position. The documents
are written in buckets by block, so they are not shuffled for that join.

Only short lists travel: of each block every distinct word once, packed, and the
numbers of its words, most frequent first, packed by byte planes. A block holds
at most ``BLOCK_WORDS`` words, but for a single longer document. Until it is
written its words are Arrow dictionaries, not Python strings, so that a worker
stays small.

Decoding joins ids to pieces: the vocabulary is a table of fixed size, held by
every task, and an array of ids picks its pieces by position.

A null text is an empty text: no ids, decoded to an empty text. Rows need no id,
repeated rows are encoded each, extra columns are kept; one named like a result is
replaced. Columns whose names start
with ``_bpe`` are reserved. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadsig.llm.shared import bounded_batches, bucketed, give_back, lean

# The pattern that byte-level BPE splits text by, its white space
# written out, and the special token.
SPACE = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
           rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SPECIAL = "<|endoftext|>"

BLOCK_WORDS = 2_000_000
ENCODE_BATCH = 2_000
CODED = pa.dictionary(pa.int32(), pa.string())


def words(text: Column) -> Column:
    """The words of a text in order; they concatenate to the text."""
    def cut(piece: Column) -> Column:
        return F.regexp_extract_all(piece, F.lit(PATTERN), F.lit(0))

    parts = F.transform(F.split(text, r"<\|endoftext\|>", -1), lambda p: F.concat(cut(p), F.array(F.lit(SPECIAL))))
    marked = F.flatten(parts)
    return F.when(F.contains(text, F.lit(SPECIAL)), F.slice(marked, F.lit(1), F.size(marked) - 1)).otherwise(cut(text))


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative numbers below 2^32 by byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zlib.compress(planes.tobytes(), 6)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def pack_words(values: pa.StringArray) -> bytes:
    """Strings as their byte lengths and their bytes, compressed."""
    sizes = pack(pc.binary_length(values).to_numpy(zero_copy_only=False))
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    raw = memoryview(values.buffers()[2] or b"")[ends[0]:ends[-1]]
    return len(sizes).to_bytes(4, "little") + sizes + zlib.compress(raw, 6)


def unpack_words(data: bytes) -> pa.Array:
    at = 4 + int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.concatenate(([0], unpack(data[4:at])))).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(zlib.decompress(data[at:])))


def word_bucket(values: pa.Array, buckets: int) -> np.ndarray:
    found = np.empty(len(values), np.int64)
    for at in range(0, len(values), ENCODE_BATCH):
        part = values.slice(at, ENCODE_BATCH).to_pylist()
        found[at:at + len(part)] = [zlib.crc32(w.encode()) % buckets for w in part]
    return found


def _block_rows(block: str, texts: list, sizes: list[int], pieces: list[pa.DictionaryArray], buckets: int):
    """Rows of a finished block: its documents, which have ``sizes`` words each,
    and its word lists. ``pieces`` are taken out of their list."""
    unified = pa.chunked_array(pieces, CODED).unify_dictionaries().chunks
    pieces.clear()
    names = unified[0].dictionary if unified else pa.array([], pa.string())
    seen = np.zeros(len(names), np.int64)
    for p in unified:
        seen += np.bincount(p.indices.to_numpy(), minlength=len(names))
    order = np.argsort(-seen, kind="stable")
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(len(order), dtype=np.uint32)
    codes, done = np.empty(sum(map(len, unified)), np.uint32), 0
    while unified:
        p = unified.pop(0)
        codes[done:done + len(p)] = number[p.indices.to_numpy()]
        done += len(p)
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    rows = [(block, None, row, pack(codes[end - n:end]), None) for row, n, end in zip(texts, sizes, ends)]
    if len(names):
        bucket = word_bucket(names, buckets)
        for b in np.unique(bucket):
            at = np.flatnonzero(bucket == b)
            at = at[np.argsort(number[at])]
            rows.append((block, int(b), None, pack(number[at]), pack_words(names.take(pa.array(at)))))
    return rows


def _code_blocks(row_type: pa.DataType, buckets: int, block_words: int):
    schema = pa.schema([("block", pa.string()), ("bucket", pa.int64()), ("row", row_type),
                        ("codes", pa.binary()), ("words", pa.binary())])

    def table_of(rows) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 2000):
            part = rows[at:at + 2000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in part], field.type) for i, field in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        rows, sizes, pieces, total = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                found = piece.column("_bpe_words")
                pieces.append(pc.dictionary_encode(found.flatten()))
                sizes += pc.list_value_length(found).to_pylist()
                rows += piece.column("_bpe_row").to_pylist()
                total += len(pieces[-1])
                if total >= block_words:
                    yield from table_of(_block_rows(f"{part}-{done}", rows, sizes, pieces, buckets))
                    rows, sizes, pieces, total, done = [], [], [], 0, done + 1
        yield from table_of(_block_rows(f"{part}-{done}", rows, sizes, pieces, buckets))

    return lambda batches: lean(run(batches))


@functools.lru_cache(maxsize=1)
def _load(vocabulary: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def _encode_words(vocabulary: str):
    """Encode the distinct words of one bucket once; give every block its own."""
    def encoded(rows: pd.DataFrame) -> pd.DataFrame:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = _load(vocabulary)
        lists = [unpack_words(w) for w in rows["words"]]
        coded = pc.dictionary_encode(pa.concat_arrays(lists))
        sizes, parts = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for at in range(0, len(coded.dictionary), ENCODE_BATCH):
            part = coded.dictionary.slice(at, ENCODE_BATCH).to_pylist()
            ids = [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            parts.append(np.fromiter((i for word in ids for i in word), np.int32, int(sizes[-1].sum())))
        length, flat = np.concatenate(sizes), np.concatenate(parts)
        start = np.cumsum(length) - length
        index, at, out = coded.indices.to_numpy(), 0, []
        for block, numbers, words_ in zip(rows["block"], rows["codes"], lists):
            mine = index[at:at + len(words_)]
            at += len(words_)
            out.append((block, numbers, pack(length[mine]), pack(_gather(flat, start[mine], length[mine]))))
        return pd.DataFrame(out, columns=["block", "numbers", "lengths", "ids"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return encoded(rows)
        finally:
            give_back()

    return run


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[start:start + length]`` for all entries."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) - np.repeat(ends - length, length) + np.repeat(start, length)]


def _text(ids: list[int], pieces: list[bytes]) -> str:
    return b"".join(map(pieces.__getitem__, ids)).decode("utf-8", "replace")


def _ids_by_position(schema: pa.Schema, pieces: list[bytes] | None):
    """Join the ids of a block's words to its documents, and the pieces of the
    ids if they are given."""

    def run(docs: Iterator[pa.RecordBatch], words_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, length, flat = [], [], []
        for batch in words_:
            for n, le, i in zip(*(batch.column(c).to_pylist() for c in ("numbers", "lengths", "ids"))):
                number.append(unpack(n).astype(np.int64))
                length.append(unpack(le).astype(np.int64))
                flat.append(unpack(i).astype(np.int32))
        size = sum(map(len, number))
        lengths, starts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        before = 0
        for n, le in zip(number, length):
            lengths[n], starts[n] = le, before + np.cumsum(le) - le
            before += int(le.sum())
        all_ids = np.concatenate(flat) if flat else np.empty(0, np.int32)
        for batch in docs:
            for at in range(0, batch.num_rows, 100):
                piece, ids = batch.slice(at, 100), []
                for codes in piece.column("codes").to_pylist():
                    c = unpack(codes)
                    ids.append(_gather(all_ids, starts[c], lengths[c]))
                columns = [piece.column("row"), pa.array(ids, schema.field("ids").type)]
                if pieces is not None:
                    columns.append(pa.array([_text(i.tolist(), pieces) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def encode(docs: DataFrame, vocabulary: str, block_words: int = BLOCK_WORDS, with_text: bool = False) -> DataFrame:
    """``docs`` without ``text``, with ``ids``. ``vocabulary`` is the path of a
    tokenizer file on the driver; tasks get its content. ``with_text`` decodes
    the ids again, as ``decode`` does, in the task that has them: a column
    ``decoded``."""
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    new = ("ids", "decoded") if with_text else ("ids",)
    kept = [c for c in docs.columns if c.lower() not in ("text", *new)]
    row = F.struct(*[docs[c] for c in kept]) if kept else F.struct(F.lit(0).alias("_bpe_none"))
    cut = docs.select(row.alias("_bpe_row"), words(F.coalesce(docs["text"], F.lit(""))).alias("_bpe_words"))
    row_schema = cut.schema["_bpe_row"].dataType
    row_type = to_arrow_type(row_schema)
    # lists are cut finer as the table grows, so that a bucket stays small
    buckets = max(16, 4 * docs.rdd.getNumPartitions())
    schema = T.StructType().add("block", "string").add("bucket", "long").add("row", row_schema) \
        .add("codes", "binary").add("words", "binary")
    coded = bucketed(cut.mapInArrow(_code_blocks(row_type, buckets, block_words), schema), "block", buckets, "blocks")
    encoded = coded.filter("bucket IS NOT NULL").select("block", "bucket", "codes", "words").groupBy("bucket").applyInPandas(
        _encode_words(content), "block string, numbers binary, lengths binary, ids binary")
    out = T.StructType().add("row", row_schema).add("ids", T.ArrayType(T.IntegerType()))
    arrow = [("row", row_type), ("ids", pa.list_(pa.int32()))]
    if with_text:
        out, arrow = out.add("decoded", "string"), [*arrow, ("decoded", pa.string())]
    joined = coded.filter("bucket IS NULL").select("block", "row", "codes").groupBy("block").cogroup(
        encoded.groupBy("block")).applyInArrow(_joiner(arrow, piece_bytes(vocabulary) if with_text else None), out)
    return joined.select(*[F.col("row").getField(c).alias(c) for c in kept], *out.names[1:])


def _joiner(columns: list[tuple[str, pa.DataType]], pieces: list[bytes] | None):
    schema = pa.schema(columns)
    run = _ids_by_position(schema, pieces)

    def join(docs: pa.Table, words_: pa.Table) -> pa.Table:
        try:
            return pa.Table.from_batches(
                list(run(iter(docs.to_batches()), iter(words_.to_batches()))), schema=schema)
        finally:
            give_back()

    return join


def piece_bytes(vocabulary: str) -> list[bytes]:
    """Bytes of each id: the characters of byte-level pieces stand for bytes."""
    with open(vocabulary, encoding="utf-8") as f:
        parts = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    names = {i: w for w, i in parts["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parts["added_tokens"]}
    out = []
    for i in range(max(names) + 1):
        name = names.get(i, "")
        known = all(c in byte_of for c in name)
        out.append(bytes(byte_of[c] for c in name) if known else name.encode())
    return out


def decode(encoded: DataFrame, vocabulary: str, column: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the text of the ids. Bytes that are no UTF-8 become U+FFFD."""
    pieces = piece_bytes(vocabulary)

    @F.pandas_udf("string")
    def look_up(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in parts:
            yield pd.Series([
                None if row is None else _text(row.tolist(), pieces) for row in ids
            ], dtype=object)

    return encoded.withColumn(to, look_up(column))
