"""Alignment of two tokenizers against a plain version."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loadsig.llm import crosstok
from loadsig.llm.bpe import piece_bytes
from loadsig.llm.queries import PIECE_MODEL, QUERIES, VOCABULARY

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def plain(texts):
    """The same by nested loops, for every text."""
    a_model, b_model = Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    a_model.encode_special_tokens = True
    bytes_a = piece_bytes(VOCABULARY)
    docs = []
    for text in texts:
        groups = []
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
            a_bytes = [bytes_a[i] for i in a]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
                i = j = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    to_a, to_b = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                    groups.append((a[i:to_a], b[j:to_b]))
                    i, j = to_a, to_b
        docs.append(groups)
    count = {}
    for groups in docs:
        for pair in {(i, j) for a, b in groups for i in a for j in b}:
            count[pair] = count.get(pair, 0) + 1
    top = {}
    for (i, _), n in count.items():
        top[i] = max(n, top.get(i, 0))
    out = []
    for groups in docs:
        links = [(i, j) for a, b in groups for i in a for j in b]
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                    ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)))
    return out


def texts_of(seed):
    rng = random.Random(seed)
    some = ["hello", "world", "  ", "\n", "\t", "naïve", "日本語", "😀", "é", "<s>", "<|endoftext|>", "</s>", "x" * 40, "12345", "'s", "…",
            " ", "ﬁ", "́", "Straße", "=====", "\x00", "łódź"]
    texts = ["".join(rng.choice(some) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    return texts + [None, "", " ", "▁x", "a▁", "word " * 900, "ab" * 2000, " " * 700, "aé" * 500, texts[0], texts[0]]


@pytest.mark.parametrize("seed,block", [(1, 50), (2, 1_000_000)])
def test_equals_plain_version(spark, seed, block):
    texts = texts_of(seed)
    rows = [(i if i % 9 else None, t, "x", 1, ["y"]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, n_a long, pairs array<string>").repartition(3)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in crosstok.align(docs, VOCABULARY, PIECE_MODEL, block).collect())
    assert got == sorted(plain(texts))
    kept = crosstok.align(docs, VOCABULARY, PIECE_MODEL, block)
    assert kept.columns == ["doc_id", "block", "pairs", *COLUMNS]
    assert {r["block"] for r in kept.collect()} == {"x"}


def test_empty_table_and_query_columns(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert crosstok.align(docs, VOCABULARY, PIECE_MODEL).collect() == []
    import duckdb

    table = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
    want = plain([t for _, t in table])
    got = {r["doc_id"]: r for r in QUERIES["op11_lockstep_alignment"](spark, sf_dir).collect()}
    assert len(got) == len(table)
    for (doc_id, _), w in zip(table, want):
        r = got[doc_id]
        assert tuple(r[c] for c in COLUMNS[:-1]) == w[:-1]
        assert r["groups_sha256"] == (hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")


def test_lanes_give_the_same_groups(monkeypatch):
    rng = np.random.default_rng(3)
    ends_a, ends_b, first_a, first_b, n_a, n_b, at = [], [], [], [], [], [], 0
    for _ in range(20):
        size = int(rng.integers(5, 3000))
        a, b = (np.unique(np.append(rng.integers(1, size + 1, size // 3 + 1), size)) for _ in range(2))
        first_a.append(sum(n_a)), first_b.append(sum(n_b)), n_a.append(len(a)), n_b.append(len(b))
        ends_a.append(a + at), ends_b.append(b + at)
        at += size
    ends_a, ends_b = np.concatenate(ends_a), np.concatenate(ends_b)
    first_a, first_b, n_a = np.array(first_a), np.array(first_b), np.array(n_a)
    whole = crosstok.lockstep(ends_a, ends_b, first_a, first_b)
    for tokens in (3, 10, 50):
        monkeypatch.setattr(crosstok, "LANE_TOKENS", tokens)
        cut = crosstok.lockstep(ends_a, ends_b, *crosstok.lane_starts(ends_a, ends_b, first_a, n_a, first_b))
        assert all((x == y).all() for x, y in zip(whole, cut))
    assert (ends_a[whole[1] - 1] == np.intersect1d(ends_a, ends_b)).all()
