"""Memory of the Python workers, and the results that must not change with it."""

import subprocess
import sys
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark

from loadsig.llm import bpe, langid


def peak_of(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_language_fit_keeps_two_bytes_a_gram():
    rng = np.random.default_rng(3)
    letters = {"aa": "abcdefghijklm", "bb": "nopqrstuvwxyz"}
    texts, langs = [], []
    for i in range(200):
        lang = "ab"[i % 2] * 2
        texts.append(" ".join("".join(rng.choice(list(letters[lang]), 6)) for _ in range(800)))
        langs.append(lang)
    (names, table, _, strange), peak = peak_of(lambda: langid.fit_softmax(texts, langs))
    n_grams = sum(len(langid.grams(t)) for t in texts)
    # the grams of the whole sample at two bytes, and the tables of a fit
    assert peak < 2 * n_grams + (8 << 20)
    assert names == ["aa", "bb"] and np.isfinite(strange.limit)
    assert all(names[int((np.bincount(langid.grams(t), minlength=langid.BUCKETS) @ table).argmax())] == lang
               for t, lang in zip(texts, langs))


def test_block_of_distinct_words_is_not_python_strings(monkeypatch):
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 7))
    n, docs = 200_000, 500
    words = [f" w{i}" for i in range(n)] + [" w5"] * n
    texts = [words[i::docs] for i in range(docs)] + [[]]
    row = pa.struct([("doc_id", pa.int64())])
    batch = pa.RecordBatch.from_arrays(
        [pa.array([{"doc_id": i} for i in range(len(texts))], row), pa.array(texts, pa.list_(pa.string()))],
        names=["_bpe_row", "_bpe_words"])
    out, peak = peak_of(lambda: list(bpe._code_blocks(row, 16, 10 * n)(iter([batch]))))
    assert peak < 60 * n
    rows = [r for b in out for r in b.to_pylist()]
    named = {}
    for r in rows:
        if r["words"] is not None:
            found = bpe.unpack_words(r["words"])
            assert set(bpe.word_bucket(found, 16)) == {r["bucket"]}
            named |= dict(zip(bpe.unpack(r["codes"]).tolist(), found.to_pylist()))
    assert len(named) == n and named[0] == " w5"
    assert [[named[c] for c in bpe.unpack(r["codes"]).tolist()] for r in rows if r["row"] is not None] == texts


def test_language_fit_keeps_buckets_and_counts():
    rng = np.random.default_rng(5)
    words = [["".join(rng.choice(list(letters), 6)) for _ in range(300)] for letters in ("abcdefghijklm", "nopqrstuvwxyz")]
    texts = [" ".join(rng.choice(words[i % 2], 12_000)) for i in range(60)]
    _, peak = peak_of(lambda: langid.fit_softmax(texts, ["aa", "bb"] * 30))
    n_grams = sum(len(langid.grams(t)) for t in texts)
    # learned texts are short lists; those set aside, a fifth, still have two bytes a gram
    assert peak < n_grams + (16 << 20)
    for text in ("Hello, hello World", "aaaa" * 500, "12 !"):
        bag = langid.grams(text)
        assert np.array_equal(langid._rows([langid._counted(text)])[0] if len(bag) else np.zeros(langid.BUCKETS, np.float32),
                              (np.bincount(bag, minlength=langid.BUCKETS) / max(1, len(bag))).astype(np.float32))


WORKER = """
import re, sys
from types import SimpleNamespace
import numpy as np, pyarrow as pa, pyspark
from loadsig.llm import bpe

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    for i in range(24):
        values = pa.array([f" w{n}" for n in range(20_000 * i, 20_000 * i + 40_000)])
        row = pa.StructArray.from_arrays([pa.array(range(400))], ["doc_id"])
        lists = pa.ListArray.from_arrays(pa.array(range(0, 40_001, 100), pa.int32()), values)
        yield pa.RecordBatch.from_arrays([row, lists], names=["_bpe_row", "_bpe_words"])

pyspark.TaskContext.get = lambda: SimpleNamespace(partitionId=lambda: 7)
for b in batches():
    pass
before = held()
for b in bpe._code_blocks(pa.struct([("doc_id", pa.int64())]), 16, 400_000)(batches()):
    pass
del b
print(held() - before)
"""


def test_worker_gives_memory_back_after_its_task():
    # an idle worker stays beside the JVM while other stages run
    out = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True, timeout=120)
    assert float(out.stdout) < 15
