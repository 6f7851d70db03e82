"""Extra columns with the names that operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loadsig.llm import bpe, langid, minhash, mixing, sanitise, sentences
from loadsig.llm.queries import VOCABULARY

NAMES = ("_id _n _copy covered _source _bounds _cut ids decoded language _language0 _pii_spans _pii_terms _pii_copy row block "
         "codes words bucket kept component_id n_shingles copies taken size _rank _salt").split()
TEXT = "One two three four five six seven. Write to ann@example.org or +49 30 1234567 now. The rest is plain text."
ROWS = [(1, TEXT, "en", "a"), (2, TEXT, "en", "a"), (3, "Quite another text of some words here.", "fr", "b"), (None, None, None, None)]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return docs.withColumns({n: F.lit(f"own {n}") for n in NAMES}).cache()


@pytest.mark.parametrize("name,run,replaced", [
    ("mix", mixing.mix, set()),
    ("sentences", sentences.dedup, set()),
    ("near", minhash.drop_near_duplicates, set()),
    ("sanitise", sanitise.sanitise, set()),
    ("identify", lambda d: langid.identify(d, None), {"language"}),
    ("bpe", lambda d: bpe.encode(d, VOCABULARY, with_text=True), {"ids", "decoded"}),
])
def test_own_columns_come_back(clashing, name, run, replaced):
    rows = run(clashing).collect()
    assert rows
    for r in rows:
        assert all(r[n] == f"own {n}" for n in NAMES if n not in replaced)
    plain = run(clashing.drop(*NAMES)).collect()
    keys = [c for c in plain[0].asDict() if c not in ("language",)]
    assert sorted(str([r[c] for c in keys]) for r in rows) == sorted(str([r[c] for c in keys]) for r in plain)


def test_stages_take_clashing_columns(spark, clashing):
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, "")
        assert docs.count() > 0, name


def test_many_matches_in_one_text(spark):
    """Spans of very many matches are right and take no quadratic time."""
    n = 20_000
    text = " ".join(f"u{i}@m{i % 9}.org 10.0.{i % 256}.{i % 300}" for i in range(n))
    row = spark.createDataFrame([(text,)], "text string").select(
        sanitise.base_spans(F.col("text")).alias("s"), "text").select(
        "s", sanitise.sanitised(F.col("text"), F.col("s")).alias("t")).first()
    at, want = 0, []
    for part in text.split(" "):
        if "@" in part:
            want.append(("email", at, at + len(part)))
        elif int(part.rsplit(".", 1)[1]) <= 255:
            want.append(("ip", at, at + len(part)))
        at += len(part) + 1
    assert [(s["kind"], s["start"], s["end"]) for s in row["s"]] == sorted(want, key=lambda s: (s[0] != "email", s[1]))
    assert row["t"] == " ".join("[EMAIL]" if "@" in p else "[IP]" if int(p.rsplit(".", 1)[1]) <= 255 else p for p in text.split(" "))
