"""The filter audit against a plain version, and its tries."""

import random
from itertools import permutations

import pytest

from loadsig.llm import audit

DOCS = "doc_id long, text string, lang string, source string, part string, mask string, prefix string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "x", "y", "z") for i, t, s in rows], DOCS)


def random_rows(seed, n):
    rng = random.Random(seed)
    texts = ["a", "", None, "A b c", "a#", "ä" * 30, "x y " * 210, "long " * 5000, "shared beginning " * 9 + "1",
             "shared beginning " * 9 + "2"] + [" ".join(str(rng.randrange(999)) for _ in range(230)) for _ in range(8)]
    return [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s", "", None])) for _ in range(n)]


def plain(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    docs = []
    for i, t, s in rows:
        t = t or ""
        words = t.encode().split()
        fails = {f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t),
            i is not None and i > first[t])) if bad}
        docs.append((s or "", fails, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                here = [d for d in mine if f in d[1] and not d[1] & before]
                out[part, "".join(order), step] = [
                    sum(not d[1] & (before | {f}) for d in mine), len(here),
                    sum(f in d[1] and bool(d[1] & before) for d in mine), sum(d[1] == {f} for d in mine),
                    sum(d[2] for d in here), sum(d[3] for d in here)]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(frame):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_orders_equal_plain_counts(spark, seed, monkeypatch):
    monkeypatch.setattr(audit, "TRIE_BYTES", 3000)  # many tries and long prefixes
    rows = random_rows(seed, 120)
    labels = [(i, i % 3 == 0 and 1 or 0, 1 if i % 5 == 0 else None) for i in range(30)] + [(3, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert result(audit.audit(docs_of(spark, rows).repartition(5), frame)) == plain(rows, labels)


def test_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs_of(spark, []), labels).collect() == []


def test_trie_holds_every_text_once():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(9))).encode() for _ in range(400)]
    trie, want = audit.Trie(), {}
    for i, t in enumerate(texts):
        trie.insert(t, i)
        want.setdefault(t, []).append(i)
    assert sorted(trie.terminals()) == sorted(want.values())


def test_prefixes_grow_until_few_texts_share_them(spark):
    texts = ["same start of many texts " * 4 + str(i) for i in range(50)] + ["other"] * 60
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = audit.adaptive_prefixes(frame, most=250).collect()
    assert len(got) == len(texts) and all(r["text"].startswith(r["prefix"]) for r in got)
    shared = {}
    for r in got:
        shared.setdefault(r["prefix"], set()).add(r["text"])
    assert all(len(t) == 1 or sum(map(len, t)) <= 250 for t in shared.values())
