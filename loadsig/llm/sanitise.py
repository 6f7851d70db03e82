"""Information-theoretic sanitisation of personal data.

Base spans are found by pattern: e-mail addresses, IP addresses, payment cards
and phone numbers, leftmost and non-overlapping per kind; a match that fails its
check is dropped. They are the protected entities.

The corpus then tells which other terms give an entity away. Terms are runs of
letters and digits outside the base spans that start with a letter, lower-cased,
at least three characters long. An entity and a term occur together if they are
in one text, at any distance. All figures count distinct texts, so copies change nothing.
With N texts, n(e) with entity e, df(t) with term t and n(e,t) with both, rates
are shrunk by ``PRIOR`` occurrences (Jeffreys), so no entity or term is too rare
to be judged:

    p(t) = (df(t) + PRIOR) / (N + PRIOR)
    p(t|e) = (n(e,t) + PRIOR q(t|e)) / (n(e) + PRIOR)

q pools the entities of a group: mail domain, /24 network, card issuer, phone
exchange. It is the group's own p(t|g), shrunk towards p(t); for a term that is
a part of the written entity it is 1. Groups are judged as entities are. The term
reveals the share

    ln(p(t|e) / p(t)) / ln(N / n(e))

of the information in e: close to 1 if it occurs with e only, 0 if independent;
an entity that is in every text holds none. Terms that reveal ``GENERALISE`` of it
are replaced by their kind, from ``REMOVE`` on removed, wherever they occur in a
text with the entity. So words found nowhere else go too, names or not.

Offsets are code points, end exclusive. Null and empty texts have no spans; a
null text stays null. Repeated rows are rows of their own; ids are not used.
Extra columns are kept; columns whose names start with ``_pii`` are reserved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadsig.llm.shared import with_own_names
from loadsig.session import materialise

# Kinds in their order, and the patterns of the contract. Possessive
# quantifiers and look-behinds keep the matches and make the search linear.
KINDS = ("email", "ip", "card", "phone")
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

TERM = r"[\p{L}\p{N}]+"
PRIOR = 0.5
GENERALISE, REMOVE = 0.8, 0.95
_SPAN = "struct<kind:string,start:int,end:int,value:string>"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once."""
    return F.transform(F.array(value), fn)[0]


def pieces_of(values: Column) -> Column:
    """A non-empty array cut into about sqrt(n) arrays of about sqrt(n) entries."""
    size = F.ceil(F.sqrt(F.size(values))).cast("int")
    return let(size, lambda c: F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(values) / c).cast("int") - 1), lambda i: F.slice(values, i * c + 1, c)))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination (sum, maximum) of an array of ints, from 0.

    Arrays grow by copying, so the totals of about sqrt(n) pieces are run through
    first and each piece then goes on from its own start: n^1.5 steps, not n^2.
    """
    none, zero = F.array().cast("array<int>"), F.lit(0)

    def inside(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), lambda acc, x: let(
            combine(acc["at"], x).cast("int"), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out"))))["out"]

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, zero, lambda acc, x: combine(acc, x).cast("int")))
        starts = F.aggregate(totals, F.struct(zero.alias("at"), none.alias("out")), lambda acc, t: F.struct(
            combine(acc["at"], t).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(parts, starts, inside))

    return let(values, lambda v: F.when(F.size(v) > 0, let(pieces_of(v), whole)).otherwise(none))


def located(text: Column, pattern: str, kind: str) -> Column:
    """All matches with their offsets: the text is split by the pattern, and
    the lengths of pieces and matches add up to the offsets."""
    def spans(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        ends = running(F.zip_with(hits, gaps, lambda h, g: F.char_length(h) + F.char_length(g)), lambda x, y: x + y)
        return F.zip_with(hits, ends, lambda h, e: F.struct(
            F.lit(kind).alias("kind"), (e - F.char_length(h)).alias("start"), e.alias("end"), h.alias("value")))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    return F.coalesce(found, F.array()).cast(f"array<{_SPAN}>")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid_ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.char_length(bare) <= 3) & (F.concat(F.lit("0"), F.substring(bare, 1, 3)).cast("int") <= 255)

    return F.forall(F.split(value, r"\."), small)


def base_spans(text: Column) -> Column:
    """Array of all base spans, by kind as listed, then by start."""
    card = lambda s: F.char_length(_digits(s["value"])).between(13, 19) & luhn(_digits(s["value"]))
    phone = lambda s: F.char_length(_digits(s["value"])).between(9, 15)
    none = F.array().cast(f"array<{_SPAN}>")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), located(text, EMAIL, "email")).otherwise(none),
        F.when(text.rlike(IP), F.filter(located(text, IP, "ip"), lambda s: _valid_ip(s["value"]))).otherwise(none),
        F.when(text.rlike(CARD), F.filter(located(text, CARD, "card"), card)).otherwise(none),
        F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE, "phone"), phone)).otherwise(none),
    )


def entity(span: Column) -> Column:
    """Identity of a protected value, whatever its spelling."""
    bare = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), bare)


def group(span: Column) -> Column:
    """The group in which an entity is pooled with its like."""
    digits = _digits(span["value"])
    of = (F.when(span["kind"] == "email", F.substring_index(F.lower(span["value"]), "@", -1))
          .when(span["kind"] == "ip", F.substring_index(span["value"], ".", 3))
          .when(span["kind"] == "card", F.substring(digits, 1, 6))
          .otherwise(F.left(digits, F.char_length(digits) - 4)))
    return F.concat(F.lit("all "), span["kind"], F.lit(":"), of)


def _is_term(word: Column) -> Column:
    return word.rlike(r"^\p{L}") & (F.char_length(word) >= 3)


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    words = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, _is_term))


def distinct_texts(found: DataFrame) -> DataFrame:
    """``(_pii_copy, _pii_spans, text, terms, inside)``: each text with entities
    once, with blanks in place of the base spans; ``inside`` has the terms that
    it has in base spans only."""
    once = found.select("_pii_copy", "text", "_pii_spans").dropDuplicates(["_pii_copy"])
    blank = once.withColumn("_all", terms_of(F.col("text"))).withColumn("text", blanked(F.col("text"), F.col("_pii_spans")))
    return blank.withColumn("terms", terms_of(F.col("text"))).withColumn("inside", F.array_except("_all", "terms")).drop("_all")


def protected(once: DataFrame) -> DataFrame:
    """``(_pii_copy, key, parent, n, parts)``: the entities and groups of each
    text, the number ``n`` of texts that have them, and the terms in their
    writing. Entities of one group that are in this text only share all counts
    and are one row."""
    s = F.col("s")
    one = materialise(
        once.select("_pii_copy", F.explode("_pii_spans").alias("s"))
        .select("_pii_copy", entity(s).alias("key"), group(s).alias("parent")).distinct(), "entities")
    pools = one.select("_pii_copy", F.col("parent").alias("key"), F.lit(None).cast("string").alias("parent")).distinct()
    keys = one.unionByName(pools)
    n = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    parts = terms_of(F.substring_index("key", ":", -1))
    alone = F.when((F.col("n") == 1) & F.col("parent").isNotNull(), F.concat_ws(" ", F.lit("one"), "_pii_copy", "parent"))
    return keys.join(n, "key").withColumn("parts", parts).withColumn("key", F.coalesce(alone, "key")).groupBy(
        "_pii_copy", "key", "parent", "n").agg(F.array_distinct(F.flatten(F.collect_list("parts"))).alias("parts"))


def text_counts(docs: DataFrame, once: DataFrame) -> tuple[int, DataFrame]:
    """The number of distinct texts, and ``(term, df)``: the distinct texts that
    have the term outside base spans. Each of c equal texts counts 1/c."""
    texts = docs.filter("text <> ''").select("text", F.xxhash64("text").alias("copy"))
    copies = materialise(texts.groupBy("copy").agg(F.count(F.lit(1)).alias("c")), "copies")
    several = materialise(copies.filter("c > 1"), "several")
    parts = texts.join(several, "copy", "left").select(
        F.explode(terms_of(F.col("text"))).alias("term"), (1.0 / F.coalesce("c", F.lit(1))).alias("part"))
    inside = once.select(F.explode("inside").alias("term"), F.lit(-1.0).alias("part"))
    df = parts.unionByName(inside).groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("df"))
    return copies.count(), df.filter("df > 0")


def disclosing_terms(n_texts: int, df: DataFrame, once: DataFrame, keys: DataFrame) -> DataFrame:
    """``(_pii_copy, term, share)`` of the terms that exceed the lower threshold,
    for each text with an entity or group that they reveal."""
    most = keys.agg(F.max("n")).first()[0] or 0

    def may_reach(n: Column) -> Column:
        # as p(t|e) <= 1, other terms are too frequent to reveal GENERALISE
        return F.col("df") + PRIOR <= (n_texts + PRIOR) * F.pow(F.least(n / max(n_texts, 1), F.lit(1.0)), F.lit(GENERALISE)) * (1 + 1e-9)

    words = once.select("_pii_copy", F.explode("terms").alias("term")).join(df.filter(may_reach(F.lit(most))), "term")
    pairs = materialise(
        words.join(keys, "_pii_copy").filter(may_reach(F.col("n")))
        .withColumn("own", F.array_contains("parts", F.col("term"))).drop("parts"), "pairs")
    counts = materialise(
        pairs.groupBy("key", "parent", "term").agg(
            F.max("n").alias("n"), F.max("df").alias("df"), F.count(F.lit(1)).alias("n_et"), F.max("own").alias("own")),
        "counts")
    pool = counts.filter("parent IS NULL").select(
        F.col("key").alias("parent"), "term", F.col("n").alias("n_g"), F.col("n_et").alias("n_gt"))
    overall = (F.col("df") + PRIOR) / (n_texts + PRIOR)
    pooled = (F.col("n_gt") + PRIOR * overall) / (F.col("n_g") + PRIOR)
    prior = F.when(F.col("own"), 1.0).otherwise(F.coalesce(pooled, overall))
    rate = (F.col("n_et") + PRIOR * prior) / (F.col("n") + PRIOR)
    share = F.when(F.col("n") < n_texts, F.log(rate / overall) / F.log(n_texts / F.col("n"))).otherwise(0.0)
    told = counts.join(pool, ["parent", "term"], "left").select("key", "term", share.alias("share")).filter(
        F.col("share") >= GENERALISE)
    return pairs.join(told, ["key", "term"]).groupBy("_pii_copy", "term").agg(F.max("share").alias("share"))


def term_spans(once: DataFrame, listed: DataFrame) -> DataFrame:
    """``(_pii_copy, spans)``: where the listed terms occur in their texts. Only
    the texts that have such terms are cut into words."""
    rows = once.join(listed.select("_pii_copy").distinct(), "_pii_copy").select("_pii_copy", "text")
    gaps = F.split(F.col("text"), TERM, -1)
    hits = F.regexp_extract_all(F.col("text"), F.lit(TERM), F.lit(0))
    cut = rows.select("_pii_copy", F.posexplode(F.arrays_zip(gaps.alias("g"), hits.alias("h"))).alias("n", "p"))
    run = Window.partitionBy("_pii_copy").orderBy("n")
    end = F.sum(F.char_length("p.g") + F.coalesce(F.char_length("p.h"), F.lit(0))).over(run).cast("int")
    placed = cut.select("_pii_copy", F.col("p.h").alias("word"), end.alias("end")).filter("word IS NOT NULL")
    hit = placed.withColumn("term", F.lower("word")).join(listed, ["_pii_copy", "term"])
    kind = F.when(F.col("share") >= REMOVE, F.lit("term")).otherwise(F.lit("general"))
    span = F.struct(kind.alias("kind"), (F.col("end") - F.char_length("word")).alias("start"), "end",
                    F.col("word").alias("value"))
    return hit.groupBy("_pii_copy").agg(F.array_sort(F.collect_list(span)).alias("_pii_terms"))


def _replaced(text: Column, spans: Column, mark: Callable[[Column, Column], Column]) -> Column:
    """The text with a mark in place of each span; an overlapped span counts from
    the end of what is before it. The text is cut once per piece of the spans, so
    that no span is looked for from the beginning of a long text."""
    def with_ends(sorted_: Column) -> Column:
        ends = running(F.transform(sorted_, lambda s: s["end"]), F.greatest)
        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        items = F.zip_with(sorted_, before, lambda s, at: F.struct(s.alias("s"), at.alias("at")))
        tail = F.substring(text, F.element_at(ends, -1) + 1, F.char_length(text))
        return F.concat(let(items, lambda i: F.array_join(F.flatten(F.transform(pieces_of(i), piece)), "")), tail)

    def piece(items: Column) -> Column:
        base = items[0]["at"]
        last = F.array_max(F.transform(items, lambda i: i["s"]["start"]))
        return let(F.substring(text, base + 1, F.greatest(last - base, F.lit(0))), lambda here: F.transform(
            items, lambda i: F.when(i["s"]["end"] > i["at"], F.concat(
                F.substring(here, i["at"] - base + 1, F.greatest(i["s"]["start"] - i["at"], F.lit(0))), mark(i["at"], i["s"]))
            ).otherwise(F.lit(""))))

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    return F.when(F.size(spans) > 0, let(by_start, with_ends)).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans, so that offsets stay."""
    return _replaced(text, spans, lambda at, s: F.repeat(F.lit(" "), s["end"] - F.greatest(at, s["start"])))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans and generalised terms replaced by their kind in
    brackets and removed terms left out."""
    return _replaced(text, spans, lambda at, s: (
        F.when(s["kind"] == "term", F.lit(""))
        .when(s["kind"] == "general", F.when(s["value"].rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]")))
        .otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_pii_spans`` (base) and ``_pii_terms`` (spans of terms)."""
    spans = base_spans(F.coalesce(docs["text"], F.lit("")))
    marked = docs.withColumn("_pii_spans", spans)
    found = materialise(
        marked.filter(F.size("_pii_spans") > 0).withColumn("_pii_copy", F.xxhash64("text")), "pii")
    once = materialise(distinct_texts(found), "texts")
    n_texts, df = text_counts(docs, once)
    listed = materialise(disclosing_terms(n_texts, df, once, materialise(protected(once), "protected")), "terms")
    none = F.array().cast(f"array<{_SPAN}>")
    with_terms = found.join(term_spans(once, listed), "_pii_copy", "left").withColumn(
        "_pii_terms", F.coalesce("_pii_terms", none))
    plain = marked.filter(F.size("_pii_spans") == 0).withColumn("_pii_terms", none)
    return with_terms.drop("_pii_copy").unionByName(plain)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced."""
    def replaced(d: DataFrame) -> DataFrame:
        text = sanitised(F.col("text"), F.concat("_pii_spans", "_pii_terms"))
        return find_personal_data(d).withColumn("text", text).select(d.columns)

    return with_own_names(docs, ["doc_id", "text"], replaced)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
