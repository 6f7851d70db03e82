"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadsig.llm import audit, bpe, crosstok, dialogues, langid, minhash, mixing, pivots, probes, quality, sanitise, sentences, topk
from loadsig.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_minhash_near_dedup(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"), shingle=4, percent=80)


@query
def op10_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    fold = langid.fold(F.col("doc_id"))
    found = langid.identify(docs, langid.train(docs, fold != 2))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"),
                        "language.lang_pred", "language.score", "language.accepted")


@query
def op5_fair_queue_mix(spark, sf):
    return mixing.mix_plan(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op6_disclosure_pii(spark, sf):
    found = sanitise.find_personal_data(table(spark, sf, "documents").select("doc_id", "text"))
    base, everything = F.col("_pii_spans"), F.concat("_pii_spans", "_pii_terms")
    counts = [sanitise.count_of(base, k).alias(f"n_{k}") for k in sanitise.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(sanitise.joined_spans(base), 256).alias("base_sha256"),
        sanitise.joined_spans(everything).alias("spans"),
        F.sha2(sanitise.sanitised(F.col("text"), everything), 256).alias("text_sha256"))


@query
def op4_bpe_round_trip(spark, sf):
    ids = bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), VOCABULARY, with_text=True)
    # the list as JSON without its brackets: one string, not a string for each id
    listed = F.to_json("ids")
    hashed = F.sha2(F.substring(listed, F.lit(2), F.length(listed) - 2), 256)
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), hashed.alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op1_bayes_quality(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"))
    return quality.classify(docs, model, F.col("source"), F.col("lang"))


@query
def op2_pivot_near_dedup(spark, sf):
    return pivots.near_duplicates(table(spark, sf, "embeddings"))


@query
def op3_threshold_top_k(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op7_sentence_spans(spark, sf):
    cut = sentences.dedup(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("_n_sentences").alias("n_sentences"), F.col("_n_removed").alias("n_removed"),
                      "text")


@query
def op8_perspective_chat(spark, sf):
    shown = dialogues.rotate(table(spark, sf, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return shown.select("conv_id", "perspective", "part", "n_turns", F.sha2("text", 256).alias("text_sha256"),
                        mask.alias("mask"))


@query
def op12_filter_audit(spark, sf):
    return audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op13_multiprobe_neighbours(spark, sf):
    return probes.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_lockstep_alignment(spark, sf):
    found = crosstok.align(table(spark, sf, "documents").select("doc_id", "text"), VOCABULARY, PIECE_MODEL)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups")
