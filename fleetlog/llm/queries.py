"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlog.llm import bpe, conversation_trie, html_text, language_id, line_dedup, ngram_join, packing, periodic_runs, quality_rules, sharding, substring_dedup, topk, toxicity
from fleetlog.llm.textkit import Words, bounded_sample, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: Clusters of the labelled toxic texts, predicted before toxicity itself.
KINDS = 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    ids = language_id.identify(docs, model)
    held = F.coalesce(language_id.held_out(), F.lit(False))
    return ids.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("key", "class")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, "vec_id % 100 = 0", 10)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "text")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substring_dedup.without_repeats(docs, joined=True)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(packing.packed(table(spark, sf_dir, "documents"), VOCABULARY))


def packing_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def labelled_texts(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``toxicity.SAMPLE_ROWS`` labelled documents."""
    labels = bounded_sample(table(spark, sf_dir, "labels").select("doc_id", "toxic").dropna(), toxicity.SAMPLE_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")


def toxicity_chain(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Chain:
    return toxicity.fit(labelled_texts(spark, sf_dir, docs), ["toxic"], kinds=KINDS)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity_chain(spark, sf_dir, docs)
    found = toxicity.score(docs, chain)
    return found.withColumn("toxic", F.col("p_toxic") >= chain.thresholds[-1])


def periodic_tails(part: pa.RecordBatch, found: Words) -> Words:
    """A tenth of the documents, drawn by the CRC-32 of their id, go on periodically from
    some word of theirs to the end."""
    codes = found.codes.copy()
    for i, doc in enumerate(part.column("doc_id").to_pylist()):
        drawn = zlib.crc32(str(doc).encode())
        first, end = found.offsets[i], found.offsets[i + 1]
        n = int(end - first)
        if doc is None or drawn % 10 or not n:
            continue
        drawn //= 10
        a = drawn % n
        period = 1 + (n - a) // (3 + drawn % 8)
        codes[first + a : end] = found.codes[first + a + np.arange(n - a) % period]
    return found._replace(codes=codes)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(docs, edit=periodic_tails).withColumn(
        "best", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        "n_runs",
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.shorter")).alias("period"),
        F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """Each conversation c opens with the first h turns of conversation c - c % 20 instead of
    its own first h; h = crc32(c) % 4."""
    own = conversation_trie.sequences(turns)
    heads = conversation_trie.sequences(turns.filter("conv_id % 20 = 0")).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    joined = own.join(heads, F.col("conv_id") - F.col("conv_id") % 20 == F.col("head_id"), "left").withColumn("h", h)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(rebuilt_conversations(table(spark, sf_dir, "conversations")))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size, check = (F.octet_length(text) + 8).cast("long"), F.crc32(text.cast("binary"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", size.alias("size"), check.alias("text_crc32"))
    dealt = sharding.interleaved(rows, 24, ties=["size", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("int").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_ngram_join, op3_top_k, op4_html_text, op5_line_dedup, op6_bpe, op7_substring_dedup, op8_packing, op9_quality_rules, op10_toxicity, op11_periodic_runs, op12_conversation_trie, op13_sharding)}
