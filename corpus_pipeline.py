"""Corpus pipeline: documents to packed training sequences.

Each stage gets the documents that its predecessor kept and returns documents
with the same columns; the last one returns the pieces of packed sequences.
Texts that a stage changes get their ``n_chars`` anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlog.llm import line_dedup, ngram_join, packing, queries, substring_dedup, toxicity
from fleetlog.llm.textkit import prepare, stored, table


def _resized(changed: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" not in columns:
        return changed.select(*columns)
    size = F.coalesce(F.length("text").cast(changed.schema["n_chars"].dataType), "n_chars")
    return changed.select(*(size.alias(c) if c == "n_chars" else F.col(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents predicted toxic go."""
    chain = queries.toxicity_chain(spark, sf_dir, docs)
    scored = toxicity.score(docs, chain, docs.columns, "_p_")
    return scored.filter(F.col("_p_toxic") < chain.thresholds[-1]).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines on many sites go from all documents but one."""
    return _resized(line_dedup.without_boilerplate(docs), docs.columns)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near copies stays."""
    return ngram_join.one_of_each(docs).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the words of passages that stand elsewhere too go."""
    return _resized(substring_dedup.without_repeats(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of sequences."""
    return queries.packing_digest(packing.packed(docs, queries.VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_join", keep_one_near_copy),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Linear models and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and
    read again by the next."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
