"""Every operator of this package as a named query over the given tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    ann, decontaminate, hard_negatives, language_id, lexical_search, lm_score, mixing, near_dedup, secrets, suffix_dedup, token_output, toxicity,
    warc,
)
from plumbline.llm.store import written

TOKENIZER = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows outside fold 0."""
    docs = table(spark, folder, "documents")
    rows = written(toxicity.training_rows(docs, table(spark, folder, "labels")), "toxicity-rows")
    scored = toxicity.score(docs, toxicity.fit(rows))
    return scored.select(
        "doc_id", (language_id.fold_of() == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """What of every document occurs in windows of the benchmark."""
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("digest")


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of three words in a row have a similarity of 0.85 or more."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"), near_dedup.Rule(3, 85))


def op4_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return ann.neighbours(table(spark, folder, "embeddings"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document a mix to source weights takes."""
    found = mixing.taken(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken")
    )


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses of strings of 400 bytes that occur again."""
    return suffix_dedup.removals(table(spark, folder, "documents"))


def op7_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document, learned from the rows outside fold 1."""
    return lm_score.scores(table(spark, folder, "documents"))


def op8_token_output(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, written to files in order of the ids and read back."""
    docs = table(spark, folder, "documents")
    return token_output.read(token_output.write(docs, public_tokenizers.path(TOKENIZER)))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: fixed patterns and hard values in credential contexts."""
    return secrets.scan(table(spark, folder, "documents"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the rows outside fold 0."""
    found = language_id.learn_and_identify(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_ambiguous").alias("ambiguous"),
    )


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that score highest for the terms of every benchmark item."""
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of another label that score next below the positives of every fiftieth vector."""
    return hard_negatives.mine(table(spark, folder, "embeddings"))


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to legacy archives, converted to WARC files and read back."""
    found = warc.read(warc.convert(warc.write_arc(table(spark, folder, "pages"))))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_near_dedup": op3_near_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_mixing": op5_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_token_output": op8_token_output,
    "op9_secrets": op9_secrets,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_warc": op13_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontaminate.SQL,
    "op5_mixing": mixing.SQL,
    "op11_lexical_search": lexical_search.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_warc": warc.SQL,
}
