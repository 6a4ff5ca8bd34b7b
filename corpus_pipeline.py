"""A training corpus made from `documents`, stage by stage.

Every stage takes (spark, docs, folder of tables) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, language_id, mixing, near_dedup, token_output
from plumbline.llm.queries import TOKENIZER, table
from plumbline.llm.store import written


def keep_known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is told clearly; those without letters or ambiguous go."""
    model = language_id.fit(docs.where(language_id.fold_of() != 0))
    return language_id.clearly_told(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group whose sets of five words in a row are similar by 0.8 or more."""
    return near_dedup.deduplicated(docs, near_dedup.Rule(5, 80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a share of benchmark windows that counts as contamination."""
    return decontaminate.clean(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids in files; what is read back from them, one row per document."""
    return token_output.read(token_output.write(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("language id", keep_known_language),
    ("near duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token ids", write_token_ids),
]

# Learned models and probabilistic candidate search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The result of all stages over `documents`."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
