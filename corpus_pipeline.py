"""The corpus pipeline: rules, near-duplicates, secrets, mixing and packing, one table after another.

Odd rows go through as their operators define it. A null text counts as empty,
so the rules reject it (under 50 words). A null id keeps its row: it teaches
nothing, is no near-duplicate, and shares its copies' draw with other null ids.
Rows that repeat an id with the same text are near-duplicates of one id, so
all of them stay (their id is their group's smallest); with another text, rows
of an id that isn't its group's smallest go together. Whole texts are read,
however long. An empty table gives an empty result. Columns besides doc_id and
text may have any names and pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm import jaccard, mixing, packing, quality_rules, secret_scan
from skyweave.llm.common import table, written


#: Shares of expected tokens after mixing. The rules took the junk, so it is no domain here: a share of it could only
#: be met by long documents of doubtful membership, at the cost of clean ones.
WEIGHTS = {"clean": 0.96, "toxic": 0.04}


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return jaccard.one_of_each_group(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all documents stay."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as its fitted rate says."""
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels"), WEIGHTS, epochs=1.1)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_to_weights),
    ("best_fit_packing", pack_sequences),
]
#: The learned rules, the inferred grammars and the fitted rates can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
