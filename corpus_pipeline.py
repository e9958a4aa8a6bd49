"""The corpus pipeline: five stages applied in order to the table of documents.

1. quality: documents that the positive-unlabelled classifier scores below 0.7 go.
2. line dedup: later copies of runs of three or more lines are cut out of the texts.
3. near duplicates: of each group of SimHash fingerprints linked at three or fewer
   bits the document with the smallest doc_id stays.
4. decontamination: documents that hold a benchmark item go.
5. encoding: piece ids of what is left, and what they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritpool.llm import decontamination, line_dedup, pieces, quality, simhash
from meritpool.llm.frames import landed, ship, table
from meritpool.llm.queries import PIECES


def quality_filter(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps what the classifier, fitted on these documents and the labels, does not reject."""
    ship(spark)
    return quality.keep(docs, quality.fit(docs, table(spark, folder, "labels")))


def line_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Cuts repeated runs of lines; n_chars follows the text. No document goes."""
    out = line_dedup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest doc_id."""
    ship(spark)
    return simhash.keep_first(docs, shingle=3, max_bits=3)


def benchmark_free(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the documents without a benchmark item."""
    ship(spark)
    return decontamination.keep_clean(docs, table(spark, folder, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, ids, n_ids, n_byte_ids, round_trip and a digest of the decoded text of each document."""
    ship(spark)
    return pieces.encode(spark, docs, pieces.read_model(PIECES), decoded=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("line_dedup", line_repeats),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("sentencepiece", encoded),
]

#: Classifier, latent space and pieces can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of ``folder``, each written down and read again."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
