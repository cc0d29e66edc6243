"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Stages judge rows, not ids: rows that share a doc_id, or have none, go or stay each by its text. Of
near copies, and so of repeated rows, one row stays. All but the last stage return the columns of
documents; the last one the pieces of the packed sequences with their ids. Empty tables pass through
all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import common
from quotemill.llm.decontaminate import decontaminated
from quotemill.llm.near_copies import without_near_copies
from quotemill.llm.packing import pack
from quotemill.llm.suffix_dedup import remove_repeats
from quotemill.llm.tokenizing import vocabulary_path
from quotemill.llm.toxicity import score, train
from quotemill.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go."""
    ship(spark)
    weights, model = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, weights, model, ("text", "lang", "source", "n_chars")).where("score < 0.5").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that SimHash links (op10's fingerprints), or whose five-word shingles reach a Jaccard similarity of 0.8, and what
    these connect, the document with the least id stays."""
    ship(spark)
    return without_near_copies(docs, ("lang", "source", "n_chars")).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the strings of 100 bytes that occur earlier, in whole characters; no document goes."""
    ship(spark)
    kept = remove_repeats(docs, with_text=True, others=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    ship(spark)
    return decontaminated(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    ship(spark)
    return pack(docs, vocabulary_path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_neardup", near_duplicate),
    ("suffix_dedup", repeated_strings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages learn models and build fingerprints that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = common.documents(spark, sf_dir), None
    for name, stage in STAGES:
        keep: list[str] = []
        with common.scratch(keep):  # what a stage has written for itself goes when its result is there
            docs, at = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(at)
        if written:
            common.release(spark, written)
        written = at
    return docs
