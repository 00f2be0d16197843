"""The corpus pipeline: five stages, each an operator of ``barweave.llm``, over the documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as a Parquet table
in the shared folder and gives it to the next one. The result has the texts of the training sequences: masked, a row for
each piece.

Defined cases: null and empty texts go in the first stage (fewer than 50 words), and rows with a null id whose text has
another id in the second; repeated rows count as one document from the second stage on; very long texts are read whole
and cut into pieces by the last stage alone; columns of any name stay up to the last stage, but ``n_chars`` becomes the
number of code points of the masked text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barweave.llm import decontaminate, packing, quality_rules, secret_scan, simhash
from barweave.llm.common import Scratch, delete, new_folder, table, written_to


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (shingles of five words; two bits or a Jaccard similarity of 0.8) the smallest id stays."""
    return simhash.keep_first(docs, width=5, similarity=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, with the length of its masked text in ``n_chars``."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of training sequences: a row for each piece of a document, with its text."""
    return packing.pack_texts(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage wrote is deleted once the next one has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with Scratch(spark) as used:
            found = stage(spark, docs, sf_dir)
        path = new_folder(spark, f"pipeline-{name}")
        docs = written_to(found, path)
        used.drop()
        if before:
            delete(spark, before)
        before = path
    return docs


#: SimHash and the packing have no SQL.
ORACLE_SQL = None
