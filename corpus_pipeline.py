"""From raw documents to token digests: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Stages decide on their own input only.
Defined cases are those of the operators: an empty table passes through as an
empty table; null and empty texts are texts without words; of rows that repeat
an id with one text one stays; rows with a null id give way to any other row of
their group; other columns of documents are carried up to the last stage,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import bpe, exact_dedup, mixing, quality, simhash
from siltworks.llm.common import delete_path, shared_folder, table
from siltworks.llm.queries import MIX_WEIGHTS


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labels, does not reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.deduplicate(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return simhash.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, by the target weights of the sources; once each."""
    return mixing.mix(docs, share=0.5, weights=MIX_WEIGHTS, epochs=1)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("SimHash near-dedup", unlike),
    ("mixing sources", mixed),
    ("BPE encoding", encoded),
]

#: Learned filters, fingerprints and BPE have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's folder goes when the next one is written; the last stays, as the result reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete_path(spark, f"{folder}/{i - 1}")
    return docs
