"""The corpus pipeline: from raw documents to token ids, in stages that are each written as Parquet and read again.

Every stage gets what its predecessor kept and returns the columns of the documents; the last one returns ids. A row
without an id or text goes through like any other: a null text counts as empty (its quality is scored, it is a copy
of other empty texts, it has no benchmark text and no personal data, and it encodes to the end id alone). Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.llm import decontamination, neardup, pieces, pii, quality
from forumlens.llm.common import prepared, table
from forumlens.session import new_table_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the documents that come in and their labels."""
    prepared(spark)
    return quality.good_rows(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: the one with the smallest id."""
    prepared(spark)
    return neardup.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepared(spark)
    return decontamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets; a column of characters is counted anew."""
    prepared(spark)
    done = pii.mask(docs, pii.fit(docs))
    if "n_chars" in done.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, and the text they decode to."""
    prepared(spark)
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    return pieces.encode(docs, keep=kept).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality classifier", good), ("near-dedup", one_of_each), ("benchmark decontamination", uncontaminated),
          ("PII", masked), ("SentencePiece encoding and decoding", tokens)]

ORACLE_SQL = None  # fingerprints, learned models and merges have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = new_table_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
