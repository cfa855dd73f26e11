"""From raw documents to token ids: quality rules, near-dedup, secret scans, mixing, BPE encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import bpe, mixing, quality, secrets, simhash
from fleetpulse.llm.common import table, written

#: Share of the words that reach the mixing stage which its target mix holds.
MIX_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ratios = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.verdict(F.col("text"), ratios)["kept"])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least doc_id, of each group of near copies."""
    return simhash.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark; ``n_chars`` follows where it was the length."""
    clean = secrets.redacted(F.col("text"))
    if "n_chars" not in docs.columns:
        return docs.withColumn("text", clean)
    counted = F.when(F.col("n_chars") == F.length("text"), F.length("_clean")).otherwise(F.col("n_chars"))
    changed = docs.withColumn("_clean", clean)
    return changed.withColumns({"n_chars": counted.cast(docs.schema["n_chars"].dataType), "text": F.col("_clean")}).select(*docs.columns)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a mix of target weights takes, each at most once."""
    return mixing.mix_documents(docs, MIX_PERCENT)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests."""
    done = docs.select("doc_id", "lang", "source", bpe.encoded(F.col("text"), bpe.vocabulary_path()).alias("e"))
    return done.select("doc_id", "lang", "source", "e.*")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_to_weights),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL cannot run these stages; a test holds them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
