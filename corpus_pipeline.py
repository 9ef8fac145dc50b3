"""A training-data pipeline over the documents table.

Stages, each written as Parquet and read again as the next one's documents:

1. language_id: documents without a language of their own (or without an id) go.
2. near_dedup: one document of each group of near copies stays, that with the smallest id.
3. secret_scan: reported secrets are replaced by a mark in the text; no document goes.
4. mix_sources: documents are chosen to the target weights, each once at most
   (max_epochs = 1), within BUDGET_SHARE of all tokens.
5. bpe_encode: each document's token ids, and the digest of the text they decode to.

All but the last return the columns of documents. Rows with a null or repeated id:
a null id is rejected by stage 1; rows that share an id are kept or dropped together.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import bpe, language_id, minhash_dedup, mixing, secrets
from riskframe.llm.common import materialize, table

BUDGET_SHARE = 0.7


def _keep(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    chosen = decisions.select(F.col("doc_id").alias("_chosen")).distinct()
    return docs.join(chosen, F.col("doc_id") == F.col("_chosen"), "left_semi")


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, language_id.identify_documents(docs).filter("kept"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, minhash_dedup.near_duplicates(docs).filter("kept"))


def stage_secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def stage_mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = mixing.documents_of(docs, mixing.PRODUCTION)
    return _keep(docs, mixing.mix(rows, BUDGET_SHARE, max_epochs=1).filter("copies > 0"))


def stage_bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode(docs, bpe.word_bpe_file(), with_text=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", stage_language_id),
    ("near_dedup", stage_near_dedup),
    ("secret_scan", stage_secret_scan),
    ("mix_sources", stage_mix_sources),
    ("bpe_encode", stage_bpe_encode),
]

# language likelihoods and byte-pair merges are not SQL; tests hold run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
