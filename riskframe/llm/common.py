"""Shared helpers: tables in the shared folder, code for Python tasks, the word rule as columns."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import hashing
from riskframe.session import ensure_checkpoint_dir, ship_by_value

WORD_GAP = "[\\x20\\x09-\\x0D]+"             # between words
WORD = "[^\\x20\\x09-\\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the folder all executors share and read it back: the
    lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(module: str) -> None:
    """Python tasks get the functions of ``hashing`` and of the named module by value."""
    ship_by_value(hashing, sys.modules[module])


def words(text) -> F.Column:
    """Column: the array of words of a text (null: none)."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")
