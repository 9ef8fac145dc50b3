"""Time-ordered train/validation split without a global sort.

The first ``int(n * (1 - val_frac))`` rows in (dt, id) order are train. The
boundary is found from running counts over distinct dt values; only the rows
at the boundary dt are ranked by id (distributed the same way), so no task
ever holds more than one bucket of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.numeric import rnd
from riskframe.operators.prefix import key_at_count, running_sum


def first_n_mask(df: DataFrame, n_first: int, order: str = "dt",
                 id_col: str = "txn_id"):
    """Column that is true for the first ``n_first`` rows in (order, id) order."""
    if n_first <= 0:
        return F.lit(False)
    counts = df.groupBy(F.col(order).alias("_o")).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sum(counts, "_o", ["_n"])
    edge = cum.filter((F.col("_n_cum") - F.col("_n") < n_first) & (F.col("_n_cum") >= n_first)).first()
    if edge is None:                      # fewer rows than n_first
        return F.lit(True)
    b_val, before, at_b = edge["_o"], int(edge["_n_cum"] - edge["_n"]), int(edge["_n"])
    m = n_first - before
    order_c = F.col(order)
    if m >= at_b:
        return order_c <= F.lit(b_val)
    ties = df.filter(F.col(order) == F.lit(b_val)).select(
        F.col(id_col).alias("_id"))
    cut = key_at_count(ties, "_id", m).first()["_id"]
    return (order_c < F.lit(b_val)) | ((order_c == F.lit(b_val)) & (F.col(id_col) <= F.lit(cut)))


def time_split(df: DataFrame, val_frac: float = 0.2, order: str = "dt",
               id_col: str = "txn_id", col: str = "split") -> DataFrame:
    """Add ``split`` = 'train' for the first int(n*(1-val_frac)) rows by (dt, id), else 'val'."""
    n = df.count()
    n_train = int(n * (1 - val_frac))
    mask = first_n_mask(df, n_train, order, id_col)
    return df.withColumn(col, F.when(mask, F.lit("train")).otherwise(F.lit("val")))


def half_split(df: DataFrame, order: str = "dt", id_col: str = "txn_id",
               col: str = "half") -> DataFrame:
    """First n//2 rows by (dt, id) are 'early', the rest 'late'."""
    n = df.count()
    mask = first_n_mask(df, n // 2, order, id_col)
    return df.withColumn(col, F.when(mask, F.lit("early")).otherwise(F.lit("late")))


def boundary_filter(df: DataFrame, boundary: float, side: str, order: str = "dt") -> DataFrame:
    """Rebuild a raw split from a boundary value: train = order <= b, val = order > b."""
    c = F.col(order) <= F.lit(boundary)
    return df.filter(c if side == "train" else ~c)


def split_report(split_df: DataFrame, label: str = "is_fraud", order: str = "dt",
                 col: str = "split") -> DataFrame:
    """Row and fraud counts per side, rates, max train dt, min val dt, leakage flag."""
    tr = F.col(col) == "train"
    va = F.col(col) == "val"
    y = F.col(label).cast("long")
    agg = split_df.agg(
        F.count(F.when(tr, 1)).alias("train_rows"),
        F.count(F.when(va, 1)).alias("val_rows"),
        F.coalesce(F.sum(F.when(tr, y)), F.lit(0).cast("long")).alias("train_fraud"),
        F.coalesce(F.sum(F.when(va, y)), F.lit(0).cast("long")).alias("val_fraud"),
        F.max(F.when(tr, F.col(order))).alias("train_max_dt"),
        F.min(F.when(va, F.col(order))).alias("val_min_dt"))
    return agg.select(
        "*",
        rnd(F.try_divide(F.col("train_fraud").cast("double"), F.col("train_rows")), 4)
         .alias("train_fraud_rate"),
        rnd(F.try_divide(F.col("val_fraud").cast("double"), F.col("val_rows")), 4)
         .alias("val_fraud_rate"),
        (F.col("train_max_dt") <= F.col("val_min_dt")).alias("no_leakage"))


def split_overlap(split_df: DataFrame, id_col: str = "txn_id", col: str = "split") -> DataFrame:
    """Number of ids present on both sides (left semi join); 0 for a valid split."""
    tr = split_df.filter(F.col(col) == "train").select(id_col)
    va = split_df.filter(F.col(col) == "val").select(id_col)
    return tr.join(va, id_col, "left_semi").agg(F.count(F.lit(1)).alias("n_shared"))


def union_history(train: DataFrame, val: DataFrame) -> DataFrame:
    """Train rows followed by validation rows, matched by column name."""
    return train.unionByName(val)
