"""Headline metrics over sliding time windows, all windows in one set of jobs.

Rows are counted once by pane and score. A pane is the longest stretch of time that lies
wholly inside or outside every window (a day for 30-day windows that slide by 7 days), so a
window's counts are sums of its panes' counts, and no row is copied into the windows that
contain it. Only rows at a score where a review ends inside a tie are looked at again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.numeric import rnd
from riskframe.operators.ranking import grouped_metrics

EPOCH_2024 = 1704067200          # 2024-01-01 00:00:00 UTC, origin of the dt counter
DAY = 86_400


def window_starts(at: Column, length: int, slide: int) -> Column:
    """Starts (multiples of ``slide``) of the windows that contain the instant, in seconds."""
    last = at - F.pmod(at, F.lit(slide))
    starts = F.transform(F.sequence(F.lit(0), F.lit(-(-length // slide) - 1)), lambda k: last - k * slide)
    return F.filter(starts, lambda s: s + length > at)


def rolling_metrics(df: DataFrame, length: int = 30 * DAY, slide: int = 7 * DAY, dt: str = "dt", score: str = "score",
                    label: str = "is_fraud", id_col: str = "txn_id", origin: int = EPOCH_2024) -> DataFrame:
    """Per window (start in epoch seconds): rows, positives, ROC-AUC, average precision,
    detection rate at 3 % and 5 %. length and slide in seconds. Rows without a time are in no window."""
    at = F.col(dt) + F.lit(origin)
    size = math.gcd(length, slide)
    panes = df.filter(F.col(dt).isNotNull()).groupBy((at - F.pmod(at, F.lit(size))).alias("_pane"), F.col(score).alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    counts = panes.withColumn("window_start", F.explode(window_starts(F.col("_pane"), length, slide))) \
        .groupBy("window_start", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))

    def rows_at(ends):
        rows = df.select(at.alias("_at"), F.col(score).alias("_s"), F.col(id_col).alias("_id"), F.col(label).cast("long").alias("_y"))
        here = (F.col("_s") == F.col("threshold")) & F.col("_at").between(F.col("window_start"), F.col("window_start") + length - 1)
        return rows.join(F.broadcast(ends), here).select("window_start", "tid", "m", "_id", "_y")    # windows x review rates
    found = grouped_metrics(counts, ["window_start"], (0.03, 0.05), rows_at)
    return found.select(
        "window_start", "n_rows", "n_pos", rnd("roc_auc", 4).alias("roc_auc"), rnd("pr_auc", 4).alias("pr_auc"),
        rnd(F.col("fdr")[0], 4).alias("fdr_at_3pct"), rnd(F.col("fdr")[1], 4).alias("fdr_at_5pct"))
