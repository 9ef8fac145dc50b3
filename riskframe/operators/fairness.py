"""Group fairness at a score threshold: confusion rates per group, the 4/5ths
disparate-impact ratio and the FPR equality gap.

Several proxy columns are handled in one job keyed by (proxy, group): the
frame is unpivoted to (proxy, group) rows and aggregated once, with map-side
partial aggregation absorbing a hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.codes import FOUR_FIFTHS
from riskframe.functions.numeric import rnd
from riskframe.operators import lookup
from riskframe.session import written

MIN_GROUP = 100


def proxies_long(df: DataFrame, proxies: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., proxy, group) rows: one per row and proxy."""
    wide = df.select(*keep, *[F.col(p).cast("string").alias(p) for p in proxies])
    return wide.unpivot(list(keep), list(proxies), "proxy", "group")


def collapse_small_groups(long: DataFrame, min_size: int = MIN_GROUP) -> DataFrame:
    """Values with fewer than ``min_size`` rows become 'other'; missing becomes
    'missing' afterwards (so 'missing' is never collapsed)."""
    pair = F.concat("proxy", F.lit("\u0000"), F.col("group").cast("string"))
    large = written(long.filter(F.col("group").isNotNull()).groupBy(pair.alias("_pair")).agg(F.count(F.lit(1)).alias("_n"))
                    .filter(F.col("_n") >= min_size).select("_pair", F.lit(True).alias("_large"), F.lit("all").alias("_name")), "groups")
    beyond = not large.isEmpty() and not lookup.small_tables(large, "_name", "_pair")
    heavy = lookup.heavy_values(long, {"pair": pair})["pair"] if beyond else []
    j = lookup.look_up(long, pair, large, "_pair", ["_large"], not beyond, heavy)
    g = (F.when(F.col("group").isNull(), F.lit("missing"))
          .when(F.col("_large").isNull(), F.lit("other"))
          .otherwise(F.col("group")))
    return j.withColumn("group", g).drop("_large")


_COUNTS = ["n_total", "n_fraud", "_flag", "_tp", "_fp", "_fn", "_tn"]


def confusion_counts(long: DataFrame, threshold: float, score: str = "score",
                     label: str = "is_fraud") -> DataFrame:
    """Per raw (proxy, group): row, label, flag and confusion counts (one aggregation)."""
    flag = (F.col(score) >= F.lit(threshold)).cast("long")
    y = F.col(label).cast("long")
    return long.groupBy("proxy", "group").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.sum(y).alias("n_fraud"),
        F.sum(flag).alias("_flag"),
        F.sum(flag * y).alias("_tp"),
        F.sum(flag * (1 - y)).alias("_fp"),
        F.sum((1 - flag) * y).alias("_fn"),
        F.sum((1 - flag) * (1 - y)).alias("_tn"))


def fold_small_groups(counts: DataFrame, min_size: int = MIN_GROUP) -> DataFrame:
    """``collapse_small_groups`` on counts per raw value: the counts add up, so no row
    is joined with its group's size."""
    g = (F.when(F.col("group").isNull(), F.lit("missing"))
          .when(F.col("n_total") < min_size, F.lit("other"))
          .otherwise(F.col("group")))
    return counts.withColumn("group", g).groupBy("proxy", "group").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def rates(counts: DataFrame) -> DataFrame:
    """Group metrics from counts (4 dp, NULL where a denominator is zero)."""
    d = F.try_divide
    return counts.select(
        "proxy", "group", "n_total", "n_fraud",
        rnd(d(F.col("n_fraud").cast("double"), F.col("n_total")), 4).alias("fraud_rate"),
        rnd(d(F.col("_flag").cast("double"), F.col("n_total")), 4).alias("flag_rate"),
        rnd(d(F.col("_fp").cast("double"), F.col("_fp") + F.col("_tn")), 4).alias("fpr"),
        rnd(d(F.col("_tp").cast("double"), F.col("_tp") + F.col("_fn")), 4).alias("tpr"),
        rnd(d(F.col("_tp").cast("double"), F.col("_tp") + F.col("_fp")), 4).alias("precision"))


def group_metrics(long: DataFrame, threshold: float, score: str = "score",
                  label: str = "is_fraud") -> DataFrame:
    """Per (proxy, group): n, fraud, rates at flag = score >= threshold."""
    return rates(confusion_counts(long, threshold, score, label))


def _extremes(metrics: DataFrame, col: str) -> DataFrame:
    """Per proxy: min and max of ``col`` over groups with a value, the group
    holding each (ties: smallest group name), and the number of groups."""
    m = metrics.filter(F.col(col).isNotNull())
    lo_hi = m.groupBy("proxy").agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"),
                                   F.count(F.lit(1)).alias("_ng"))
    j = m.join(lo_hi, "proxy")
    return j.groupBy("proxy", "_lo", "_hi", "_ng").agg(
        F.min(F.when(F.col(col) == F.col("_lo"), F.col("group"))).alias("_lo_group"),
        F.min(F.when(F.col(col) == F.col("_hi"), F.col("group"))).alias("_hi_group"))


def disparate_impact(metrics: DataFrame) -> DataFrame:
    """Per proxy: lowest / highest flag rate (rounded rates), groups named,
    adverse impact when the ratio is below 0.80. Fewer than two groups or a
    zero highest rate: NULL ratio, not indicated."""
    e = _extremes(metrics, "flag_rate")
    two = F.col("_ng") >= 2
    ratio = F.when(two & (F.col("_hi") > 0), F.col("_lo") / F.col("_hi"))
    return e.select(
        "proxy",
        F.when(two, F.col("_lo_group")).alias("min_flag_group"),
        F.when(two, F.col("_hi_group")).alias("max_flag_group"),
        F.when(two, rnd("_lo", 4)).alias("min_flag_rate"),
        F.when(two, rnd("_hi", 4)).alias("max_flag_rate"),
        rnd(ratio, 4).alias("di_ratio"),
        F.coalesce(ratio < FOUR_FIFTHS, F.lit(False)).alias("adverse_impact_indicated"))


def fpr_gap(metrics: DataFrame) -> DataFrame:
    """Per proxy: highest minus lowest FPR over groups, groups named, in points."""
    e = _extremes(metrics, "fpr")
    two = F.col("_ng") >= 2
    gap = F.when(two, F.col("_hi") - F.col("_lo"))
    return e.select(
        "proxy",
        F.when(two, F.col("_hi_group")).alias("max_fpr_group"),
        F.when(two, F.col("_lo_group")).alias("min_fpr_group"),
        F.when(two, rnd("_hi", 4)).alias("max_fpr"),
        F.when(two, rnd("_lo", 4)).alias("min_fpr"),
        rnd(gap, 4).alias("fpr_gap"),
        rnd(gap * 100, 2).alias("fpr_gap_pct_pts"))


def fairness_suite(df: DataFrame, proxies: Sequence[str], threshold: float,
                   score: str = "score", label: str = "is_fraud",
                   min_size: int = MIN_GROUP) -> DataFrame:
    """Group metrics for every present proxy column in one job."""
    present = [p for p in proxies if p in df.columns]
    long = proxies_long(df, present, [score, label])
    return rates(fold_small_groups(confusion_counts(long, threshold, score, label), min_size))


def fairness_report(metrics: DataFrame, threshold: float) -> DataFrame:
    """Per proxy: threshold, disparate impact and FPR gap in one row."""
    return (disparate_impact(metrics).join(fpr_gap(metrics), "proxy", "full")
            .withColumn("threshold", rnd(F.lit(threshold), 4)))
