"""Exploratory profiling: class balance, daily rates, amounts by class,
histograms, missingness, category rates, label correlation, identity match.

Every statistic is a grouped aggregate with map-side partial aggregation;
wide profiles (one value per column) are computed in a single pass and then
unpivoted, so the number of passes does not grow with the column count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.numeric import mean_half_up, rnd
from riskframe.operators.quantiles import exact_quantiles


def class_balance(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    y = F.col(label).cast("long")
    agg = df.agg(F.count(F.lit(1)).alias("n_total"), F.sum(y).alias("n_fraud"))
    return agg.select(
        "n_total", "n_fraud", (F.col("n_total") - F.col("n_fraud")).alias("n_legit"),
        rnd(F.try_divide(F.col("n_fraud").cast("double"), F.col("n_total")), 6).alias("fraud_rate"),
        rnd(F.try_divide((F.col("n_total") - F.col("n_fraud")).cast("double"),
                             F.col("n_fraud")), 4).alias("legit_per_fraud"))


def daily_fraud_rate(df: DataFrame, day: str = "tx_day", label: str = "is_fraud") -> DataFrame:
    """Per day: volume, fraud count, fraud rate (0 where there is no fraud)."""
    y = F.col(label).cast("long")
    return (df.groupBy(day)
              .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_fraud"))
              .withColumn("fraud_rate", rnd(F.col("n_fraud") / F.col("n"), 6)))


MAX_CLASSES = 10_000            # classes whose ranges are broadcast


def split_day(df: DataFrame, day: str = "tx_day", q: float = 0.8) -> DataFrame:
    """The q-quantile of the day number, truncated to an integer."""
    qq = exact_quantiles(df, day, [q])
    return qq.select(F.col("quantile").cast("long").alias("split_day"))


def amount_by_class(df: DataFrame, amt: str = "amt", label: str = "is_fraud") -> DataFrame:
    """Per class: n, mean, median, p95 and quartiles of the amount."""
    probs = [0.25, 0.5, 0.75, 0.95]
    q = exact_quantiles(df, amt, probs, by=[label])
    wide = q.groupBy(label).agg(*[
        F.max(F.when(F.col("qi") == i, F.col("quantile"))).alias(n)
        for i, n in enumerate(["q1", "median", "q3", "p95"])])
    means = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), mean_half_up(amt, 4).alias("mean"))
    return means.join(wide, label).select(
        label, "n", "mean", *[rnd(c, 4).alias(c) for c in ["median", "p95", "q1", "q3"]])


def amount_histogram(df: DataFrame, bins: int = 60, amt: str = "amt",
                     label: str = "is_fraud") -> DataFrame:
    """Equal-width histogram of log1p(amount) per class, each class on its own range.

    Bins are [lo + i*w, lo + (i+1)*w), the last one closed. Output: class,
    bin, lower edge, count, density (count / (n * width)).
    """
    x = df.select(F.col(label).alias("cls"), F.log1p(F.col(amt)).alias("x")).filter(
        F.col("x").isNotNull())
    rng = x.groupBy("cls").agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                               F.count(F.lit(1)).alias("n_cls"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    # one row per class: read once, and broadcast while the classes are few
    rows = rng.limit(MAX_CLASSES + 1).collect()
    if len(rows) <= MAX_CLASSES:
        rng = F.broadcast(df.sparkSession.createDataFrame(rows, rng.schema))
    b = F.least(F.floor((F.col("x") - F.col("lo")) / w), F.lit(bins - 1)).cast("int")
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(b)
    counted = (x.join(rng, "cls")
                .groupBy("cls", b.alias("bin"))
                .agg(F.count(F.lit(1)).alias("n")))
    return counted.join(rng, "cls").select(
        "cls", "bin",
        rnd(F.col("lo") + F.col("bin") * w, 6).alias("bin_lo"),
        "n",
        rnd(F.try_divide(F.col("n").cast("double"), F.col("n_cls") * w), 6).alias("density"))


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null share per column in one pass, unpivoted, highest first."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "missing_share")
    return long.select("column", rnd("missing_share", 6).alias("missing_share"))


def missing_summary(df: DataFrame, cols: Sequence[str] | None = None,
                    high: float = 0.8) -> DataFrame:
    prof = missing_profile(df, cols)
    return prof.agg(F.count(F.when(F.col("missing_share") > high, 1)).alias("n_over_80pct"),
                    F.count(F.when(F.col("missing_share") > 0, 1)).alias("n_any_missing"),
                    F.count(F.lit(1)).alias("n_columns"))


def category_fraud_rate(df: DataFrame, col: str, label: str = "is_fraud",
                        top: int = 15) -> DataFrame:
    """Per value (missing dropped): fraud rate and n; the `top` highest rates
    (ties by value), a top-k report."""
    y = F.col(label).cast("double")
    agg = (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
             .agg(F.avg(y).alias("fraud_rate"), F.count(F.lit(1)).alias("n")))
    return (agg.orderBy(F.desc("fraud_rate"), "value").limit(top)
               .select("value", rnd("fraud_rate", 6).alias("fraud_rate"), "n"))


def category_fraud_rates(df: DataFrame, cols: Sequence[str], label: str = "is_fraud",
                         top: int = 15) -> DataFrame:
    """``category_fraud_rate`` of several columns in one job: column, value, rate, n."""
    wide = df.select(F.col(label).cast("double").alias("_y"), *[F.col(c).cast("string").alias(c) for c in cols])
    agg = (wide.unpivot(["_y"], list(cols), "column", "value").filter(F.col("value").isNotNull())
               .groupBy("column", "value").agg(F.avg("_y").alias("fraud_rate"), F.count(F.lit(1)).alias("n")))
    # a rank limit per column: each task keeps its own first rows before the shuffle
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("fraud_rate"), "value"))
    best = agg.withColumn("_rank", rank).filter(F.col("_rank") <= top)
    return best.select("column", "value", rnd("fraud_rate", 6).alias("fraud_rate"), "n")


def label_correlation(df: DataFrame, cols: Sequence[str], label: str = "is_fraud",
                      threshold: float = 0.05) -> DataFrame:
    """Pearson correlation of each column with the label (pairwise complete), one
    pass; rank by |corr| (ties by name) and whether |corr| exceeds the threshold."""
    y = F.col(label).cast("double")
    wide = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), "feature", "corr").select(
        "feature", rnd("corr", 6).alias("corr"), rnd(F.abs("corr"), 6).alias("abs_corr"))
    # one row per requested column
    w = Window.orderBy(F.desc_nulls_last("abs_corr"), "feature")
    return long.withColumn("abs_rank", F.row_number().over(w)).withColumn(
        "above_threshold", F.coalesce(F.col("abs_corr") > threshold, F.lit(False)))


def identity_match(df: DataFrame, ident: str = "device", label: str = "is_fraud") -> DataFrame:
    """Share of rows with an identity record; fraud rate with and without."""
    has = F.col(ident).isNotNull()
    y = F.col(label).cast("double")
    return df.agg(
        rnd(F.avg(has.cast("double")), 6).alias("match_rate"),
        F.count(F.when(has, 1)).alias("n_with_identity"),
        F.count(F.when(~has, 1)).alias("n_without_identity"),
        rnd(F.avg(F.when(has, y)), 6).alias("fraud_rate_with"),
        rnd(F.avg(F.when(~has, y)), 6).alias("fraud_rate_without"))
