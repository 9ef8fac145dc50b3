"""Profiling queries (survey 2.3, 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import features as fx
from riskframe.operators import profile as pf
from riskframe.plans.catalog import register
from riskframe.plans.oracle import FEAT_CTE, mean_half_up_sql, with_txn
from riskframe.sources.tables import txn


def feat(spark, sf_dir):
    return fx.build_features(txn(spark, sf_dir))


@register("class_balance", with_txn(body="""
SELECT count(*) AS n_total, CAST(sum(is_fraud) AS BIGINT) AS n_fraud,
       count(*) - CAST(sum(is_fraud) AS BIGINT) AS n_legit,
       round(CAST(sum(is_fraud) AS DOUBLE) / count(*), 6) AS fraud_rate,
       round(CAST(count(*) - sum(is_fraud) AS DOUBLE) / sum(is_fraud), 4) AS legit_per_fraud
FROM txn
"""))
def q_class_balance(spark, sf_dir):
    """Counts by label, fraud rate, legit-to-fraud ratio."""
    return pf.class_balance(txn(spark, sf_dir))


@register("daily_fraud_rate", with_txn(FEAT_CTE, body="""
SELECT tx_day, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS n_fraud,
       round(CAST(sum(is_fraud) AS DOUBLE) / count(*), 6) AS fraud_rate
FROM feat GROUP BY tx_day
"""))
def q_daily_fraud_rate(spark, sf_dir):
    """Per day number: volume, fraud count, fraud rate."""
    return pf.daily_fraud_rate(feat(spark, sf_dir))


@register("split_day", with_txn(FEAT_CTE, body="""
SELECT CAST(trunc(quantile_cont(tx_day, 0.8)) AS BIGINT) AS split_day FROM feat
"""))
def q_split_day(spark, sf_dir):
    """0.8 quantile of the day number, truncated."""
    return pf.split_day(feat(spark, sf_dir))


@register("amount_by_class", with_txn(body="""
SELECT is_fraud, count(*) AS n, """ + mean_half_up_sql("amt", 4) + """ AS mean,
       round(quantile_cont(amt, 0.5), 4) AS median, round(quantile_cont(amt, 0.95), 4) AS p95,
       round(quantile_cont(amt, 0.25), 4) AS q1, round(quantile_cont(amt, 0.75), 4) AS q3
FROM txn GROUP BY is_fraud
"""))
def q_amount_by_class(spark, sf_dir):
    """Per class: mean, median, p95 and quartiles of the amount (exact)."""
    return pf.amount_by_class(txn(spark, sf_dir))


@register("amount_histogram", with_txn("""x AS (SELECT is_fraud AS cls, ln(1 + amt) AS x FROM txn WHERE amt IS NOT NULL),
rng AS (SELECT cls, min(x) AS lo, max(x) AS hi, count(*) AS n_cls FROM x GROUP BY cls),
b AS (SELECT x.cls, CASE WHEN hi = lo THEN 0
                   ELSE CAST(least(floor((x - lo) / ((hi - lo) / CAST(60 AS DOUBLE))), 59) AS INTEGER) END AS bin
      FROM x JOIN rng ON x.cls = rng.cls)""", body="""
SELECT b.cls, b.bin, round(lo + b.bin * ((hi - lo) / CAST(60 AS DOUBLE)), 6) AS bin_lo, count(*) AS n,
       round(count(*) / (n_cls * ((hi - lo) / CAST(60 AS DOUBLE))), 6) AS density
FROM b JOIN rng ON b.cls = rng.cls
GROUP BY b.cls, b.bin, lo, hi, n_cls
"""))
def q_amount_histogram(spark, sf_dir):
    """60 equal-width bins of log1p(amount) per class, count and density."""
    return pf.amount_histogram(txn(spark, sf_dir))


_MISS_COLS = ["txn_id", "dt", "amt", "card_id", "product", "email", "dist1", "device"]


@register("missing_profile", with_txn(body="\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 6)"
    f" AS missing_share FROM txn" for c in _MISS_COLS)))
def q_missing_profile(spark, sf_dir):
    """Null share of every column, one pass, unpivoted."""
    return pf.missing_profile(txn(spark, sf_dir), _MISS_COLS)


@register("missing_summary", with_txn("""m AS (""" + "\nUNION ALL\n".join(
    f"SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS s FROM txn"
    for c in _MISS_COLS) + ")", body="""
SELECT count(CASE WHEN round(s, 6) > 0.8 THEN 1 END) AS n_over_80pct,
       count(CASE WHEN round(s, 6) > 0 THEN 1 END) AS n_any_missing, count(*) AS n_columns FROM m
"""))
def q_missing_summary(spark, sf_dir):
    """Columns over 80 % missing, columns with any missing, column count."""
    return pf.missing_summary(txn(spark, sf_dir), _MISS_COLS)


@register("category_fraud_rate", with_txn(body="""
SELECT email AS value, round(avg(is_fraud::DOUBLE), 6) AS fraud_rate, count(*) AS n
FROM txn WHERE email IS NOT NULL GROUP BY email
ORDER BY avg(is_fraud::DOUBLE) DESC, email LIMIT 15
"""))
def q_category_fraud_rate(spark, sf_dir):
    """Fraud rate and n per email domain, the 15 highest rates."""
    return pf.category_fraud_rate(txn(spark, sf_dir), "email")


_RATE_COLS = ["product", "email", "device", "uid_card_email"]


@register("category_fraud_rates", with_txn(FEAT_CTE, "cats AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, is_fraud FROM feat" for c in _RATE_COLS) + ")", body="""
SELECT col AS "column", value, round(fraud_rate, 6) AS fraud_rate, n
FROM (SELECT col, value, avg(is_fraud::DOUBLE) AS fraud_rate, count(*) AS n,
             row_number() OVER (PARTITION BY col ORDER BY avg(is_fraud::DOUBLE) DESC, value) AS rk
      FROM cats WHERE value IS NOT NULL GROUP BY col, value)
WHERE rk <= 15"""))
def q_category_fraud_rates(spark, sf_dir):
    """Fraud rate and n per value of all four categorical columns, the 15 highest of each, in one job."""
    return pf.category_fraud_rates(fx.build_features(txn(spark, sf_dir)), _RATE_COLS)


_CORR_COLS = ["amt", "dist1", "dt", "card_id", "u"]


@register("label_correlation", with_txn("lc AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(corr({c}::DOUBLE, is_fraud::DOUBLE), 6) AS corr,"
    f" round(abs(corr({c}::DOUBLE, is_fraud::DOUBLE)), 6) AS abs_corr FROM txn" for c in _CORR_COLS) + ")", body="""
SELECT feature, corr, abs_corr,
       CAST(row_number() OVER (ORDER BY abs_corr DESC NULLS LAST, feature) AS INTEGER) AS abs_rank,
       coalesce(abs_corr > 0.05, false) AS above_threshold
FROM lc"""))
def q_label_correlation(spark, sf_dir):
    """Pearson correlation of numeric columns with the label, one pass, ranked by |corr|."""
    return pf.label_correlation(txn(spark, sf_dir), _CORR_COLS)


@register("identity_match", with_txn(body="""
SELECT round(avg(CASE WHEN device IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS match_rate,
       count(CASE WHEN device IS NOT NULL THEN 1 END) AS n_with_identity,
       count(CASE WHEN device IS NULL THEN 1 END) AS n_without_identity,
       round(avg(CASE WHEN device IS NOT NULL THEN is_fraud::DOUBLE END), 6) AS fraud_rate_with,
       round(avg(CASE WHEN device IS NULL THEN is_fraud::DOUBLE END), 6) AS fraud_rate_without
FROM txn
"""))
def q_identity_match(spark, sf_dir):
    """Identity match rate and fraud rate with/without an identity record."""
    return pf.identity_match(txn(spark, sf_dir))


@register("drop_missing", with_txn(body="""
SELECT txn_id, dist1 FROM txn WHERE dist1 IS NOT NULL
"""))
def q_drop_missing(spark, sf_dir):
    """Rows of a column with missing values dropped before statistics."""
    return txn(spark, sf_dir).filter(F.col("dist1").isNotNull()).select("txn_id", "dist1")
