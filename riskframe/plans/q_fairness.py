"""Fairness queries (survey 2.11) on the val split at the 3 % review threshold."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.numeric import rnd
from riskframe.operators import fairness as fa
from riskframe.operators import ranking
from riskframe.plans.catalog import register
from riskframe.plans.oracle import with_txn
from riskframe.plans.q_split import SPLIT_CTE, split_txn

PROXIES = ["product", "email", "device"]

_VAL_CTE = SPLIT_CTE + """,
val AS (SELECT * FROM splitted WHERE split = 'val'),
thr AS (SELECT score AS t FROM (
    SELECT score, row_number() OVER (ORDER BY score DESC, txn_id) AS rn, count(*) OVER () AS n FROM val)
  WHERE rn = greatest(1, CAST(floor(n * CAST(0.03 AS DOUBLE)) AS BIGINT))),
lg AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{p}' AS proxy, CAST({p} AS VARCHAR) AS grp, score, is_fraud FROM val" for p in PROXIES) + """),
sizes AS (SELECT proxy, grp, count(*) AS gn FROM lg WHERE grp IS NOT NULL GROUP BY proxy, grp),
collapsed AS (
  SELECT lg.proxy, CASE WHEN lg.grp IS NULL THEN 'missing' WHEN s.gn < 100 THEN 'other' ELSE lg.grp END AS grp,
         lg.score, lg.is_fraud
  FROM lg LEFT JOIN sizes s ON lg.proxy = s.proxy AND lg.grp = s.grp),
conf AS (
  SELECT proxy, grp, count(*) AS n_total, CAST(sum(is_fraud) AS BIGINT) AS n_fraud,
         sum(CASE WHEN score >= t THEN 1 ELSE 0 END) AS fl,
         sum(CASE WHEN score >= t AND is_fraud = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN score >= t AND is_fraud = 0 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN score < t AND is_fraud = 1 THEN 1 ELSE 0 END) AS fn,
         sum(CASE WHEN score < t AND is_fraud = 0 THEN 1 ELSE 0 END) AS tn
  FROM collapsed, thr GROUP BY proxy, grp),
gm AS (
  SELECT proxy, grp AS "group", n_total, n_fraud,
         round(CAST(n_fraud AS DOUBLE) / n_total, 4) AS fraud_rate,
         round(CAST(fl AS DOUBLE) / n_total, 4) AS flag_rate,
         round(CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) END, 4) AS fpr,
         round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END, 4) AS tpr,
         round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END, 4) AS precision
  FROM conf)"""


def _ext_cte(col: str, p: str) -> str:
    return f"""{p}e AS (
  SELECT proxy, min({col}) AS lo, max({col}) AS hi, count(*) AS ng FROM gm WHERE {col} IS NOT NULL GROUP BY proxy),
{p}x AS (
  SELECT e.proxy, lo, hi, ng,
         min(CASE WHEN g.{col} = lo THEN g."group" END) AS lo_group,
         min(CASE WHEN g.{col} = hi THEN g."group" END) AS hi_group
  FROM {p}e e JOIN gm g ON e.proxy = g.proxy WHERE g.{col} IS NOT NULL GROUP BY e.proxy, lo, hi, ng)"""


_DI_BODY = """
SELECT proxy, CASE WHEN ng >= 2 THEN lo_group END AS min_flag_group,
       CASE WHEN ng >= 2 THEN hi_group END AS max_flag_group,
       CASE WHEN ng >= 2 THEN round(lo, 4) END AS min_flag_rate,
       CASE WHEN ng >= 2 THEN round(hi, 4) END AS max_flag_rate,
       round(CASE WHEN ng >= 2 AND hi > 0 THEN lo / hi END, 4) AS di_ratio,
       coalesce(CASE WHEN ng >= 2 AND hi > 0 THEN lo / hi END < 0.8, false) AS adverse_impact_indicated
FROM di_x"""

_FPR_BODY = """
SELECT proxy, CASE WHEN ng >= 2 THEN hi_group END AS max_fpr_group,
       CASE WHEN ng >= 2 THEN lo_group END AS min_fpr_group,
       CASE WHEN ng >= 2 THEN round(hi, 4) END AS max_fpr,
       CASE WHEN ng >= 2 THEN round(lo, 4) END AS min_fpr,
       round(CASE WHEN ng >= 2 THEN hi - lo END, 4) AS fpr_gap,
       round(CASE WHEN ng >= 2 THEN hi - lo END * 100, 2) AS fpr_gap_pct_pts
FROM fp_x"""


def val_and_threshold(spark, sf_dir, rate: float = 0.03):
    val = split_txn(spark, sf_dir).filter(F.col("split") == "val")
    t, _ = ranking.review_threshold(val, rate)
    return val, t


def suite(spark, sf_dir):
    val, t = val_and_threshold(spark, sf_dir)
    return fa.fairness_suite(val, PROXIES, t), t


@register("review_threshold", with_txn(_VAL_CTE, body="SELECT round(t, 6) AS threshold FROM thr"))
def q_review_threshold(spark, sf_dir):
    """Score of the n-th highest val row, n = max(1, int(N * 0.03))."""
    val = split_txn(spark, sf_dir).filter(F.col("split") == "val")
    return ranking.review_threshold_frame(val, 0.03).select(rnd("threshold", 6).alias("threshold"))


@register("collapse_small_groups", with_txn(_VAL_CTE, body="""
SELECT proxy, grp AS "group", count(*) AS n FROM collapsed GROUP BY proxy, grp
"""))
def q_collapse_small_groups(spark, sf_dir):
    """Per proxy: groups after collapsing values under 100 rows to 'other' and missing to 'missing'."""
    val = split_txn(spark, sf_dir).filter(F.col("split") == "val")
    long = fa.collapse_small_groups(fa.proxies_long(val, PROXIES, ["score", "is_fraud"]))
    return long.groupBy("proxy", "group").agg(F.count(F.lit(1)).alias("n"))


@register("group_metrics", with_txn(_VAL_CTE, body="SELECT * FROM gm"))
def q_group_metrics(spark, sf_dir):
    """Per (proxy, group): n, fraud, fraud/flag rates, FPR, TPR, precision at the 3 % threshold."""
    return suite(spark, sf_dir)[0]


@register("fairness_suite", with_txn(_VAL_CTE, body="SELECT * FROM gm"))
def q_fairness_suite(spark, sf_dir):
    """Group metrics for product, email and device in one job keyed by (proxy, group)."""
    val, t = val_and_threshold(spark, sf_dir)
    return fa.fairness_suite(val, PROXIES + ["not_a_column"], t)


@register("disparate_impact", with_txn(_VAL_CTE, _ext_cte("flag_rate", "di_"), body=_DI_BODY))
def q_disparate_impact(spark, sf_dir):
    """Lowest over highest flag rate per proxy, groups named, 4/5ths indication."""
    return fa.disparate_impact(suite(spark, sf_dir)[0])


@register("fpr_gap", with_txn(_VAL_CTE, _ext_cte("fpr", "fp_"), body=_FPR_BODY))
def q_fpr_gap(spark, sf_dir):
    """Highest minus lowest FPR per proxy, groups named, in points."""
    return fa.fpr_gap(suite(spark, sf_dir)[0])


@register("fairness_report", with_txn(_VAL_CTE, _ext_cte("flag_rate", "di_"), _ext_cte("fpr", "fp_"),
                                      f"di AS ({_DI_BODY}), fg AS ({_FPR_BODY})", body="""
SELECT coalesce(di.proxy, fg.proxy) AS proxy, min_flag_group, max_flag_group, min_flag_rate, max_flag_rate,
       di_ratio, adverse_impact_indicated, max_fpr_group, min_fpr_group, max_fpr, min_fpr, fpr_gap,
       fpr_gap_pct_pts, round((SELECT t FROM thr), 4) AS threshold
FROM di FULL JOIN fg ON di.proxy = fg.proxy
"""))
def q_fairness_report(spark, sf_dir):
    """Per proxy: threshold, disparate impact and FPR gap in one row."""
    m, t = suite(spark, sf_dir)
    return fa.fairness_report(m, t)
