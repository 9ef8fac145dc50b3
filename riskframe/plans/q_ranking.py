"""Ranking-metric queries over the txn binding (survey 2.7, 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.numeric import rnd
from riskframe.operators import ranking
from riskframe.plans.catalog import register
from riskframe.plans.oracle import with_txn
from riskframe.sources.tables import txn

_RATES_VALUES = ", ".join(f"({i}, CAST({r} AS DOUBLE))" for i, r in enumerate(ranking.REVIEW_RATES))

# Top-k by (score desc, txn_id asc) with review counts max(1, int(N*rate)).
_RANKED = """ranked AS (
  SELECT score, is_fraud, row_number() OVER (ORDER BY score DESC, txn_id) AS rn
  FROM txn),
tot AS (SELECT count(*) AS n_all, sum(is_fraud) AS p_all FROM txn)"""


def _rates_cte(values: str) -> str:
    return f"""rates(tid, rate) AS (VALUES {values}),
tg AS (SELECT tid, rate, greatest(1, CAST(floor(n_all * rate) AS BIGINT)) AS k, p_all
       FROM rates, tot)"""


@register("threshold_table", with_txn(_RANKED, _rates_cte(_RATES_VALUES), body="""
SELECT round(tg.rate * 100, 1) AS review_rate_pct,
       round(max(CASE WHEN r.rn = tg.k THEN r.score END), 4) AS threshold,
       tg.k AS n_reviewed,
       CAST(sum(CASE WHEN r.rn <= tg.k THEN r.is_fraud ELSE 0 END) AS BIGINT) AS fraud_caught,
       round(CAST(sum(CASE WHEN r.rn <= tg.k THEN r.is_fraud ELSE 0 END) AS DOUBLE) / tg.p_all, 4) AS fdr,
       round(CAST(sum(CASE WHEN r.rn <= tg.k THEN r.is_fraud ELSE 0 END) AS DOUBLE) / tg.k, 4) AS precision
FROM tg JOIN ranked r ON r.rn <= tg.k
GROUP BY tg.tid, tg.rate, tg.k, tg.p_all
"""))
def q_threshold_table(spark, sf_dir):
    """Six review rates: threshold, rows reviewed, fraud caught, detection rate, precision."""
    return ranking.threshold_table(txn(spark, sf_dir))


@register("roc_auc", with_txn("""st AS (
  SELECT score, count(*) AS n, sum(is_fraud) AS pos FROM txn GROUP BY score),
cum AS (
  SELECT score, pos, n - pos AS neg,
         sum(n - pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum
  FROM st)""", body="""
SELECT round(sum(pos * (neg_cum - neg + neg / CAST(2 AS DOUBLE))) / (sum(pos) * sum(neg)), 4) AS roc_auc
FROM cum
"""))
def q_roc_auc(spark, sf_dir):
    """Exact ROC-AUC with ties counted one half."""
    return ranking.auc_ap(txn(spark, sf_dir)).select(rnd("roc_auc", 4).alias("roc_auc"))


@register("average_precision", with_txn("""st AS (
  SELECT score, count(*) AS n, sum(is_fraud) AS pos FROM txn GROUP BY score),
cum AS (
  SELECT score, pos,
         sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos_cum,
         sum(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_cum
  FROM st)""", body="""
SELECT round(sum(CASE WHEN pos > 0 THEN pos * (CAST(pos_cum AS DOUBLE) / n_cum) ELSE 0 END) / sum(pos), 4) AS pr_auc
FROM cum
"""))
def q_average_precision(spark, sf_dir):
    """Average precision: sum over distinct thresholds of recall step times precision."""
    return ranking.auc_ap(txn(spark, sf_dir)).select(rnd("pr_auc", 4).alias("pr_auc"))
