"""More ranking queries: curves, confusion, model comparison, top-k (survey 2.7, 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.numeric import rnd
from riskframe.operators import ranking
from riskframe.plans.catalog import register
from riskframe.plans.oracle import with_txn
from riskframe.sources.tables import txn

_CURVE = """st AS (SELECT score, sum(is_fraud) AS pos, count(*) - sum(is_fraud) AS neg FROM txn GROUP BY score),
cum AS (SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pc,
               sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nc,
               sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM st)"""


@register("roc_curve", with_txn(_CURVE, body="""
SELECT round(score, 6) AS threshold, round(CAST(nc AS DOUBLE) / N, 6) AS fpr, round(CAST(pc AS DOUBLE) / P, 6) AS tpr
FROM cum
"""))
def q_roc_curve(spark, sf_dir):
    """(fpr, tpr) at every distinct score threshold."""
    c = ranking.curve_points(txn(spark, sf_dir))
    return c.select(rnd("threshold", 6).alias("threshold"), rnd("fpr", 6).alias("fpr"),
                    rnd("tpr", 6).alias("tpr"))


@register("pr_curve", with_txn(_CURVE, body="""
SELECT round(score, 6) AS threshold, round(CAST(pc AS DOUBLE) / (pc + nc), 6) AS precision,
       round(CAST(pc AS DOUBLE) / P, 6) AS recall
FROM cum
"""))
def q_pr_curve(spark, sf_dir):
    """(precision, recall) at every distinct score threshold."""
    c = ranking.curve_points(txn(spark, sf_dir))
    return c.select(rnd("threshold", 6).alias("threshold"), rnd("precision", 6).alias("precision"),
                    rnd("recall", 6).alias("recall"))


_RANKED = """rk AS (SELECT txn_id, score, is_fraud, row_number() OVER (ORDER BY score DESC, txn_id) AS rn,
                  count(*) OVER () AS n_all, sum(is_fraud) OVER () AS p_all FROM txn)"""


def _fdr_sql(rate: str) -> str:
    return (f"(SELECT CAST(sum(CASE WHEN rn <= greatest(1, CAST(floor(n_all * CAST({rate} AS DOUBLE)) AS BIGINT))"
            f" THEN is_fraud ELSE 0 END) AS DOUBLE) / any_value(p_all) FROM rk)")


@register("fdr_at_rate", with_txn(_RANKED, body=f"""
SELECT round({_fdr_sql('0.03')}, 4) AS fdr_at_3pct, round({_fdr_sql('0.05')}, 4) AS fdr_at_5pct
"""))
def q_fdr_at_rate(spark, sf_dir):
    """Share of all fraud inside the top max(1, int(N * rate)) rows, rates 3 % and 5 %."""
    fd = ranking.fdr_at_rates(txn(spark, sf_dir), (0.03, 0.05))
    return fd.groupBy().agg(
        rnd(F.max(F.when(F.col("tid") == 0, F.col("fdr"))), 4).alias("fdr_at_3pct"),
        rnd(F.max(F.when(F.col("tid") == 1, F.col("fdr"))), 4).alias("fdr_at_5pct"))


_AUC_AP = """st2 AS (SELECT score, count(*) AS n, sum(is_fraud) AS pos FROM txn GROUP BY score),
c2 AS (SELECT score, pos, n - pos AS neg,
              sum(n - pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum,
              sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos_cum,
              sum(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_cum FROM st2),
aa AS (SELECT sum(pos * (neg_cum - neg + neg / CAST(2 AS DOUBLE))) / (sum(pos) * sum(neg)) AS auc,
              sum(CASE WHEN pos > 0 THEN pos * (CAST(pos_cum AS DOUBLE) / n_cum) ELSE 0 END) / sum(pos) AS ap FROM c2)"""


@register("headline_metrics", with_txn(_RANKED, _AUC_AP, body=f"""
SELECT round(auc, 4) AS roc_auc, round(ap, 4) AS pr_auc,
       round({_fdr_sql('0.03')}, 4) AS fdr_at_3pct, round({_fdr_sql('0.05')}, 4) AS fdr_at_5pct FROM aa
"""))
def q_headline_metrics(spark, sf_dir):
    """ROC-AUC, average precision, detection rate at 3 % and 5 % review, one row."""
    return ranking.headline_metrics(txn(spark, sf_dir))


@register("confusion_at_threshold", with_txn(_RANKED, """th AS (
  SELECT score AS t FROM rk WHERE rn = greatest(1, CAST(floor(n_all * CAST(0.03 AS DOUBLE)) AS BIGINT)))""", body="""
SELECT count(CASE WHEN score >= t AND is_fraud = 1 THEN 1 END) AS tp,
       count(CASE WHEN score >= t AND is_fraud = 0 THEN 1 END) AS fp,
       count(CASE WHEN score < t AND is_fraud = 1 THEN 1 END) AS fn,
       count(CASE WHEN score < t AND is_fraud = 0 THEN 1 END) AS tn,
       round(CAST(count(CASE WHEN score >= t AND is_fraud = 1 THEN 1 END) AS DOUBLE)
             / count(CASE WHEN is_fraud = 1 THEN 1 END), 4) AS recall,
       round(CAST(count(CASE WHEN score >= t AND is_fraud = 1 THEN 1 END) AS DOUBLE)
             / count(CASE WHEN score >= t THEN 1 END), 4) AS precision,
       round(CAST(count(CASE WHEN score >= t AND is_fraud = 0 THEN 1 END) AS DOUBLE)
             / count(CASE WHEN score >= t THEN 1 END), 4) AS false_discovery_share
FROM txn, th
"""))
def q_confusion_at_threshold(spark, sf_dir):
    """Confusion counts, recall, precision, false discovery share at the 3 % review threshold."""
    t = txn(spark, sf_dir)
    thr, _ = ranking.review_threshold(t, 0.03)
    return ranking.confusion_at_threshold(t, thr)


# stand-in model outputs: the bound score, the raw uniform draw, and a monotone
# transform of the amount (three scorers to compare on the same rows)
_MODELS = {"champion": "score", "uniform": "u", "amount": "amt / (1 + amt)"}


def _models_long_sql() -> str:
    return "ml AS (" + "\nUNION ALL\n".join(
        f"SELECT '{m}' AS model, txn_id, is_fraud, CAST({e} AS DOUBLE) AS score FROM txn"
        for m, e in _MODELS.items()) + ")"


@register("model_comparison", with_txn(_models_long_sql(), """mst AS (
  SELECT model, score, count(*) AS n, sum(is_fraud) AS pos FROM ml GROUP BY model, score),
mc AS (SELECT model, score, pos, n, n - pos AS neg,
         sum(n - pos) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum,
         sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos_cum,
         sum(n) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_cum
       FROM mst),
maa AS (SELECT model, sum(pos * (neg_cum - neg + neg / CAST(2 AS DOUBLE))) / (sum(pos) * sum(neg)) AS auc,
               sum(CASE WHEN pos > 0 THEN pos * (CAST(pos_cum AS DOUBLE) / n_cum) ELSE 0 END) / sum(pos) AS ap,
               CAST(sum(n) AS BIGINT) AS n_rows
        FROM mc GROUP BY model),
mrk AS (SELECT model, is_fraud, row_number() OVER (PARTITION BY model ORDER BY score DESC, txn_id) AS rn,
               count(*) OVER (PARTITION BY model) AS n_all, sum(is_fraud) OVER (PARTITION BY model) AS p_all FROM ml),
mfd AS (SELECT model,
          CAST(sum(CASE WHEN rn <= greatest(1, CAST(floor(n_all * CAST(0.03 AS DOUBLE)) AS BIGINT)) THEN is_fraud ELSE 0 END) AS DOUBLE) / any_value(p_all) AS f3,
          CAST(sum(CASE WHEN rn <= greatest(1, CAST(floor(n_all * CAST(0.05 AS DOUBLE)) AS BIGINT)) THEN is_fraud ELSE 0 END) AS DOUBLE) / any_value(p_all) AS f5
        FROM mrk GROUP BY model)""", body="""
SELECT maa.model, round(auc, 4) AS roc_auc, round(ap, 4) AS pr_auc, round(f3, 4) AS fdr_at_3pct,
       round(f5, 4) AS fdr_at_5pct, n_rows
FROM maa JOIN mfd ON maa.model = mfd.model
"""))
def q_model_comparison(spark, sf_dir):
    """Headline metrics for three scorers of the same rows, from one long table."""
    t = txn(spark, sf_dir)
    long = None
    for m, e in _MODELS.items():
        part = t.select(F.lit(m).alias("model"), "txn_id", "is_fraud", F.expr(e).cast("double").alias("score"))
        long = part if long is None else long.unionByName(part)
    return ranking.model_comparison(long)


@register("top_k_by_score", with_txn(body="""
SELECT txn_id, score FROM txn ORDER BY score DESC, txn_id LIMIT 100
"""))
def q_top_k_by_score(spark, sf_dir):
    """The 100 highest-scored transactions (a top-k report), ties by id."""
    return ranking.top_k_by_score(txn(spark, sf_dir), 100).select("txn_id", "score")


@register("nlargest", with_txn(body="""
SELECT txn_id, amt FROM txn WHERE is_fraud = 0 AND score < 0.15 ORDER BY amt DESC, txn_id LIMIT 3
"""))
def q_nlargest(spark, sf_dir):
    """The 3 largest amounts among low-score legitimate rows (a top-k report)."""
    t = txn(spark, sf_dir).filter((F.col("is_fraud") == 0) & (F.col("score") < 0.15))
    return t.orderBy(F.desc("amt"), "txn_id").limit(3).select("txn_id", "amt")
