"""Split queries (survey 2.3, 2.5, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import split as sp
from riskframe.plans.catalog import register
from riskframe.plans.oracle import with_txn
from riskframe.sources.tables import txn

SPLIT_CTE = """ranked_dt AS (
  SELECT txn.*, row_number() OVER (ORDER BY dt, txn_id) AS rn_dt, count(*) OVER () AS n_all
  FROM txn),
splitted AS (
  SELECT ranked_dt.*,
         CASE WHEN rn_dt <= CAST(floor(n_all * (1 - CAST(0.2 AS DOUBLE))) AS BIGINT)
              THEN 'train' ELSE 'val' END AS split
  FROM ranked_dt)"""


def split_txn(spark, sf_dir):
    return sp.time_split(txn(spark, sf_dir), val_frac=0.2)


@register("time_split", with_txn(SPLIT_CTE, body="SELECT txn_id, split FROM splitted"))
def q_time_split(spark, sf_dir):
    """First int(0.8 n) rows by (dt, txn_id) are train, the rest val."""
    return split_txn(spark, sf_dir).select("txn_id", "split")


@register("split_report", with_txn(SPLIT_CTE, body="""
SELECT count(CASE WHEN split = 'train' THEN 1 END) AS train_rows,
       count(CASE WHEN split = 'val' THEN 1 END) AS val_rows,
       CAST(coalesce(sum(CASE WHEN split = 'train' THEN is_fraud END), 0) AS BIGINT) AS train_fraud,
       CAST(coalesce(sum(CASE WHEN split = 'val' THEN is_fraud END), 0) AS BIGINT) AS val_fraud,
       max(CASE WHEN split = 'train' THEN dt END) AS train_max_dt,
       min(CASE WHEN split = 'val' THEN dt END) AS val_min_dt,
       round(CAST(sum(CASE WHEN split = 'train' THEN is_fraud END) AS DOUBLE)
             / count(CASE WHEN split = 'train' THEN 1 END), 4) AS train_fraud_rate,
       round(CAST(sum(CASE WHEN split = 'val' THEN is_fraud END) AS DOUBLE)
             / count(CASE WHEN split = 'val' THEN 1 END), 4) AS val_fraud_rate,
       max(CASE WHEN split = 'train' THEN dt END) <= min(CASE WHEN split = 'val' THEN dt END) AS no_leakage
FROM splitted
"""))
def q_split_report(spark, sf_dir):
    """Rows, fraud counts and rates per side, boundary dts, leakage flag."""
    return sp.split_report(split_txn(spark, sf_dir))


@register("half_split", with_txn(SPLIT_CTE, """halves AS (
  SELECT txn_id, row_number() OVER (ORDER BY dt, txn_id) AS rn_h, count(*) OVER () AS n_v
  FROM splitted WHERE split = 'val')""", body="""
SELECT txn_id, CASE WHEN rn_h <= n_v // 2 THEN 'early' ELSE 'late' END AS half FROM halves
"""))
def q_half_split(spark, sf_dir):
    """Validation rows: the first n//2 by (dt, txn_id) are early, the rest late."""
    val = split_txn(spark, sf_dir).filter(F.col("split") == "val").drop("split")
    return sp.half_split(val).select("txn_id", "half")


@register("split_overlap_check", with_txn(SPLIT_CTE, body="""
SELECT count(*) AS n_shared FROM (SELECT txn_id FROM splitted WHERE split = 'train') a
WHERE txn_id IN (SELECT txn_id FROM splitted WHERE split = 'val')
"""))
def q_split_overlap(spark, sf_dir):
    """Ids present in both train and val (left semi join); zero for a valid split."""
    return sp.split_overlap(split_txn(spark, sf_dir))


_BOUND = """bnd AS (SELECT max(dt) AS b FROM splitted WHERE split = 'train')"""


@register("boundary_filter", with_txn(SPLIT_CTE, _BOUND, body="""
SELECT t.txn_id, CASE WHEN t.dt <= bnd.b THEN 'train' ELSE 'val' END AS side
FROM txn t, bnd
"""))
def q_boundary_filter(spark, sf_dir):
    """Raw train/val rebuilt from the train boundary dt (dt <= b, dt > b)."""
    s = split_txn(spark, sf_dir)
    b = s.filter(F.col("split") == "train").agg(F.max("dt")).first()[0]
    t = txn(spark, sf_dir)
    tr = sp.boundary_filter(t, b, "train").select("txn_id", F.lit("train").alias("side"))
    va = sp.boundary_filter(t, b, "val").select("txn_id", F.lit("val").alias("side"))
    return tr.unionByName(va)


@register("union_history", with_txn(SPLIT_CTE, _BOUND, body="""
SELECT txn_id, dt, amt, card_id FROM txn, bnd WHERE dt <= bnd.b
UNION ALL
SELECT txn_id, dt, amt, card_id FROM txn, bnd WHERE dt > bnd.b
"""))
def q_union_history(spark, sf_dir):
    """Raw train rows and raw val rows concatenated by column name."""
    s = split_txn(spark, sf_dir)
    b = s.filter(F.col("split") == "train").agg(F.max("dt")).first()[0]
    t = txn(spark, sf_dir).select("txn_id", "dt", "amt", "card_id")
    return sp.union_history(sp.boundary_filter(t, b, "train"), sp.boundary_filter(t, b, "val"))
