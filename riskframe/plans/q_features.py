"""Feature-engineering and binding queries (survey 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.numeric import rnd
from riskframe.functions import features as fx
from riskframe.plans.catalog import register
from riskframe.plans.oracle import FEAT_CTE, with_txn
from riskframe.sources.tables import txn


@register("build_features", with_txn(FEAT_CTE, body="""
SELECT txn_id, round(amt_log, 6) AS amt_log, uid_card_email, round(tx_hour, 6) AS tx_hour,
       tx_dayofweek, tx_day
FROM feat
"""))
def q_build_features(spark, sf_dir):
    """log1p amount, card-email key, hour fraction, weekday proxy, day number for every row."""
    f = fx.build_features(txn(spark, sf_dir))
    return f.select("txn_id", rnd("amt_log", 6).alias("amt_log"), "uid_card_email",
                    rnd("tx_hour", 6).alias("tx_hour"), "tx_dayofweek", "tx_day")


@register("detect_categoricals", with_txn(FEAT_CTE, body="""
SELECT 'product' AS "column", count(DISTINCT product) AS n_distinct FROM feat
UNION ALL SELECT 'email', count(DISTINCT email) FROM feat
UNION ALL SELECT 'device', count(DISTINCT device) FROM feat
UNION ALL SELECT 'uid_card_email', count(DISTINCT uid_card_email) FROM feat
"""))
def q_detect_categoricals(spark, sf_dir):
    """String-typed feature columns found from the schema (id and target excluded),
    with their distinct non-missing counts in one pass."""
    f = fx.build_features(txn(spark, sf_dir))
    cats = fx.categorical_columns(f)
    wide = f.agg(*[F.countDistinct(c).alias(c) for c in cats])
    return wide.unpivot([], cats, "column", "n_distinct")
