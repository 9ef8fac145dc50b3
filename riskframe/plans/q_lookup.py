"""Lookups, history, bands, joins and selections (survey 2.2-2.4, 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import codes
from riskframe.functions import features as fx
from riskframe.functions.numeric import rnd
from riskframe.operators import history as hi
from riskframe.plans.catalog import register
from riskframe.plans.oracle import FEAT_CTE, mean_half_up_sql, with_txn
from riskframe.plans.q_split import SPLIT_CTE, split_txn
from riskframe.sources.tables import table, txn


def feat(spark, sf_dir):
    return fx.build_features(txn(spark, sf_dir))


_HIST_AGG = """count(*) AS n_transactions_in_window,
       round(sum(amt), 2) AS total_amount, """ + mean_half_up_sql("amt", 2) + """ AS mean_amount,
       round(max(amt), 2) AS max_amount, round(min(amt), 2) AS min_amount,
       array_to_string(list_sort(list_distinct(list(product))), ',') AS unique_products,
       array_to_string(list_slice(list_sort(list_distinct(list(email))), 1, 5), ',') AS unique_email_domains,
       array_to_string(list_sort(list_distinct(list(CAST(round_even(tx_hour, 0) AS INTEGER)))), ',') AS hours_active"""


@register("customer_history_all", with_txn(FEAT_CTE, """win AS (
  SELECT * FROM feat WHERE dt >= (SELECT max(dt) FROM feat) - 30 * 86400),
agg AS (SELECT card_id, """ + _HIST_AGG + """ FROM win GROUP BY card_id)""", body="""
SELECT c.card_id, coalesce(a.n_transactions_in_window, 0) AS n_transactions_in_window, a.total_amount,
       a.mean_amount, a.max_amount, a.min_amount, a.unique_products, a.unique_email_domains,
       a.hours_active, 30 AS lookback_days
FROM (SELECT DISTINCT card_id FROM feat) c LEFT JOIN agg a ON c.card_id = a.card_id
"""))
def q_customer_history_all(spark, sf_dir):
    """Every card's last-30-day statistics (count, sum, mean, max, min, products, domains, hours)."""
    return hi.customer_history_all(feat(spark, sf_dir), 30)


@register("customer_history", with_txn(FEAT_CTE, """win AS (
  SELECT * FROM feat WHERE dt >= (SELECT max(dt) FROM feat) - 7 * 86400),
pick AS (SELECT card_id AS c FROM feat ORDER BY score DESC, txn_id LIMIT 1)""", body="""
SELECT (SELECT c FROM pick) AS card_id, 7 AS lookback_days, """ + _HIST_AGG + """,
       CASE WHEN count(*) > 0 THEN NULL ELSE 'No transactions in the last 7 days.' END AS note
FROM win WHERE card_id = (SELECT c FROM pick)
"""))
def q_customer_history(spark, sf_dir):
    """One card (the card of the top-scored transaction): last-7-day statistics or a note."""
    f = feat(spark, sf_dir)
    card = f.orderBy(F.desc("score"), "txn_id").select("card_id").first()[0]
    return hi.customer_history(f, card, 7)


@register("lookback_filter", with_txn(body="""
SELECT txn_id, dt FROM txn WHERE dt >= (SELECT max(dt) FROM txn) - 7 * 86400
"""))
def q_lookback_filter(spark, sf_dir):
    """Rows in the last 7 days before the table's latest time."""
    return hi.lookback_filter(txn(spark, sf_dir), 7).select("txn_id", "dt")


@register("score_range", with_txn(body="""
SELECT txn_id, score FROM txn WHERE score BETWEEN 0.40 AND 0.70
"""))
def q_score_range(spark, sf_dir):
    """Rows with 0.40 <= score <= 0.70 (inclusive)."""
    return hi.score_range(txn(spark, sf_dir), 0.40, 0.70).select("txn_id", "score")


_DETAILS_SQL = """SELECT txn_id, round(amt, 4) AS amt, dt, product, card_id, email, round(dist1, 4) AS dist1,
       round(tx_hour, 4) AS tx_hour, tx_dayofweek, device, round(score, 4) AS fraud_score"""


@register("txn_details", with_txn(FEAT_CTE, body=_DETAILS_SQL + " FROM feat"))
def q_txn_details(spark, sf_dir):
    """Readable fields of every transaction, doubles rounded to 4, with the score."""
    return hi.txn_details(feat(spark, sf_dir))


@register("risk_band", with_txn(body="""
SELECT txn_id, CASE WHEN score >= 0.70 THEN 'high' WHEN score >= 0.40 THEN 'medium' ELSE 'low' END AS band,
       CASE WHEN score >= 0.70 THEN 'auto_decline' WHEN score >= 0.40 THEN 'escalate' ELSE 'auto_approve' END AS action
FROM txn
"""))
def q_risk_band(spark, sf_dir):
    """Score band (high >= .70, medium >= .40, low) and the band's action for every row."""
    t = txn(spark, sf_dir)
    band = codes.risk_band(F.col("score"))
    return t.select("txn_id", band.alias("band"), codes.risk_action(band).alias("action"))


@register("risk_action", with_txn(body="""
SELECT CASE WHEN score >= 0.70 THEN 'auto_decline' WHEN score >= 0.40 THEN 'escalate' ELSE 'auto_approve' END AS action,
       count(*) AS n
FROM txn GROUP BY 1
"""))
def q_risk_action(spark, sf_dir):
    """Row count per band action."""
    t = txn(spark, sf_dir)
    return (t.select(codes.risk_action(codes.risk_band(F.col("score"))).alias("action"))
             .groupBy("action").agg(F.count(F.lit(1)).alias("n")))


@register("join_identity", with_txn(body="""
SELECT e.event_id AS txn_id, c.c_custkey, c.c_nationkey
FROM events e LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') c
  ON e.user_id = c.c_custkey
"""))
def q_join_identity(spark, sf_dir):
    """Transactions left joined with the sparse identity side on the card key."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("txn_id"), "user_id")
    ident = (table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
             .select("c_custkey", "c_nationkey"))
    return ev.join(ident, ev.user_id == ident.c_custkey, "left").select("txn_id", "c_custkey", "c_nationkey")


@register("identity_mask", with_txn(body="""
SELECT txn_id, device IS NOT NULL AS has_identity FROM txn
"""))
def q_identity_mask(spark, sf_dir):
    """Has-identity flag: the first identity column is not null."""
    return txn(spark, sf_dir).select("txn_id", F.col("device").isNotNull().alias("has_identity"))


@register("join_labels_groups", with_txn(body="""
SELECT a.txn_id, a.is_fraud, b.score, c.device
FROM (SELECT txn_id, is_fraud FROM txn) a JOIN (SELECT txn_id, score FROM txn) b ON a.txn_id = b.txn_id
JOIN (SELECT txn_id, device FROM txn) c ON a.txn_id = c.txn_id
"""))
def q_join_labels_groups(spark, sf_dir):
    """Labels, scores and groups from separate frames combined by id (not by position)."""
    t = txn(spark, sf_dir)
    y = t.select("txn_id", "is_fraud")
    s = t.select("txn_id", "score")
    g = t.select("txn_id", "device")
    return y.join(s, "txn_id").join(g, "txn_id")


@register("lookup_txn", with_txn(SPLIT_CTE, """req AS (
  SELECT txn_id FROM txn UNION ALL SELECT card_id FROM txn)""", body="""
SELECT r.txn_id, v.amt, v.score, v.txn_id IS NOT NULL AS found
FROM req r LEFT JOIN (SELECT * FROM splitted WHERE split = 'val') v ON r.txn_id = v.txn_id
"""))
def q_lookup_txn(spark, sf_dir):
    """Batch lookup in the val split of every transaction id and of every card number
    read as an id (ids outside val are not found): found flag plus fields."""
    t = txn(spark, sf_dir)
    req = t.select("txn_id").unionByName(t.select(F.col("card_id").alias("txn_id")))
    val = split_txn(spark, sf_dir).filter(F.col("split") == "val").select("txn_id", "amt", "score")
    return hi.lookup_txn(req, val).select("txn_id", "amt", "score", "found")


@register("select_features", with_txn(body="""
SELECT dt, amt, card_id, product, k, u, score, email, dist1, device, CAST(is_fraud AS INTEGER) AS label FROM txn
"""))
def q_select_features(spark, sf_dir):
    """Feature matrix: all columns except id and target, plus the label as int."""
    t = txn(spark, sf_dir)
    cols = fx.select_features(t)
    return t.select(*cols, F.col("is_fraud").cast("int").alias("label"))


@register("select_available", with_txn(body="""
SELECT amt, dist1, device, 'dist2,V258' AS missing_features FROM txn
"""))
def q_select_available(spark, sf_dir):
    """Requested feature list intersected with the table's columns; the missing ones are
    reported in request order."""
    t = txn(spark, sf_dir)
    present, missing = fx.select_available(t, ["amt", "dist2", "dist1", "V258", "device"])
    return t.select(*present, F.lit(",".join(missing)).alias("missing_features"))


@register("join_scores", with_txn(SPLIT_CTE, body="""
SELECT v.txn_id, round(v.score, 4) AS score, t.amt, t.product
FROM (SELECT txn_id, score FROM splitted WHERE split = 'val') v JOIN txn t ON v.txn_id = t.txn_id
"""))
def q_join_scores(spark, sf_dir):
    """Scored val rows joined back to the raw rows by id."""
    val = split_txn(spark, sf_dir).filter(F.col("split") == "val").select("txn_id", "score")
    raw = txn(spark, sf_dir).select("txn_id", "amt", "product")
    return val.join(raw, "txn_id").select("txn_id", rnd("score", 4).alias("score"), "amt", "product")


@register("card_history_point_in_time", with_txn(body="""
SELECT txn_id, count(*) OVER w AS n_prior,
       CASE WHEN count(*) OVER w > 0 THEN round(sum(amt) OVER w, 2) END AS amount_prior
FROM txn
WINDOW w AS (PARTITION BY card_id ORDER BY dt RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING)
"""))
def q_card_history_point_in_time(spark, sf_dir):
    """For every transaction: the card's count and amount in the 30 days before it
    (excluding its own second), via running sums with window-start probes."""
    return hi.card_history_point_in_time(txn(spark, sf_dir), 30)
