"""Explanation queries on the linear scorecard (survey 2.13, E rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import codes
from riskframe.functions.numeric import rnd
from riskframe.operators import explain as ex
from riskframe.plans.catalog import register
from riskframe.plans.oracle import mean_half_up_sql, reason_code_sql, reason_text_sql, with_txn
from riskframe.plans.q_drift import SPLITF_CTE, splits
from riskframe.sources.tables import table

FEATURES = ["amt_log", "dist1", "tx_hour", "tx_dayofweek", "card_id"]
NAMES = ex.source_names(FEATURES)

_SC = "sc AS (SELECT " + ", ".join(
    f"round(corr(CAST({f} AS DOUBLE), CAST(is_fraud AS DOUBLE)) / stddev_pop(CAST({f} AS DOUBLE)), 8) AS w_{f}, "
    f"{mean_half_up_sql(f, 8)} AS m_{f}" for f in FEATURES
) + ", round(ln(avg(CAST(is_fraud AS DOUBLE)) / (1 - avg(CAST(is_fraud AS DOUBLE)))), 8) AS b0 FROM tr)"

_CONTRIB = "ctb AS (SELECT va.txn_id, " + ", ".join(
    f"CAST({f} AS DOUBLE) AS x_{f}, coalesce(w_{f} * (CAST({f} AS DOUBLE) - m_{f}), 0.0) AS c_{f}"
    for f in FEATURES) + ", b0 FROM va, sc)"

_LONG = "cl AS (" + "\nUNION ALL\n".join(
    f"SELECT txn_id, {i} AS idx, '{n}' AS feature, x_{f} AS feature_value, c_{f} AS c FROM ctb"
    for i, (f, n) in enumerate(zip(FEATURES, NAMES))) + ")"

_TOP = """tp AS (SELECT * FROM (
    SELECT cl.*, row_number() OVER (PARTITION BY txn_id ORDER BY abs(c) DESC, idx) AS rank FROM cl) WHERE rank <= 4),
tpc AS (SELECT tp.*, """ + reason_code_sql("feature") + """ AS reason_code FROM tp)"""

BASE = [SPLITF_CTE, _SC, _CONTRIB, _LONG]


def scored_val(spark, sf_dir):
    tr, va = splits(spark, sf_dir)
    card = ex.fit_scorecard(tr, FEATURES)
    return ex.contributions(va, card, FEATURES)


@register("contrib_linear", with_txn(*BASE, body="""
SELECT txn_id, feature, round(c, 6) + 0.0 AS contribution FROM cl
"""))
def q_contrib_linear(spark, sf_dir):
    """Additive log-odds contributions w*(x - mean) of every val row and feature (long form)."""
    long = ex.contributions_long(scored_val(spark, sf_dir), FEATURES)
    return long.select("txn_id", "feature", rnd("contribution", 6).alias("contribution"))


@register("score_batch", with_txn(*BASE, body="""
SELECT txn_id, round(1 / (1 + exp(-(b0 + """ + " + ".join(f"c_{f}" for f in FEATURES) + """))), 6) AS probability
FROM ctb
"""))
def q_score_batch(spark, sf_dir):
    """Scorecard probability for every val row: sigmoid(b0 + sum of contributions)."""
    s = scored_val(spark, sf_dir)
    return s.select("txn_id", rnd(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin"))), 6).alias("probability"))


@register("top_reasons", with_txn(*BASE, _TOP, body=f"""
SELECT txn_id, CAST(rank AS INTEGER) AS rank, feature, round(feature_value, 6) AS feature_value,
       round(c, 5) + 0.0 AS contribution,
       CASE WHEN c > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction,
       reason_code, {reason_text_sql('reason_code')} AS reason_text
FROM tpc
"""))
def q_top_reasons(spark, sf_dir):
    """Four largest |contributions| per val row with value, direction, code and text."""
    tr = ex.top_reasons(scored_val(spark, sf_dir), FEATURES, 4)
    return tr.withColumn("feature_value", rnd("feature_value", 6))


@register("top_n_per_row", with_txn(*BASE, _TOP, body="""
SELECT txn_id, CAST(rank AS INTEGER) AS rank, feature FROM tpc WHERE rank <= 3
"""))
def q_top_n_per_row(spark, sf_dir):
    """Three largest |contributions| within each row, ranked (array sort, no shuffle)."""
    return ex.top_reasons(scored_val(spark, sf_dir), FEATURES, 3).select("txn_id", "rank", "feature")


@register("reason_codes_dedup", with_txn(*BASE, _TOP, """fr AS (
  SELECT txn_id, reason_code, min(rank) AS r FROM tpc GROUP BY txn_id, reason_code)""", body="""
SELECT txn_id, string_agg(reason_code, ',' ORDER BY r) AS reason_codes FROM fr GROUP BY txn_id
"""))
def q_reason_codes_dedup(spark, sf_dir):
    """Distinct reason codes of the top four reasons, in rank order."""
    return ex.reason_codes_dedup(scored_val(spark, sf_dir), FEATURES, 4)


@register("adverse_codes", with_txn(*BASE, _TOP, """pos AS (
  SELECT * FROM tpc WHERE round(c, 5) > 0),
fa AS (SELECT txn_id, reason_code, min(rank) AS r FROM pos GROUP BY txn_id, reason_code)""", body=f"""
SELECT fa.txn_id, fa.reason_code AS code, {reason_text_sql('fa.reason_code')} AS description,
       p.feature AS driven_by_feature, CAST(fa.r AS INTEGER) AS rank
FROM fa JOIN pos p ON fa.txn_id = p.txn_id AND fa.r = p.rank
"""))
def q_adverse_codes(spark, sf_dir):
    """Adverse-action codes: positive reasons among the top four, distinct, with driving feature."""
    return ex.adverse_codes(scored_val(spark, sf_dir), FEATURES, 4)


@register("global_importance", with_txn(*BASE, body="""
SELECT feature, round(avg(abs(c)), 6) AS mean_abs_contribution FROM cl GROUP BY feature
"""))
def q_global_importance(spark, sf_dir):
    """Mean absolute contribution per feature over the val rows."""
    g = ex.global_importance(scored_val(spark, sf_dir), FEATURES)
    return g.select("feature", rnd("mean_abs_contribution", 6).alias("mean_abs_contribution"))


@register("reason_coverage", with_txn(*BASE, f"""gi AS (SELECT feature, avg(abs(c)) AS m FROM cl GROUP BY feature),
top_f AS (SELECT feature FROM gi ORDER BY m DESC, feature LIMIT 20)""", body=f"""
SELECT feature, {reason_code_sql('feature')} AS reason_code,
       {reason_text_sql(reason_code_sql('feature'))} AS reason_text
FROM top_f
"""))
def q_reason_coverage(spark, sf_dir):
    """The 20 most important features with their reason code and text."""
    return ex.reason_coverage(ex.global_importance(scored_val(spark, sf_dir), FEATURES), 20)


@register("join_code_text", with_txn(*BASE, _TOP, """dict(code, description) AS (VALUES """ + ", ".join(
    "('{}', '{}')".format(k, v) for k, v in codes.REASON_CODES.items()) + ")", body="""
SELECT d.code, d.description, count(*) AS n_reasons
FROM tpc JOIN dict d ON tpc.reason_code = d.code GROUP BY d.code, d.description
"""))
def q_join_code_text(spark, sf_dir):
    """Reason codes of the top reasons joined to the code dictionary (broadcast, 15 rows)."""
    tr = ex.top_reasons(scored_val(spark, sf_dir), FEATURES, 4)
    dic = spark.createDataFrame(list(codes.REASON_CODES.items()), "code string, description string")
    return (tr.join(F.broadcast(dic), tr.reason_code == dic.code)
              .groupBy("code", "description").agg(F.count(F.lit(1)).alias("n_reasons")))


_PREFIXES = ["V", "C", "D", "M", "id_", "card", "dist", "addr"]


@register("reason_code", with_txn("""nm AS (SELECT DISTINCT
    concat(""" + "[" + ", ".join(f"'{p}'" for p in _PREFIXES) + """][k % 8 + 1],
           CASE WHEN k % 8 = 4 THEN lpad(CAST(k % 40 AS VARCHAR), 2, '0') ELSE CAST(k % 40 AS VARCHAR) END) AS feature
  FROM txn)""", body=f"""
SELECT feature, {reason_code_sql('feature')} AS reason_code FROM nm
"""))
def q_reason_code(spark, sf_dir):
    """Feature name -> reason code (direct map, ordered patterns, catch-all) over names
    formed from the events' k values."""
    ev = table(spark, sf_dir, "events").select(F.expr("cast(get_json_object(props, '$.k') as int)").alias("k"))
    pre = F.element_at(F.array(*[F.lit(p) for p in _PREFIXES]), (F.col("k") % 8) + 1)
    suf = F.when(F.col("k") % 8 == 4, F.lpad((F.col("k") % 40).cast("string"), 2, "0")).otherwise(
        (F.col("k") % 40).cast("string"))
    names = ev.select(F.concat(pre, suf).alias("feature")).distinct()
    return names.select("feature", codes.reason_code(F.col("feature")).alias("reason_code"))


@register("first_seen_dedupe", with_txn(*BASE, """tp6 AS (SELECT * FROM (
    SELECT cl.*, row_number() OVER (PARTITION BY txn_id ORDER BY abs(c) DESC, idx) AS rank FROM cl) WHERE rank <= 6),
fs6 AS (SELECT txn_id, """ + reason_code_sql("feature") + """ AS reason_code, min(rank) AS r FROM tp6
        GROUP BY txn_id, """ + reason_code_sql("feature") + ")", body="""
SELECT txn_id, string_agg(reason_code, ',' ORDER BY r) AS reason_codes FROM fs6 GROUP BY txn_id
"""))
def q_first_seen_dedupe(spark, sf_dir):
    """Distinct codes of all ranked reasons (top six) in first-seen rank order."""
    return ex.reason_codes_dedup(scored_val(spark, sf_dir), FEATURES, 6)
