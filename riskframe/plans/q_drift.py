"""Drift queries (survey 2.10): train split = reference, val split = current."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.numeric import rnd
from riskframe.functions import features as fx
from riskframe.functions.codes import psi_label
from riskframe.operators import drift as dr
from riskframe.operators import split as sp
from riskframe.plans.catalog import register
from riskframe.plans.oracle import FEAT_CTE, mean_half_up_sql, with_txn
from riskframe.sources.tables import txn

FEATURES = ["amt", "amt_log", "dist1", "tx_hour", "tx_dayofweek", "card_id"]
PROBS_SQL = "[" + ", ".join(f"CAST({i / 10} AS DOUBLE)" for i in range(1, 10)) + "]"

SPLITF_CTE = FEAT_CTE + """,
rankf AS (SELECT feat.*, row_number() OVER (ORDER BY dt, txn_id) AS rn_dt, count(*) OVER () AS n_all FROM feat),
sf AS (SELECT rankf.*, CASE WHEN rn_dt <= CAST(floor(n_all * (1 - CAST(0.2 AS DOUBLE))) AS BIGINT)
                     THEN 'train' ELSE 'val' END AS split FROM rankf),
tr AS (SELECT * FROM sf WHERE split = 'train'),
va AS (SELECT * FROM sf WHERE split = 'val')"""


def _long_sql(src: str, feats: list[str], keep_null: bool = False) -> str:
    body = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {src}" for c in feats)
    return body if keep_null else f"SELECT * FROM ({body}) WHERE v IS NOT NULL"


def _psi_ctes(feats: list[str], ref: str = "tr", cur: str = "va", p: str = "") -> str:
    return f"""{p}ref_l AS ({_long_sql(ref, feats)}),
{p}cur_l AS ({_long_sql(cur, feats)}),
{p}edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, {PROBS_SQL}))) AS e
          FROM {p}ref_l GROUP BY feature),
{p}both_l AS (SELECT feature, v, 1 AS r, 0 AS c FROM {p}ref_l UNION ALL SELECT feature, v, 0, 1 FROM {p}cur_l),
{p}binned AS (SELECT b.feature, len(list_filter(ed.e, lambda x: x <= b.v)) AS bin, r, c
           FROM {p}both_l b JOIN {p}edges ed ON b.feature = ed.feature),
{p}counts AS (SELECT feature, bin, CAST(sum(r) AS DOUBLE) AS rc, CAST(sum(c) AS DOUBLE) AS cc
           FROM {p}binned GROUP BY feature, bin),
{p}allb AS (SELECT feature, unnest(range(0, len(e) + 1)) AS bin, len(e) + 1 AS n_bins FROM {p}edges),
{p}fullb AS (SELECT a.feature, a.bin, a.n_bins, coalesce(k.rc, 0) AS rc, coalesce(k.cc, 0) AS cc
          FROM {p}allb a LEFT JOIN {p}counts k ON a.feature = k.feature AND a.bin = k.bin),
{p}tot AS (SELECT feature, n_bins, sum(rc) AS n_ref, sum(cc) AS n_cur FROM {p}fullb GROUP BY feature, n_bins),
{p}pj AS (SELECT f.feature, f.n_bins, t.n_ref, t.n_cur,
             (f.rc + 1e-4) / (t.n_ref + 1e-4 * f.n_bins) AS rp, (f.cc + 1e-4) / (t.n_cur + 1e-4 * f.n_bins) AS cp
          FROM {p}fullb f JOIN {p}tot t ON f.feature = t.feature AND f.n_bins = t.n_bins),
{p}psi AS (SELECT feature, n_bins, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur,
              CASE WHEN n_ref = 0 OR n_cur = 0 THEN NULL WHEN n_bins + 1 < 3 THEN 0.0
                   ELSE sum((cp - rp) * ln(cp / rp)) END AS psi
           FROM {p}pj GROUP BY feature, n_bins, n_ref, n_cur)"""


_LABEL_SQL = """CASE WHEN {x} IS NULL OR isnan({x}) THEN 'unknown' WHEN {x} < 0.10 THEN 'stable'
     WHEN {x} < 0.20 THEN 'moderate_drift' ELSE 'significant_drift' END"""


def _ks_ctes(ref: str, cur: str, p: str) -> str:
    return f"""{p}kc AS (SELECT v, CAST(sum(r) AS BIGINT) AS rc, CAST(sum(c) AS BIGINT) AS cc FROM (
    SELECT CAST(score AS DOUBLE) AS v, 1 AS r, 0 AS c FROM {ref} WHERE score IS NOT NULL
    UNION ALL SELECT CAST(score AS DOUBLE), 0, 1 FROM {cur} WHERE score IS NOT NULL) GROUP BY v),
{p}kcum AS (SELECT v, sum(rc) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rcum,
                 sum(cc) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ccum,
                 sum(rc) OVER () AS n_ref, sum(cc) OVER () AS n_cur FROM {p}kc),
{p}ks AS (SELECT max(abs(rcum / n_ref - ccum / n_cur)) AS d, any_value(n_ref) AS n_ref, any_value(n_cur) AS n_cur
        FROM {p}kcum),
{p}ksz AS (SELECT d, sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) * d AS z FROM {p}ks),
{p}ksp AS (SELECT d, CASE WHEN z < 0.03 THEN 1.0 ELSE least(1.0, greatest(0.0, 2.0 * (
             SELECT sum(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * z * z))
             FROM range(1, 101) t(k)))) END AS p FROM {p}ksz)"""


def _score_report_sql(ref: str, cur: str, window: str, p: str) -> tuple[str, str]:
    ctes = _psi_ctes(["score"], ref, cur, p) + ",\n" + _ks_ctes(ref, cur, p) + f""",
{p}st AS (SELECT (SELECT avg(score) FROM {ref}) AS rm, (SELECT avg(score) FROM {cur}) AS cm,
              (SELECT quantile_cont(score, 0.95) FROM {ref}) AS rq,
              (SELECT quantile_cont(score, 0.95) FROM {cur}) AS cq)"""
    body = f"""SELECT '{window}' AS "window", round(ps.psi, 5) AS psi, {_LABEL_SQL.format(x='ps.psi')} AS psi_label,
       round(k.d, 5) AS ks_statistic, round(k.p, 6) AS p_value, (k.d > 0.05 AND k.p < 0.05) AS drift_detected,
       round(st.rm, 5) AS ref_mean_score, round(st.cm, 5) AS cur_mean_score,
       round(st.rq, 5) AS ref_p95_score, round(st.cq, 5) AS cur_p95_score,
       (ps.psi >= 0.20 OR (k.d > 0.05 AND k.p < 0.05)) AS action_required
FROM {p}psi ps, {p}ksp k, {p}st st"""
    return ctes, body


def split_rows(spark, sf_dir):
    """All rows with their split and _ref (true for train): both sides in one scan."""
    s = sp.time_split(fx.build_features(txn(spark, sf_dir)), val_frac=0.2)
    return s.withColumn("_ref", F.col("split") == "train")


def splits(spark, sf_dir):
    s = split_rows(spark, sf_dir).drop("_ref")
    return s.filter(F.col("split") == "train"), s.filter(F.col("split") == "val")


@register("quantile_edges", with_txn(SPLITF_CTE, _psi_ctes(FEATURES), body="""
SELECT feature, CAST(i AS INTEGER) AS edge_idx, round(e[i + 1], 6) AS edge
FROM (SELECT feature, e, unnest(range(0, len(e))) AS i FROM edges)
"""))
def q_quantile_edges(spark, sf_dir):
    """Reference decile edges per feature (exact, linear interpolation, de-duplicated)."""
    e = dr.feature_bins(split_rows(spark, sf_dir), FEATURES).filter("n_ref > 0")
    return e.select("feature", F.posexplode("edges").alias("edge_idx", "edge")).select(
        "feature", "edge_idx", rnd("edge", 6).alias("edge"))


@register("bin_counts", with_txn(SPLITF_CTE, _psi_ctes(FEATURES), body="""
SELECT feature, CAST(bin AS INTEGER) AS bin, CAST(rc AS BIGINT) AS ref_count, CAST(cc AS BIGINT) AS cur_count
FROM fullb
"""))
def q_bin_counts(spark, sf_dir):
    """Reference and current counts in every reference-decile bin (empty bins included)."""
    t = dr.feature_bins(split_rows(spark, sf_dir), FEATURES).filter("n_ref > 0")
    return t.select("feature", F.posexplode("bins").alias("bin", "_c")).select(
        "feature", "bin", F.col("_c.rc").alias("ref_count"), F.col("_c.cc").alias("cur_count"))


@register("psi", with_txn(SPLITF_CTE, _psi_ctes(FEATURES), body="""
SELECT feature, round(psi, 5) AS psi, n_ref, n_cur, CAST(n_bins AS INTEGER) AS n_bins FROM psi
"""))
def q_psi(spark, sf_dir):
    """PSI per feature, train vs val, epsilon on counts."""
    return dr.psi_of(split_rows(spark, sf_dir), FEATURES).withColumn("psi", rnd("psi", 5))


@register("psi_label", with_txn(SPLITF_CTE, _psi_ctes(FEATURES), body=f"""
SELECT feature, {_LABEL_SQL.format(x='psi')} AS stability FROM psi
"""))
def q_psi_label(spark, sf_dir):
    """Stability label of each feature's PSI: stable, moderate_drift, significant_drift, unknown."""
    return dr.psi_of(split_rows(spark, sf_dir), FEATURES).select("feature", psi_label(F.col("psi")).alias("stability"))


_MEANS_CTE = f"""rs AS (
  SELECT feature, avg(v) AS ref_mean, {mean_half_up_sql('v', 4)} AS ref_mean4,
         avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS ref_miss
  FROM ({_long_sql('tr', FEATURES, True)}) GROUP BY feature),
cs AS (
  SELECT feature, avg(v) AS cur_mean, {mean_half_up_sql('v', 4)} AS cur_mean4,
         avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS cur_miss
  FROM ({_long_sql('va', FEATURES, True)}) GROUP BY feature)"""
_FEATURE_BODY = f"""
SELECT rs.feature, round(p.psi, 5) AS psi, {_LABEL_SQL.format(x='p.psi')} AS stability,
       ref_mean4 AS ref_mean, cur_mean4 AS cur_mean,
       round((cur_mean - ref_mean) / (abs(ref_mean) + 1e-8) * 100, 2) AS mean_shift_pct,
       round(CAST(ref_miss AS DOUBLE) * 100, 1) AS ref_missing_pct,
       round(CAST(cur_miss AS DOUBLE) * 100, 1) AS cur_missing_pct
FROM rs JOIN cs ON rs.feature = cs.feature LEFT JOIN psi p ON rs.feature = p.feature
"""


@register("feature_psi_report", with_txn(SPLITF_CTE, _psi_ctes(FEATURES), _MEANS_CTE, body=_FEATURE_BODY))
def q_feature_psi_report(spark, sf_dir):
    """Per feature: psi, stability, means, mean shift %, missing % (train vs val)."""
    return dr.feature_report_of(split_rows(spark, sf_dir), FEATURES)


@register("ks_two_sample", with_txn(SPLITF_CTE, _ks_ctes("tr", "va", ""), body="""
SELECT round(d, 5) AS ks_statistic, round(p, 6) AS p_value, (d > 0.05 AND p < 0.05) AS drift_detected FROM ksp
"""))
def q_ks_two_sample(spark, sf_dir):
    """Two-sample KS on the score, train vs val: D, asymptotic p, drift flag."""
    tr, va = splits(spark, sf_dir)
    return dr.ks_test(tr, va, "score")


@register("ks_two_sample_auto")
def q_ks_two_sample_auto(spark, sf_dir):
    """Two-sample KS on the score, train vs val, with the exact p-value for small samples."""
    tr, va = splits(spark, sf_dir)
    return dr.ks_test_auto(tr, va, "score")


_SR_CTES, _SR_BODY = _score_report_sql("tr", "va", "val (deployment)", "s_")


@register("score_drift_report", with_txn(SPLITF_CTE, _SR_CTES, body=_SR_BODY))
def q_score_drift_report(spark, sf_dir):
    """Score PSI, KS, means, p95s and action flag, train vs val."""
    return dr.score_drift_of(split_rows(spark, sf_dir), "score", "val (deployment)")


_HALF_CTE = """vh AS (SELECT va.*, row_number() OVER (ORDER BY dt, txn_id) AS rn_h, count(*) OVER () AS n_v FROM va),
early AS (SELECT * FROM vh WHERE rn_h <= n_v // 2),
late AS (SELECT * FROM vh WHERE rn_h > n_v // 2)"""
_LR_CTES, _LR_BODY = _score_report_sql("early", "late", "late val", "l_")


_SCORE_COLS = """SELECT "window", 'score' AS feature, psi, psi_label, ks_statistic, p_value, drift_detected,
  ref_mean_score AS ref_mean, cur_mean_score AS cur_mean, ref_p95_score AS ref_p95, cur_p95_score AS cur_p95, action_required,
  CAST(NULL AS DOUBLE) AS mean_shift_pct, CAST(NULL AS DOUBLE) AS ref_missing_pct, CAST(NULL AS DOUBLE) AS cur_missing_pct"""


@register("deployment_drift", with_txn(
    SPLITF_CTE, _HALF_CTE, _SR_CTES, _LR_CTES, _psi_ctes(FEATURES), _MEANS_CTE,
    f"sc AS ({_SR_BODY} UNION ALL {_LR_BODY})", f"fr AS ({_FEATURE_BODY})", body=f"""{_SCORE_COLS} FROM sc
UNION ALL SELECT 'val (deployment)', feature, psi, stability, NULL, NULL, NULL, ref_mean, cur_mean, NULL, NULL, NULL,
  mean_shift_pct, ref_missing_pct, cur_missing_pct FROM fr"""))
def q_deployment_drift(spark, sf_dir):
    """The deployment drift job: score drift train vs val and early vs late val (halves by time
    order), and the feature report train vs val, one row each."""
    rows = split_rows(spark, sf_dir)
    h = sp.half_split(rows.filter("NOT _ref")).withColumn("_ref", F.col("half") == "early")
    scores = (dr.score_drift_of(rows, "score", "val (deployment)")
              .unionByName(dr.score_drift_of(h, "score", "late val")))
    scores = scores.withColumnsRenamed({f"{side}_{x}_score": f"{side}_{x}" for side in ("ref", "cur") for x in ("mean", "p95")})
    features = dr.feature_report_of(rows, FEATURES).withColumnRenamed("stability", "psi_label")
    return scores.withColumn("feature", F.lit("score")).unionByName(
        features.withColumn("window", F.lit("val (deployment)")), allowMissingColumns=True)


@register("drift_summary", with_txn(SPLITF_CTE, _psi_ctes(FEATURES), """ranked_psi AS (
  SELECT feature, round(psi, 5) AS p5, row_number() OVER (ORDER BY round(psi, 5) DESC NULLS LAST, feature) AS r
  FROM psi)""", body="""
SELECT count(*) AS n_features,
       count(CASE WHEN psi >= 0.20 THEN 1 END) AS n_significant,
       count(CASE WHEN psi >= 0.10 AND psi < 0.20 THEN 1 END) AS n_moderate,
       (SELECT string_agg(feature, ',' ORDER BY r) FROM ranked_psi WHERE r <= 10) AS top_features
FROM psi
"""))
def q_drift_summary(spark, sf_dir):
    """Number of significant / moderate features and the 10 highest-PSI features in order."""
    return dr.drift_summary(dr.psi_of(split_rows(spark, sf_dir), FEATURES))


@register("policy_ks_level", with_txn(SPLITF_CTE, _ks_ctes("tr", "va", ""), body="""
SELECT round(d, 5) AS ks_statistic, round(p, 6) AS p_value,
       CASE WHEN d > 0.10 AND p < 0.01 THEN 'escalate' WHEN d > 0.05 AND p < 0.05 THEN 'flag'
            ELSE 'none' END AS ks_level
FROM ksp
"""))
def q_policy_ks_level(spark, sf_dir):
    """Monitoring policy on KS: D>.05 and p<.05 flag; D>.10 and p<.01 escalate."""
    tr, va = splits(spark, sf_dir)
    return dr.ks_policy(dr.ks_test_raw(tr, va, "score"))
