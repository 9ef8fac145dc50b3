"""Monitoring: rolling windows, policy rules, what-if, triage, dossier, per-feature
queries, ordering and sorted reports (survey 2.2, 2.8, 2.10, 2.13, 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from riskframe.functions import codes
from riskframe.functions import features as fx
from riskframe.functions.numeric import rnd
from riskframe.operators import drift as dr
from riskframe.operators.combine import one_row
from riskframe.operators import explain as ex
from riskframe.operators import fairness as fa
from riskframe.operators import history as hi
from riskframe.operators import ordering as od
from riskframe.operators import policy as po
from riskframe.operators import ranking
from riskframe.operators import rolling as ro
from riskframe.operators import whatif as wi
from riskframe.plans.catalog import register
from riskframe.plans.oracle import FEAT_CTE, reason_code_sql, with_txn
from riskframe.plans.q_drift import FEATURES as DRIFT_FEATURES
from riskframe.plans.q_drift import SPLITF_CTE, _LABEL_SQL, _psi_ctes, _score_report_sql, split_rows, splits
from riskframe.plans.q_explain import _TOP, BASE
from riskframe.plans.q_explain import FEATURES as EXPLAIN_FEATURES
from riskframe.plans.q_fairness import PROXIES
from riskframe.session import shuffle_partitions
from riskframe.sources.tables import txn

# --- rolling 30-day windows -------------------------------------------------

_WIN = """wn AS (
  SELECT t.*, ((t.dt + 1704067200) - ((t.dt + 1704067200) % 604800)) - w.k * 604800 AS window_start
  FROM txn t, range(0, 5) w(k)
  WHERE ((t.dt + 1704067200) - ((t.dt + 1704067200) % 604800)) - w.k * 604800 + 2592000 > t.dt + 1704067200),
wst AS (SELECT window_start, score, count(*) AS n, sum(is_fraud) AS pos FROM wn GROUP BY window_start, score),
wc AS (SELECT window_start, score, pos, n, n - pos AS neg,
         sum(n - pos) OVER (PARTITION BY window_start ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum,
         sum(pos) OVER (PARTITION BY window_start ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos_cum,
         sum(n) OVER (PARTITION BY window_start ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_cum
       FROM wst),
waa AS (SELECT window_start, CAST(sum(n) AS BIGINT) AS n_rows, sum(pos) AS n_pos,
               sum(pos * (neg_cum - neg + neg / CAST(2 AS DOUBLE))) / (sum(pos) * sum(neg)) AS auc,
               sum(CASE WHEN pos > 0 THEN pos * (CAST(pos_cum AS DOUBLE) / n_cum) ELSE 0 END) / sum(pos) AS ap
        FROM wc GROUP BY window_start),
wrk AS (SELECT window_start, is_fraud, row_number() OVER (PARTITION BY window_start ORDER BY score DESC, txn_id) AS rn,
               count(*) OVER (PARTITION BY window_start) AS n_all, sum(is_fraud) OVER (PARTITION BY window_start) AS p_all
        FROM wn),
wfd AS (SELECT window_start,
          CAST(sum(CASE WHEN rn <= greatest(1, CAST(floor(n_all * CAST(0.03 AS DOUBLE)) AS BIGINT)) THEN is_fraud ELSE 0 END) AS DOUBLE) / any_value(p_all) AS f3,
          CAST(sum(CASE WHEN rn <= greatest(1, CAST(floor(n_all * CAST(0.05 AS DOUBLE)) AS BIGINT)) THEN is_fraud ELSE 0 END) AS DOUBLE) / any_value(p_all) AS f5
        FROM wrk GROUP BY window_start),
rm AS (SELECT a.window_start, n_rows, CAST(n_pos AS BIGINT) AS n_pos, round(auc, 4) AS roc_auc, round(ap, 4) AS pr_auc,
              round(f3, 4) AS fdr_at_3pct, round(f5, 4) AS fdr_at_5pct
       FROM waa a JOIN wfd f ON a.window_start = f.window_start)"""


def rolling(spark, sf_dir):
    return ro.rolling_metrics(txn(spark, sf_dir), 30 * ro.DAY, 7 * ro.DAY)


@register("rolling_30d_metrics", with_txn(_WIN, body="SELECT * FROM rm"))
def q_rolling_30d_metrics(spark, sf_dir):
    """Headline metrics over 30-day windows sliding by 7 days (epoch-aligned starts)."""
    return rolling(spark, sf_dir)


_RULES_VALUES = ", ".join(f"('{m}', {d}, {a}, {r})" for m, (d, a, r) in po.METRIC_RULES.items())


@register("policy_metric_alert", with_txn(_WIN, f"""rules(metric, deployment, alert_below, retrain_below) AS (
  VALUES {_RULES_VALUES}),
ml AS (SELECT window_start, 'roc_auc' AS metric, roc_auc AS value FROM rm
       UNION ALL SELECT window_start, 'pr_auc', pr_auc FROM rm
       UNION ALL SELECT window_start, 'fdr_at_3pct', fdr_at_3pct FROM rm
       UNION ALL SELECT window_start, 'fdr_at_5pct', fdr_at_5pct FROM rm)""", body="""
SELECT ml.window_start, ml.metric, ml.value, CAST(r.deployment AS DOUBLE) AS deployment,
       CASE WHEN value IS NULL THEN 'no_data' WHEN value < r.retrain_below THEN 'retrain'
            WHEN value < r.alert_below THEN 'alert' ELSE 'ok' END AS status
FROM ml JOIN rules r ON ml.metric = r.metric"""))
def q_policy_metric_alert(spark, sf_dir):
    """Each window's metrics against the alert / retrain thresholds of the monitoring plan."""
    rm = rolling(spark, sf_dir)
    long = rm.unpivot(["window_start"], ["roc_auc", "pr_auc", "fdr_at_3pct", "fdr_at_5pct"], "metric", "value")
    return po.metric_alerts(spark, long).select("window_start", "metric", "value", "deployment", "status")


def _gm_sql(src: str, p: str) -> str:
    lg = "\nUNION ALL\n".join(
        f"SELECT '{x}' AS proxy, CAST({x} AS VARCHAR) AS grp, score, is_fraud FROM {src}" for x in PROXIES)
    return f"""{p}lg AS ({lg}),
{p}sizes AS (SELECT proxy, grp, count(*) AS gn FROM {p}lg WHERE grp IS NOT NULL GROUP BY proxy, grp),
{p}col AS (SELECT l.proxy, CASE WHEN l.grp IS NULL THEN 'missing' WHEN s.gn < 100 THEN 'other' ELSE l.grp END AS grp,
              l.score, l.is_fraud FROM {p}lg l LEFT JOIN {p}sizes s ON l.proxy = s.proxy AND l.grp = s.grp),
{p}gm AS (SELECT proxy, grp,
              round(CASE WHEN count(CASE WHEN is_fraud = 0 THEN 1 END) > 0 THEN
                CAST(count(CASE WHEN score >= t AND is_fraud = 0 THEN 1 END) AS DOUBLE) / count(CASE WHEN is_fraud = 0 THEN 1 END) END, 4) AS fpr,
              round(CAST(count(CASE WHEN score >= t THEN 1 END) AS DOUBLE) / count(*), 4) AS flag_rate
          FROM {p}col, thr2 GROUP BY proxy, grp),
{p}ex AS (SELECT proxy, count(flag_rate) AS ngf, min(flag_rate) AS lof, max(flag_rate) AS hif,
                 count(fpr) AS ngp, min(fpr) AS lop, max(fpr) AS hip FROM {p}gm GROUP BY proxy),
{p}rep AS (SELECT proxy, round(CASE WHEN ngf >= 2 AND hif > 0 THEN lof / hif END, 4) AS di_ratio,
                  round(CASE WHEN ngp >= 2 THEN hip - lop END * 100, 2) AS gap_pp FROM {p}ex)"""


_THR2 = """thr2 AS (SELECT score AS t FROM (SELECT score, row_number() OVER (ORDER BY score DESC, txn_id) AS rn,
                                             count(*) OVER () AS n FROM va)
         WHERE rn = greatest(1, CAST(floor(n * CAST(0.03 AS DOUBLE)) AS BIGINT)))"""


@register("policy_fairness_alert", with_txn(SPLITF_CTE, _THR2, _gm_sql("va", "c_"), _gm_sql("tr", "r_"), body="""
SELECT c.proxy, c.di_ratio,
       CASE WHEN c.di_ratio IS NULL THEN 'no_data' WHEN c.di_ratio < 0.80 THEN 'escalate_fair_lending'
            WHEN c.di_ratio < 0.85 THEN 'biweekly_monitoring' ELSE 'ok' END AS di_status,
       round(c.gap_pp - r.gap_pp, 2) AS fpr_gap_growth_pp,
       CASE WHEN c.gap_pp - r.gap_pp IS NULL THEN 'no_data' WHEN c.gap_pp - r.gap_pp > 5.0 THEN 'escalate_model_risk'
            ELSE 'ok' END AS fpr_gap_status
FROM c_rep c LEFT JOIN r_rep r ON c.proxy = r.proxy"""))
def q_policy_fairness_alert(spark, sf_dir):
    """DI band and FPR-gap growth of val over train at the val 3 % threshold."""
    tr, va = splits(spark, sf_dir)
    t, _ = ranking.review_threshold(va, 0.03)
    cur = fa.fairness_report(fa.fairness_suite(va, PROXIES, t), t)
    ref = fa.fairness_report(fa.fairness_suite(tr, PROXIES, t), t)
    return po.fairness_alerts(cur, ref)


def _importance_rank_sql() -> str:
    names = ex.source_names(EXPLAIN_FEATURES)
    back = " ".join(f"WHEN '{n}' THEN '{f}'" for f, n in zip(EXPLAIN_FEATURES, names))
    return f"""gi AS (SELECT CASE feature {back} END AS feature, avg(abs(c)) AS m FROM cl GROUP BY feature),
ir AS (SELECT feature, CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS importance_rank FROM gi)"""


def _importance_rank(scored):
    names = ex.source_names(EXPLAIN_FEATURES)
    back = F.create_map(*[F.lit(x) for pair in zip(names, EXPLAIN_FEATURES) for x in pair])
    g = ex.global_importance(scored, EXPLAIN_FEATURES).withColumn("feature", F.element_at(back, F.col("feature")))
    # one row per scorecard feature
    return g.withColumn("importance_rank", F.row_number().over(
        Window.orderBy(F.desc("mean_abs_contribution"), "feature"))).select("feature", "importance_rank")


@register("policy_missing_shift", with_txn(*BASE, _importance_rank_sql(), """ms AS (
  SELECT feature, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100, 1) AS ref_pct FROM (""" +
    "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM tr" for c in EXPLAIN_FEATURES) +
    """) GROUP BY feature),
mc AS (
  SELECT feature, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE * 100, 1) AS cur_pct FROM (""" +
    "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM va" for c in EXPLAIN_FEATURES) +
    """) GROUP BY feature)""", body="""
SELECT ms.feature, ir.importance_rank, round(cur_pct - ref_pct, 1) AS missing_shift_pp,
       CASE WHEN importance_rank <= 5 AND abs(cur_pct - ref_pct) >= 2.0 THEN 'investigate_pipeline'
            WHEN importance_rank <= 20 AND abs(cur_pct - ref_pct) >= 5.0 THEN 'alert' ELSE 'ok' END AS status
FROM ms JOIN mc ON ms.feature = mc.feature JOIN ir ON ms.feature = ir.feature"""))
def q_policy_missing_shift(spark, sf_dir):
    """Missing-share change against importance rank: 2 points on a top-5, 5 points on a top-20 feature."""
    tr, va = splits(spark, sf_dir)
    card = ex.fit_scorecard(tr, EXPLAIN_FEATURES)
    ir = _importance_rank(ex.contributions(va, card, EXPLAIN_FEATURES))
    rep = dr.feature_psi_report(tr, va, EXPLAIN_FEATURES)
    return po.missing_shift_alerts(rep, ir)


_SEV_SR_CTES, _ = _score_report_sql("tr", "va", "val", "s_")


@register("policy_severity", with_txn(*BASE, _importance_rank_sql(), _SEV_SR_CTES, _psi_ctes(DRIFT_FEATURES),
                                      """vst AS (SELECT score, count(*) AS n, sum(is_fraud) AS pos FROM va GROUP BY score),
vcum AS (SELECT score, pos, n - pos AS neg,
           sum(n - pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM vst),
vauc AS (SELECT sum(pos * (neg_cum - neg + neg / CAST(2 AS DOUBLE))) / (sum(pos) * sum(neg)) AS auc FROM vcum),
fd AS (SELECT p.feature, p.psi, ir.importance_rank FROM psi p LEFT JOIN ir ON p.feature = ir.feature),
flags AS (SELECT coalesce(bool_or(importance_rank <= 5 AND psi >= 0.10), false) AS top5_drift,
                 coalesce(bool_or((importance_rank IS NULL OR importance_rank > 5) AND psi >= 0.10), false) AS other_drift
          FROM fd)""", body="""
SELECT round(s.psi, 5) AS score_psi, round(a.auc, 4) AS auc, top5_drift, other_drift,
       CASE WHEN s.psi > 0.30 OR a.auc < 0.860 THEN 'P1' WHEN s.psi > 0.20 OR a.auc < 0.880 THEN 'P2'
            WHEN s.psi > 0.10 OR top5_drift THEN 'P3' WHEN other_drift THEN 'P4' ELSE 'none' END AS severity
FROM s_psi s, vauc a, flags"""))
def q_policy_severity(spark, sf_dir):
    """Escalation level P1-P4 from score PSI, val AUC and feature drift by importance."""
    tr, va = splits(spark, sf_dir)
    score_psi = dr.psi_table(tr, va, ["score"]).select(F.col("psi").alias("score_psi"))
    auc = ranking.auc_ap(va).select(F.col("roc_auc").alias("auc"))
    card = ex.fit_scorecard(tr, EXPLAIN_FEATURES)
    ir = _importance_rank(ex.contributions(va, card, EXPLAIN_FEATURES))
    fd = dr.psi_table(tr, va, DRIFT_FEATURES).join(ir, "feature", "left")
    flags = fd.agg(
        F.coalesce(F.bool_or((F.col("importance_rank") <= 5) & (F.col("psi") >= 0.10)), F.lit(False)).alias("top5_drift"),
        F.coalesce(F.bool_or((F.col("importance_rank").isNull() | (F.col("importance_rank") > 5))
                             & (F.col("psi") >= 0.10)), F.lit(False)).alias("other_drift"))
    one = one_row(score_psi, auc, flags)
    sev = po.severity(F.col("score_psi"), F.col("auc"), F.col("top5_drift"), F.col("other_drift"))
    return one.select(rnd("score_psi", 5).alias("score_psi"), rnd("auc", 4).alias("auc"), "top5_drift",
                      "other_drift", sev.alias("severity"))


# --- what-if, triage, dossier ----------------------------------------------

_GRID_VALUES = ", ".join(
    f"({s}, {'CAST(NULL AS DOUBLE)' if f is None else f'CAST({f} AS DOUBLE)'}, "
    f"{'CAST(NULL AS INTEGER)' if h is None else h})" for s, f, h in wi.scenario_grid())


@register("what_if_grid", with_txn(f"""det AS (SELECT txn_id, round(score, 4) AS fraud_score, round(amt, 4) AS amt FROM txn),
grid(sid, factor, hour) AS (VALUES {_GRID_VALUES}),
x AS (SELECT det.*, sid, factor, hour,
             CASE WHEN amt > 0 THEN (amt * factor - amt) / amt ELSE 0.0 END AS pct FROM det, grid),
y AS (SELECT x.*,
        CASE WHEN factor IS NULL THEN 0.0 WHEN pct > 0.2 THEN least(0.05, pct * 0.03)
             WHEN pct < -0.2 THEN -least(0.03, abs(pct) * 0.02) ELSE 0.0 END AS d_amt,
        CASE WHEN hour IS NULL THEN 0.0 WHEN hour < 6 THEN 0.03 WHEN hour > 18 THEN 0.02 ELSE -0.01 END AS d_hour
      FROM x),
z AS (SELECT y.*, greatest(0.0, least(1.0, fraud_score + (d_amt + d_hour))) AS new_score FROM y)""", body="""
SELECT txn_id, sid AS scenario_id, round(new_score, 6) AS new_score,
       (CASE WHEN new_score >= 0.70 THEN 'high' WHEN new_score >= 0.40 THEN 'medium' ELSE 'low' END) <>
       (CASE WHEN fraud_score >= 0.70 THEN 'high' WHEN fraud_score >= 0.40 THEN 'medium' ELSE 'low' END) AS band_flip
FROM z"""))
def q_what_if_grid(spark, sf_dir):
    """Directional re-score of every transaction under 16 amount/hour edit scenarios."""
    d = txn(spark, sf_dir).select("txn_id", rnd("score", 4).alias("fraud_score"), rnd("amt", 4).alias("amt"))
    g = wi.what_if_grid(d)
    return g.select("txn_id", "scenario_id", rnd("new_score", 6).alias("new_score"), "band_flip")


@register("triage_rules", with_txn(*BASE, _TOP, """tagg AS (
  SELECT txn_id, count(CASE WHEN round(c, 5) > 0 THEN 1 END) AS n_positive_factors,
         count(CASE WHEN c >= 0.5 THEN 1 END) AS n_strong_factors,
         count(DISTINCT CASE WHEN round(c, 5) > 0 THEN reason_code END) AS n_codes
  FROM tpc GROUP BY txn_id),
tj AS (SELECT tagg.*, va.score,
         CASE WHEN va.score >= 0.70 AND n_positive_factors >= 2 THEN 'high'
              WHEN va.score >= 0.40 OR n_strong_factors >= 1 THEN 'medium' ELSE 'low' END AS risk
       FROM tagg JOIN va ON tagg.txn_id = va.txn_id)""", body="""
SELECT txn_id, CAST(n_positive_factors AS INTEGER) AS n_positive_factors, CAST(n_strong_factors AS INTEGER) AS n_strong_factors, risk,
       CASE WHEN risk = 'high' AND n_codes > 0 THEN 'auto_decline' WHEN risk = 'low' THEN 'auto_approve'
            ELSE 'escalate' END AS action
FROM tj"""))
def q_triage_rules(spark, sf_dir):
    """Written triage guidance over each val row's top four contributions."""
    tr, va = splits(spark, sf_dir)
    card = ex.fit_scorecard(tr, EXPLAIN_FEATURES)
    return ex.triage_rules(ex.contributions(va, card, EXPLAIN_FEATURES), EXPLAIN_FEATURES)


@register("evidence_dossier", with_txn(*BASE, _TOP, _THR2, """flag AS (SELECT va.* FROM va, thr2 WHERE va.score >= thr2.t),
w30 AS (SELECT card_id, count(*) AS n30, round(sum(amt), 2) AS tot30 FROM sf
        WHERE dt >= (SELECT max(dt) FROM sf) - 30 * 86400 GROUP BY card_id),
pos AS (SELECT txn_id, reason_code, min(rank) AS r FROM tpc WHERE round(c, 5) > 0 GROUP BY txn_id, reason_code),
adv AS (SELECT txn_id, string_agg(reason_code, ',' ORDER BY r) AS adverse_codes FROM pos GROUP BY txn_id),
tops AS (SELECT txn_id, string_agg(feature, ',' ORDER BY rank) AS top_features FROM tpc GROUP BY txn_id)""", body="""
SELECT f.txn_id, round(f.score, 4) AS fraud_score, round(f.amt, 4) AS amt, f.card_id, tops.top_features,
       adv.adverse_codes, coalesce(w30.n30, 0) AS card_txn_30d, w30.tot30 AS card_total_30d
FROM flag f JOIN tops ON f.txn_id = tops.txn_id LEFT JOIN adv ON f.txn_id = adv.txn_id
LEFT JOIN w30 ON f.card_id = w30.card_id"""))
def q_evidence_dossier(spark, sf_dir):
    """For every flagged val row (3 % threshold): details, top reasons, adverse codes and
    the card's 30-day history, in one row per transaction."""
    tr, va = splits(spark, sf_dir)
    t, _ = ranking.review_threshold(va, 0.03)
    flagged = va.filter(F.col("score") >= F.lit(t))
    card = ex.fit_scorecard(tr, EXPLAIN_FEATURES)
    scored = ex.contributions(flagged, card, EXPLAIN_FEATURES)
    reasons = ex.top_reasons(scored, EXPLAIN_FEATURES, 4)
    # at most four reasons per transaction
    tops = reasons.groupBy("txn_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]), ",").alias("top_features"))
    adv = ex.adverse_codes(scored, EXPLAIN_FEATURES, 4).groupBy("txn_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda s: s["code"]), ",").alias("adverse_codes"))
    allrows = tr.unionByName(va)
    hist = hi.customer_history_all(allrows, 30).select(
        "card_id", F.col("n_transactions_in_window").alias("card_txn_30d"), F.col("total_amount").alias("card_total_30d"))
    return (flagged.select("txn_id", rnd("score", 4).alias("fraud_score"), rnd("amt", 4).alias("amt"), "card_id")
            .join(tops, "txn_id").join(adv, "txn_id", "left").join(hist, "card_id", "left")
            .withColumn("card_txn_30d", F.coalesce("card_txn_30d", F.lit(0).cast("long")))
            .select("txn_id", "fraud_score", "amt", "card_id", "top_features", "adverse_codes",
                    "card_txn_30d", "card_total_30d"))


# --- single feature columns -------------------------------------------------

def _feat_query(name, col, sql_col, doc, rounded):
    @register(name, with_txn(FEAT_CTE, body=f"SELECT txn_id, {sql_col} AS {col} FROM feat"))
    def q(spark, sf_dir):
        f = fx.build_features(txn(spark, sf_dir))
        return f.select("txn_id", (rnd(col, 6) if rounded else F.col(col)).alias(col))
    q.__doc__ = doc
    return q


_feat_query("feat_amount_log", "amt_log", "round(amt_log, 6)", "log1p of the amount.", True)
_feat_query("feat_uid", "uid_card_email", "uid_card_email", "Card id, '_', email domain ('nan' if missing).", False)
_feat_query("feat_tx_hour", "tx_hour", "round(tx_hour, 6)", "Hour of day as a fraction, (dt mod 86400) / 3600.", True)
_feat_query("feat_tx_dow", "tx_dayofweek", "tx_dayofweek", "Weekday proxy, (dt div 86400) mod 7.", False)
_feat_query("feat_tx_day", "tx_day", "tx_day", "Day number, dt div 86400.", False)


@register("sorted_reports", with_txn(SPLITF_CTE, _psi_ctes(DRIFT_FEATURES), body="""
SELECT feature, round(psi, 5) AS psi, CAST(row_number() OVER (ORDER BY round(psi, 5) DESC NULLS LAST, feature) AS INTEGER) AS rank
FROM psi"""))
def q_sorted_reports(spark, sf_dir):
    """Feature drift report in PSI order (rank column; ties by name)."""
    p = dr.psi_of(split_rows(spark, sf_dir), DRIFT_FEATURES).select("feature", rnd("psi", 5).alias("psi"))
    # one row per monitored feature
    w = Window.orderBy(F.desc_nulls_last("psi"), "feature")
    return p.withColumn("rank", F.row_number().over(w))


@register("ordering_check", with_txn(SPLITF_CTE, body="""
SELECT split, count(*) AS n_rows, count(CASE WHEN dt < prev THEN 1 END) AS n_violations
FROM (SELECT split, dt, lag(dt) OVER (PARTITION BY split ORDER BY dt, txn_id) AS prev FROM sf) GROUP BY split"""))
def q_ordering_check(spark, sf_dir):
    """The written train and val files read back: rows whose time is before that of the row
    written before them, within and across files (0 in a table in order)."""
    from riskframe.plans.prepare import prepare
    return od.written_order(prepare(spark, sf_dir), "dt").select("split", "n_rows", "n_violations")


def dossier_nested(spark, sf_dir):
    tr, va = splits(spark, sf_dir)
    t, _ = ranking.review_threshold(va, 0.03)
    flagged = va.filter(F.col("score") >= F.lit(t))
    card = ex.fit_scorecard(tr, EXPLAIN_FEATURES)
    scored = ex.contributions(flagged, card, EXPLAIN_FEATURES)
    # at most four reasons and four codes per transaction
    reasons = ex.top_reasons(scored, EXPLAIN_FEATURES, 4).groupBy("txn_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "feature", "feature_value", "contribution", "direction",
                                             "reason_code", "reason_text"))).alias("top_reasons"))
    codes_ = ex.adverse_codes(scored, EXPLAIN_FEATURES, 4).groupBy("txn_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "code", "description", "driven_by_feature")))
        .alias("adverse_codes"))
    hist = hi.customer_history_all(tr.unionByName(va), 30)
    hist = hist.select("card_id", F.struct(*[c for c in hist.columns if c != "card_id"]).alias("card_history"))
    details = hi.txn_details(flagged)
    det = details.select("txn_id", F.struct(*details.columns).alias("details"))
    return (flagged.select("txn_id", "card_id").join(det, "txn_id").join(reasons, "txn_id")
            .join(codes_, "txn_id", "left").join(hist, "card_id", "left")
            .select("txn_id", "details", "top_reasons", "card_history",
                    F.coalesce("adverse_codes", F.array().cast(codes_.schema["adverse_codes"].dataType))
                    .alias("adverse_codes")))


@register("evidence_dossier_nested")
def q_evidence_dossier_nested(spark, sf_dir):
    """The four lookups for every flagged val row as one nested row: details, ranked
    reasons, the card's 30-day history and the adverse-action codes."""
    return dossier_nested(spark, sf_dir)
