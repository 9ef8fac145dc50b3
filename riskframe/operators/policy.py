"""Monitoring-plan rules applied to metric tables (documented policy, no model)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.numeric import rnd

# ---------------------------------------------------------------------------
# Fixed values from the monitoring plan.
# ---------------------------------------------------------------------------
# metric -> (deployment value, alert below, retrain below)
METRIC_RULES = {
    "roc_auc": (0.9126, 0.900, 0.880),
    "pr_auc": (0.5291, 0.480, 0.450),
    "fdr_at_3pct": (0.4783, 0.42, 0.38),
    "fdr_at_5pct": (0.5810, 0.53, 0.48),
}
DI_ESCALATE = 0.80
DI_WATCH = 0.85
FPR_GAP_GROWTH_PP = 5.0
MISSING_SHIFT_TOP5_PP = 2.0
MISSING_SHIFT_TOP20_PP = 5.0
SEVERITY = [  # (label, score psi above, auc below)
    ("P1", 0.30, 0.860),
    ("P2", 0.20, 0.880),
]
P3_PSI = 0.10


def metric_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(m, d, a, r) for m, (d, a, r) in METRIC_RULES.items()],
        "metric string, deployment double, alert_below double, retrain_below double")


def metric_alerts(spark: SparkSession, metrics_long: DataFrame) -> DataFrame:
    """(key..., metric, value) joined with the 4-row rule table: ok / alert / retrain."""
    rules = F.broadcast(metric_rules(spark))
    j = metrics_long.join(rules, "metric")
    status = (F.when(F.col("value").isNull(), F.lit("no_data"))
               .when(F.col("value") < F.col("retrain_below"), F.lit("retrain"))
               .when(F.col("value") < F.col("alert_below"), F.lit("alert"))
               .otherwise(F.lit("ok")))
    return j.withColumn("status", status).drop("alert_below", "retrain_below")


def fairness_alerts(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Per proxy: DI band (escalate < .80, watch .80-.85) and FPR-gap growth over
    the reference (> 5 points escalates)."""
    ref = reference.select("proxy", F.col("fpr_gap_pct_pts").alias("ref_gap_pp"))
    j = current.join(ref, "proxy", "left")
    growth = F.col("fpr_gap_pct_pts") - F.col("ref_gap_pp")
    di = (F.when(F.col("di_ratio").isNull(), F.lit("no_data"))
           .when(F.col("di_ratio") < DI_ESCALATE, F.lit("escalate_fair_lending"))
           .when(F.col("di_ratio") < DI_WATCH, F.lit("biweekly_monitoring"))
           .otherwise(F.lit("ok")))
    gap = (F.when(growth.isNull(), F.lit("no_data"))
            .when(growth > FPR_GAP_GROWTH_PP, F.lit("escalate_model_risk")).otherwise(F.lit("ok")))
    return j.select("proxy", "di_ratio", di.alias("di_status"), rnd(growth, 2).alias("fpr_gap_growth_pp"),
                    gap.alias("fpr_gap_status"))


def missing_shift_alerts(report: DataFrame, importance_rank: DataFrame) -> DataFrame:
    """Missing-share change (points) against the feature's importance rank."""
    j = report.join(importance_rank, "feature")
    shift = F.col("cur_missing_pct") - F.col("ref_missing_pct")
    status = (F.when((F.col("importance_rank") <= 5) & (F.abs(shift) >= MISSING_SHIFT_TOP5_PP),
                     F.lit("investigate_pipeline"))
               .when((F.col("importance_rank") <= 20) & (F.abs(shift) >= MISSING_SHIFT_TOP20_PP), F.lit("alert"))
               .otherwise(F.lit("ok")))
    return j.select("feature", "importance_rank", rnd(shift, 1).alias("missing_shift_pp"), status.alias("status"))


def severity(score_psi: F.Column, auc: F.Column, top5_drift: F.Column, other_drift: F.Column) -> F.Column:
    """P1-P4 escalation level (NULL: none)."""
    (label0, psi0, auc0), *rest = SEVERITY
    expr = F.when((score_psi > psi0) | (auc < auc0), F.lit(label0))
    for label, psi_above, auc_below in rest:
        expr = expr.when((score_psi > psi_above) | (auc < auc_below), F.lit(label))
    return (expr.when((score_psi > P3_PSI) | top5_drift, F.lit("P3"))
                .when(other_drift, F.lit("P4"))
                .otherwise(F.lit("none")))
