"""Agreement between expected and recommended actions, and guardrail pass rates.

Inputs are tables: a (expected, predicted, label, priority, adversarial) table
for the agreement metrics and a guardrail table for the pass rates. All
metrics are single grouped aggregates (the 3x3 confusion keyed by class pair).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.codes import ACTION_ORDINAL, action_ordinal
from riskframe.functions.numeric import rnd

DEFAULT_PRIORITY = 5


def case_results(cases: DataFrame, reports: DataFrame) -> DataFrame:
    """Cases left joined with the reports of their runs by eval_id (a case without a report
    predicts escalate). Two cases on one transaction keep their own reports."""
    r = reports.select("eval_id", "recommended_action", "priority_raw", "error")
    j = cases.join(r, "eval_id", "left")
    return j.withColumns({
        "expected": action_ordinal(F.col("expected_action")),
        "predicted": action_ordinal(F.col("recommended_action")),
        "priority": F.coalesce(F.col("priority_raw").try_cast("int"), F.lit(DEFAULT_PRIORITY)),
    })


def guard_pass_rates(g: DataFrame) -> DataFrame:
    """Share passing per check and overall (3 dp), completed and errored counts."""
    def rate(c):
        return rnd(F.avg(F.col(c).cast("double")), 3).alias(f"{c.replace('_passed', '')}_rate")
    return g.agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count(F.when(F.col("error").isNull(), 1)).alias("n_completed"),
        F.count(F.when(F.col("error").isNotNull(), 1)).alias("n_errors"),
        rate("schema_passed"), rate("grounding_passed"), rate("pii_passed"), rate("action_passed"),
        rate("all_passed"))


def action_agreement(t: DataFrame) -> DataFrame:
    return t.agg(rnd(F.avg((F.col("expected") == F.col("predicted")).cast("double")), 3).alias("exact_match_rate"),
                 F.count(F.lit(1)).alias("n_cases"))


def cohen_kappa(t: DataFrame, n_classes: int = 3) -> DataFrame:
    """(po - pe) / (1 - pe) from one pass of per-class counts; 0 when empty, 1 when pe = 1."""
    aggs = [F.count(F.lit(1)).alias("n"),
            F.count(F.when(F.col("expected") == F.col("predicted"), 1)).alias("agree")]
    for k in range(n_classes):
        aggs += [F.count(F.when(F.col("expected") == k, 1)).alias(f"e{k}"),
                 F.count(F.when(F.col("predicted") == k, 1)).alias(f"p{k}")]
    a = t.agg(*aggs)
    n = F.col("n").cast("double")
    po = F.try_divide(F.col("agree").cast("double"), n)
    pe = sum(F.try_divide(F.col(f"e{k}").cast("double"), n) * F.try_divide(F.col(f"p{k}").cast("double"), n)
             for k in range(n_classes))
    kappa = (F.when(F.col("n") == 0, F.lit(0.0)).when(pe == 1.0, F.lit(1.0))
              .otherwise((po - pe) / (F.lit(1.0) - pe)))
    return a.select(rnd(po, 6).alias("observed_agreement"), rnd(pe, 6).alias("expected_agreement"),
                    rnd(kappa, 6).alias("cohen_kappa"), F.col("n").alias("n_cases"))


def action_confusion(spark: SparkSession, t: DataFrame) -> DataFrame:
    """Expected x predicted counts over the three classes, zeros included."""
    labels = {v: k for k, v in ACTION_ORDINAL.items()}
    grid = spark.createDataFrame(
        [(e, p, labels[e], labels[p]) for e in range(3) for p in range(3)],
        "expected int, predicted int, expected_action string, predicted_action string")
    counts = t.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return (grid.join(counts, ["expected", "predicted"], "left")
                .select("expected_action", "predicted_action", F.coalesce("n", F.lit(0)).alias("n")))


def priority_gap(t: DataFrame, label: str = "actual_fraud") -> DataFrame:
    y = F.col(label) == 1
    f = F.avg(F.when(y, F.col("priority").cast("double")))
    lg = F.avg(F.when(~y, F.col("priority").cast("double")))
    return t.agg(rnd(f, 2).alias("mean_fraud_priority"), rnd(lg, 2).alias("mean_legit_priority"),
                 F.count(F.when(y, 1)).alias("n_fraud"), F.count(F.when(~y, 1)).alias("n_legit"),
                 rnd(f - lg, 2).alias("priority_gap"))


def adversarial_accuracy(t: DataFrame) -> DataFrame:
    adv = t.filter(F.col("adversarial"))
    return adv.agg(F.count(F.lit(1)).alias("n_adversarial"),
                   F.count(F.when(F.col("expected") == F.col("predicted"), 1)).alias("n_correct"),
                   rnd(F.try_divide(F.count(F.when(F.col("expected") == F.col("predicted"), 1)).cast("double"),
                                    F.count(F.lit(1))), 3).alias("accuracy"))
