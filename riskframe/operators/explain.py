"""Per-row explanations: additive contributions, top reasons, reason codes.

A linear scorecard in log-odds has exact additive contributions
w_j * (x_j - mean_j); missing inputs take the reference mean (contribution 0).
Contributions are an ``array<double>`` per row, so ranking the top reasons is
array work inside the row (no shuffle); the long form is a ``posexplode``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import codes
from riskframe.functions.numeric import mean_half_up, rnd

WEIGHT_DIGITS = 8


def scorecard_frame(ref: DataFrame, features: Sequence[str], label: str = "is_fraud") -> DataFrame:
    """The fitted scorecard as a one-row frame: w_<f>, m_<f>, b0 (all computed in Spark)."""
    y = F.col(label).cast("double")
    cols = []
    for f in features:
        x = F.col(f).cast("double")
        cols += [rnd(F.try_divide(F.corr(x, y), F.stddev_pop(x)), WEIGHT_DIGITS).alias(f"w_{f}"),
                 mean_half_up(f, WEIGHT_DIGITS).alias(f"m_{f}")]
    base = F.avg(y)
    cols.append(rnd(F.log(base / (F.lit(1.0) - base)), WEIGHT_DIGITS).alias("b0"))
    return ref.agg(*cols)


def fit_scorecard(ref: DataFrame, features: Sequence[str], label: str = "is_fraud") -> dict:
    """Weights, centres and intercept as driver scalars (2 per feature + 1)."""
    return scorecard_frame(ref, features, label).first().asDict()


def contributions(df: DataFrame, card: dict, features: Sequence[str]) -> DataFrame:
    """Add ``contrib`` array<double> (feature order) and ``margin`` = b0 + sum."""
    parts = [F.coalesce(F.lit(card[f"w_{f}"]) * (F.col(f).cast("double") - F.lit(card[f"m_{f}"])),
                        F.lit(0.0)) for f in features]
    out = df.withColumn("contrib", F.array(*parts))
    return out.withColumn("margin", F.aggregate("contrib", F.lit(float(card["b0"])), lambda a, c: a + c))


def source_names(features: Sequence[str]) -> list[str]:
    return [codes.BINDING_FEATURE_NAMES.get(f, f) for f in features]


def top_reasons_array(contrib: Column, values: Column, names: Sequence[str], n: int) -> Column:
    """Top-n entries by |contribution| (ties: feature order) as an array of structs
    (rank, feature, feature_value, contribution)."""
    entries = F.transform(
        F.arrays_zip(F.array(*[F.lit(x) for x in names]).alias("feature"),
                     contrib.alias("c"), values.alias("v"),
                     F.sequence(F.lit(0), F.lit(len(names) - 1)).alias("i")),
        lambda e: F.struct((-F.abs(e["c"])).alias("k"), e["i"].alias("i"),
                           e["feature"].alias("feature"), e["v"].alias("feature_value"),
                           e["c"].alias("contribution")))
    top = F.slice(F.array_sort(entries), 1, n)
    return F.transform(top, lambda e, r: F.struct(
        (r + 1).alias("rank"), e["feature"].alias("feature"), e["feature_value"].alias("feature_value"),
        e["contribution"].alias("contribution")))


def top_reasons(scored: DataFrame, features: Sequence[str], n: int = 4,
                id_col: str = "txn_id") -> DataFrame:
    """Long form: id, rank, feature, value, contribution(5), direction, code, text."""
    names = source_names(features)
    values = F.array(*[F.col(f).cast("double") for f in features])
    t = scored.select(id_col, F.explode(top_reasons_array(F.col("contrib"), values, names, n)).alias("r"))
    c = F.col("r.contribution")
    code = codes.reason_code(F.col("r.feature"))
    return t.select(
        id_col, F.col("r.rank").alias("rank"), F.col("r.feature").alias("feature"),
        F.col("r.feature_value").alias("feature_value"), rnd(c, 5).alias("contribution"),
        F.when(c > 0, F.lit("increases_risk")).otherwise(F.lit("decreases_risk")).alias("direction"),
        code.alias("reason_code"), codes.reason_text(code).alias("reason_text"))


def reason_codes_dedup(scored: DataFrame, features: Sequence[str], n: int = 4,
                       id_col: str = "txn_id") -> DataFrame:
    """Distinct codes of the top-n reasons in rank order (first occurrence kept)."""
    names = source_names(features)
    values = F.array(*[F.col(f).cast("double") for f in features])
    top = top_reasons_array(F.col("contrib"), values, names, n)
    codes_arr = F.array_distinct(F.transform(top, lambda e: codes.reason_code(e["feature"])))
    return scored.select(id_col, F.array_join(codes_arr, ",").alias("reason_codes"))


def adverse_codes(scored: DataFrame, features: Sequence[str], n: int = 4,
                  id_col: str = "txn_id") -> DataFrame:
    """From the top-n reasons, positive contributions only: one row per distinct
    code (first by rank) with its description and driving feature."""
    values = F.array(*[F.col(f).cast("double") for f in features])
    top = top_reasons_array(F.col("contrib"), values, source_names(features), n)
    # all inside the row: what is exploded at the end is the result
    coded = F.transform(top, lambda e: F.struct(codes.reason_code(e["feature"]).alias("code"), e["feature"].alias("feature"),
                                                e["rank"].alias("rank"), e["contribution"].alias("c")))
    x = scored.select(id_col, F.filter(coded, lambda e: rnd(e["c"], 5) > 0).alias("p"))
    first = F.filter("p", lambda e, i: F.array_position(F.transform("p", lambda q: q["code"]), e["code"]) == i + 1)
    return x.select(id_col, F.explode(first).alias("f")).select(
        id_col, "f.code", codes.reason_text(F.col("f.code")).alias("description"),
        F.col("f.feature").alias("driven_by_feature"), "f.rank")


def contributions_long(scored: DataFrame, features: Sequence[str], id_col: str = "txn_id") -> DataFrame:
    names = source_names(features)
    return scored.select(id_col, F.posexplode("contrib").alias("idx", "contribution")).withColumn(
        "feature", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("idx") + 1))


def global_importance(scored: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean |contribution| per feature (feature-count rows)."""
    long = contributions_long(scored, features)
    return long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))


def reason_coverage(importance: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` most important features with their code and text (a top-k report)."""
    code = codes.reason_code(F.col("feature"))
    return (importance.orderBy(F.desc("mean_abs_contribution"), "feature").limit(top)
                      .select("feature", code.alias("reason_code"), codes.reason_text(code).alias("reason_text")))


def triage_rules(scored: DataFrame, features: Sequence[str], strong: float = 0.5, n: int = 4,
                 score: str = "score", id_col: str = "txn_id") -> DataFrame:
    """Written scoring guidance as columns over the top-n contributions:
    high = score >= .70 with >= 2 positive factors; medium = score >= .40 or a
    factor >= ``strong``; else low. Decline only when high with adverse codes,
    approve when low, else escalate."""
    names = source_names(features)
    values = F.array(*[F.col(f).cast("double") for f in features])
    top = top_reasons_array(F.col("contrib"), values, names, n)
    pos = F.filter(top, lambda e: rnd(e["contribution"], 5) > 0)
    n_pos = F.size(pos)
    n_strong = F.size(F.filter(top, lambda e: e["contribution"] >= strong))
    n_codes = F.size(F.array_distinct(F.transform(pos, lambda e: codes.reason_code(e["feature"]))))
    s = F.col(score)
    risk = (F.when((s >= 0.70) & (n_pos >= 2), F.lit("high"))
             .when((s >= 0.40) | (n_strong >= 1), F.lit("medium"))
             .otherwise(F.lit("low")))
    action = (F.when((risk == "high") & (n_codes > 0), F.lit("auto_decline"))
               .when(risk == "low", F.lit("auto_approve")).otherwise(F.lit("escalate")))
    return scored.select(id_col, n_pos.alias("n_positive_factors"), n_strong.alias("n_strong_factors"),
                         risk.alias("risk"), action.alias("action"))
