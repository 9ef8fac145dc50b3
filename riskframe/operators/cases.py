"""Repeatable row sampling and evaluation-case selection.

Sampling orders rows by md5(id || seed) and keeps the first n: the draw is the
same for any partitioning and reproducible in SQL. ``orderBy(...).limit(n)``
plans as a per-task top-n followed by a merge of n rows per task, so no task
ever sorts a whole pool. The evaluation set draws from all pools in one pass: a row
is marked with its pools, and each task hands on its first rows of each pool.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.features import tx_hour
from riskframe.functions.numeric import rnd


def sample_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def sample_rows(df: DataFrame, n: int, seed: int = 42, id_col: str = "txn_id") -> DataFrame:
    """n rows without replacement, repeatable: first n by md5(id || seed)."""
    return df.orderBy(sample_key(id_col, seed), F.col(id_col)).limit(n)


@dataclass(frozen=True)
class Scenario:
    name: str
    predicate: Column
    n: int
    pick: str                 # "hash" or "largest:<col>"
    seed: int
    expected_action: str
    expected_risk: str
    adversarial: bool


def scenarios(high_amount: float = 500.0, night_amount: float = 200.0,
              score: str = "score", label: str = "is_fraud", amt: str = "amt",
              hour: str = "tx_hour") -> list[Scenario]:
    """The eight scenario pools in their fixed order; amount cut-offs are parameters."""
    s, y, a, h = F.col(score), F.col(label), F.col(amt), F.col(hour)
    # Scenario names, predicates, draw sizes, seeds and expected outcomes.
    return [
        Scenario("clear_fraud", (y == 1) & (s > 0.95), 10, "hash", 42, "auto_decline", "high", False),
        Scenario("clear_legitimate", (y == 0) & (s < 0.05), 8, "hash", 42, "auto_approve", "low", False),
        Scenario("ambiguous_middle", (s >= 0.40) & (s <= 0.70), 7, "hash", 42, "escalate", "medium", False),
        Scenario("adversarial_high_amount_clean", (y == 0) & (s < 0.15) & (a > high_amount), 1,
                 f"largest:{amt}", 0, "auto_approve", "low", True),
        Scenario("adversarial_high_score_fp", (y == 0) & (s > 0.90), 1, f"largest:{score}", 0,
                 "escalate", "high", True),
        Scenario("adversarial_low_score_fn", (y == 1) & (s < 0.30), 1, "hash", 7, "escalate", "medium", True),
        Scenario("adversarial_nighttime_legit", (y == 0) & (s < 0.25) & (h <= 4) & (a > night_amount), 1,
                 "hash", 42, "escalate", "low", True),
        Scenario("adversarial_mid_score_fraud", (y == 1) & (s >= 0.35) & (s <= 0.55), 1, "hash", 99,
                 "escalate", "medium", True),
    ]


def pick_pool(df: DataFrame, sc: Scenario, id_col: str = "txn_id") -> DataFrame:
    """Rows drawn from one pool, with their position inside the scenario."""
    pool = df.filter(sc.predicate)
    if sc.pick.startswith("largest:"):
        col = sc.pick.split(":", 1)[1]
        order = [F.desc(col), F.asc(id_col)]
    else:
        order = [sample_key(id_col, sc.seed), F.asc(id_col)]
    picked = pool.orderBy(*order).limit(sc.n)
    return picked.withColumn("_ord", sample_key(id_col, sc.seed) if not sc.pick.startswith("largest:")
                             else F.lit(""))


def pick_pools(df: DataFrame, pools: list[Scenario], id_col: str = "txn_id") -> DataFrame:
    """The draws of all pools, as ``pick_pool`` makes them one by one, in one pass over the rows:
    ``df``'s columns with ``_si`` (the pool's place) and ``_ord``. The row numbers are limited before
    the shuffle, so a task that merges a pool gets a few rows of each task."""
    by_size = sorted({sc.pick.split(":", 1)[1] for sc in pools if sc.pick.startswith("largest:")})
    marks = []
    for i, sc in enumerate(pools):
        size = sc.pick.split(":", 1)[1] if sc.pick.startswith("largest:") else None
        marks.append(F.when(sc.predicate, F.struct(
            F.lit(i).alias("_si"),
            *[(F.col(c) if c == size else F.lit(None).cast(df.schema[c].dataType)).alias(f"_top_{c}") for c in by_size],
            (F.lit("") if size else sample_key(id_col, sc.seed)).alias("_ord"))))
    marked = df.withColumn("_m", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull()))).select(*df.columns, "_m.*")
    order = Window.partitionBy("_si").orderBy(*[F.desc(f"_top_{c}") for c in by_size], "_ord", F.asc(id_col))
    first = marked.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max(sc.n for sc in pools))
    wanted = F.element_at(F.array(*[F.lit(sc.n) for sc in pools]), F.col("_si") + 1)
    return first.filter(F.col("_rn") <= wanted).drop("_rn", *[f"_top_{c}" for c in by_size])


def build_eval_set(df: DataFrame, high_amount: float = 500.0, night_amount: float = 200.0,
                   id_col: str = "txn_id", score: str = "score", label: str = "is_fraud") -> DataFrame:
    """All scenario draws, numbered eval_001... in scenario order then draw order."""
    if "tx_hour" not in df.columns:
        df = df.withColumn("tx_hour", tx_hour())
    pools = scenarios(high_amount, night_amount, score, label)
    used = dict.fromkeys([id_col, score, label, "amt", "tx_hour"])
    outcomes = F.array(*[F.struct(
        F.lit(sc.name).alias("scenario_type"), F.lit(sc.expected_action).alias("expected_action"),
        F.lit(sc.expected_risk).alias("expected_risk"), F.lit(sc.adversarial).alias("adversarial")) for sc in pools])
    picked = pick_pools(df.select(*used), pools, id_col).withColumn("_sc", F.element_at(outcomes, F.col("_si") + 1))
    parts = picked.select(
        "_si", "_ord", F.col(id_col).alias("transaction_id"), "_sc.scenario_type", "_sc.expected_action",
        "_sc.expected_risk", rnd(score, 5).alias("model_score"), F.col(label).cast("int").alias("actual_fraud"),
        "_sc.adversarial")
    # at most 30 rows reach this window
    w = F.row_number().over(Window.orderBy("_si", "_ord", "transaction_id"))
    return parts.withColumn("eval_id", F.format_string("eval_%03d", w)).drop("_si", "_ord")


def case_summary(cases: DataFrame) -> DataFrame:
    """Per scenario: cases, adversarial cases, score range, fraud count."""
    return cases.groupBy("scenario_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("adversarial"), 1)).alias("n_adversarial"),
        F.min("model_score").alias("min_score"), F.max("model_score").alias("max_score"),
        F.sum("actual_fraud").cast("long").alias("n_fraud"))


def demo_picks(df: DataFrame, id_col: str = "txn_id", score: str = "score",
               label: str = "is_fraud") -> DataFrame:
    """Top-scored fraud, top-scored non-fraud, one fraud drawn from scores .50-.80."""
    s, y = F.col(score), F.col(label)
    tp = df.filter(y == 1).orderBy(F.desc(score), id_col).limit(1).withColumn("pick", F.lit("true_positive"))
    fp = df.filter(y == 0).orderBy(F.desc(score), id_col).limit(1).withColumn("pick", F.lit("false_positive"))
    md = (df.filter((y == 1) & (s >= 0.50) & (s <= 0.80)).orderBy(sample_key(id_col, 42), id_col).limit(1)
            .withColumn("pick", F.lit("medium_fraud")))
    return tp.unionByName(fp).unionByName(md)
