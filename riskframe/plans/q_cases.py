"""Sampling and evaluation-case queries (survey 2.12) over the scored txn rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import features as fx
from riskframe.operators import cases as cs
from riskframe.plans.catalog import register
from riskframe.plans.oracle import FEAT_CTE, with_txn
from riskframe.sources.tables import txn

# amount cut-offs scaled to this data (the defaults are 500 and 200)
HIGH_AMOUNT, NIGHT_AMOUNT = 200.0, 100.0


def feat(spark, sf_dir):
    return fx.build_features(txn(spark, sf_dir))


def _md5(seed: int) -> str:
    return f"md5(concat(CAST(txn_id AS VARCHAR), '{seed}'))"


# (name, SQL predicate, n, order SQL, seed-order SQL for numbering)
_POOLS = [
    ("clear_fraud", "is_fraud = 1 AND score > 0.95", 10, f"{_md5(42)}, txn_id", _md5(42),
     "auto_decline", "high", False),
    ("clear_legitimate", "is_fraud = 0 AND score < 0.05", 8, f"{_md5(42)}, txn_id", _md5(42),
     "auto_approve", "low", False),
    ("ambiguous_middle", "score >= 0.40 AND score <= 0.70", 7, f"{_md5(42)}, txn_id", _md5(42),
     "escalate", "medium", False),
    ("adversarial_high_amount_clean", f"is_fraud = 0 AND score < 0.15 AND amt > {HIGH_AMOUNT}", 1,
     "amt DESC, txn_id", "''", "auto_approve", "low", True),
    ("adversarial_high_score_fp", "is_fraud = 0 AND score > 0.90", 1, "score DESC, txn_id", "''",
     "escalate", "high", True),
    ("adversarial_low_score_fn", "is_fraud = 1 AND score < 0.30", 1, f"{_md5(7)}, txn_id", _md5(7),
     "escalate", "medium", True),
    ("adversarial_nighttime_legit", f"is_fraud = 0 AND score < 0.25 AND tx_hour <= 4 AND amt > {NIGHT_AMOUNT}", 1,
     f"{_md5(42)}, txn_id", _md5(42), "escalate", "low", True),
    ("adversarial_mid_score_fraud", "is_fraud = 1 AND score >= 0.35 AND score <= 0.55", 1,
     f"{_md5(99)}, txn_id", _md5(99), "escalate", "medium", True),
]

_QUERY_NAMES = {
    "clear_fraud": "case_clear_fraud", "clear_legitimate": "case_clear_legit",
    "ambiguous_middle": "case_ambiguous", "adversarial_high_amount_clean": "case_high_amount_clean",
    "adversarial_high_score_fp": "case_high_score_fp", "adversarial_low_score_fn": "case_low_score_fn",
    "adversarial_nighttime_legit": "case_night_legit", "adversarial_mid_score_fraud": "case_mid_score_fraud",
}


def _pool_sql(i, pool) -> str:
    name, pred, n, order, ordk, act, risk, adv = pool
    return (f"SELECT * FROM (SELECT {i} AS si, {ordk} AS o, txn_id AS transaction_id, '{name}' AS scenario_type,"
            f" '{act}' AS expected_action, '{risk}' AS expected_risk, round(score, 5) AS model_score,"
            f" CAST(is_fraud AS INTEGER) AS actual_fraud, {str(adv).lower()} AS adversarial"
            f" FROM feat WHERE {pred} ORDER BY {order} LIMIT {n})")


_EVAL_CTE = FEAT_CTE + ",\nev0 AS (" + "\nUNION ALL\n".join(_pool_sql(i, p) for i, p in enumerate(_POOLS)) + """),
evs AS (SELECT transaction_id, scenario_type, expected_action, expected_risk, model_score, actual_fraud, adversarial,
               printf('eval_%03d', row_number() OVER (ORDER BY si, o, transaction_id)) AS eval_id FROM ev0)"""


def eval_set(spark, sf_dir):
    return cs.build_eval_set(feat(spark, sf_dir), HIGH_AMOUNT, NIGHT_AMOUNT)


def _register_case(i, pool):
    name, pred, n, order, _o, *_ = pool

    @register(_QUERY_NAMES[name], with_txn(FEAT_CTE, body=f"""
SELECT txn_id, score, is_fraud FROM feat WHERE {pred} ORDER BY {order} LIMIT {n}
"""))
    def q(spark, sf_dir):
        sc = cs.scenarios(HIGH_AMOUNT, NIGHT_AMOUNT)[i]
        return cs.pick_pool(feat(spark, sf_dir), sc).select("txn_id", "score", "is_fraud")
    q.__doc__ = f"Scenario pool '{name}': {pred}; draw {n}."
    return q


for _i, _p in enumerate(_POOLS):
    _register_case(_i, _p)


@register("sample_rows", with_txn(body=f"""
SELECT txn_id, score FROM txn ORDER BY {_md5(42)}, txn_id LIMIT 25
"""))
def q_sample_rows(spark, sf_dir):
    """25 rows without replacement, repeatable (first 25 by md5(id || seed))."""
    return cs.sample_rows(txn(spark, sf_dir), 25, 42).select("txn_id", "score")


@register("pool_predicates", with_txn(FEAT_CTE, body="\nUNION ALL\n".join(
    f"SELECT '{p[0]}' AS scenario_type, count(*) AS pool_size FROM feat WHERE {p[1]}" for p in _POOLS)))
def q_pool_predicates(spark, sf_dir):
    """Size of each of the eight scenario pools."""
    f = feat(spark, sf_dir)
    sc = cs.scenarios(HIGH_AMOUNT, NIGHT_AMOUNT)
    return f.agg(*[F.count(F.when(s.predicate, 1)).alias(s.name) for s in sc]).unpivot(
        [], [s.name for s in sc], "scenario_type", "pool_size")


@register("build_eval_set", with_txn(_EVAL_CTE, body="SELECT * FROM evs"))
def q_build_eval_set(spark, sf_dir):
    """All scenario draws unioned and numbered eval_001... (score rounded to 5)."""
    return eval_set(spark, sf_dir)


@register("case_summary", with_txn(_EVAL_CTE, body="""
SELECT scenario_type, count(*) AS n, count(CASE WHEN adversarial THEN 1 END) AS n_adversarial,
       min(model_score) AS min_score, max(model_score) AS max_score, CAST(sum(actual_fraud) AS BIGINT) AS n_fraud
FROM evs GROUP BY scenario_type
"""))
def q_case_summary(spark, sf_dir):
    """Per scenario: cases, adversarial cases, score range, fraud count."""
    return cs.case_summary(eval_set(spark, sf_dir))


@register("demo_picks", with_txn(body=f"""
SELECT * FROM (SELECT txn_id, score, is_fraud, 'true_positive' AS pick FROM txn WHERE is_fraud = 1
               ORDER BY score DESC, txn_id LIMIT 1)
UNION ALL
SELECT * FROM (SELECT txn_id, score, is_fraud, 'false_positive' AS pick FROM txn WHERE is_fraud = 0
               ORDER BY score DESC, txn_id LIMIT 1)
UNION ALL
SELECT * FROM (SELECT txn_id, score, is_fraud, 'medium_fraud' AS pick FROM txn
               WHERE is_fraud = 1 AND score >= 0.50 AND score <= 0.80 ORDER BY {_md5(42)}, txn_id LIMIT 1)
"""))
def q_demo_picks(spark, sf_dir):
    """Top-scored fraud, top-scored non-fraud, one fraud with score in .50-.80."""
    return cs.demo_picks(txn(spark, sf_dir)).select("txn_id", "score", "is_fraud", "pick")
