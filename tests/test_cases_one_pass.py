"""Evaluation cases: all pools drawn in one pass, reports formed for the cases only."""

from conftest import SF0001
from pyspark.sql import functions as F

from riskframe.functions.features import tx_hour
from riskframe.operators import cases as cs


def _scored(spark):
    """Rows of every pool, with ids that come twice and amounts, scores and ids that are missing."""
    return spark.range(6000).repartition(5).select(
        F.when(F.col("id") % 97 != 0, F.col("id") - F.when(F.col("id") % 31 == 0, 1).otherwise(0)).alias("txn_id"),
        F.when(F.col("id") % 13 != 0, F.pmod(F.xxhash64("id"), F.lit(400)).cast("double")).alias("amt"),
        F.when(F.col("id") % 17 != 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(500)) / 500.0).alias("score"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)) == 0).cast("int").alias("is_fraud"),
        F.pmod(F.xxhash64("id", F.lit(3)), F.lit(864000)).alias("dt")).withColumn("tx_hour", tx_hour())


def test_pools_in_one_pass_equal_single_draws(spark):
    df = _scored(spark)
    pools = cs.scenarios(200.0, 100.0)
    together = cs.pick_pools(df, pools)
    for i, sc in enumerate(pools):
        own = [tuple(r) for r in cs.pick_pool(df, sc).select("txn_id", "_ord").collect()]
        got = [tuple(r) for r in together.filter(F.col("_si") == i).select("txn_id", "_ord").collect()]
        assert len(own) == sc.n and sorted(map(str, own)) == sorted(map(str, got)), sc.name


def _scans(df, file):
    return df._jdf.queryExecution().executedPlan().toString().count(file)


def test_events_are_read_once(spark):
    import __spark_entry__ as se
    q = se.queries()
    assert _scans(q["build_eval_set"](spark, SF0001), "events.parquet") == 1
    assert _scans(q["action_ordinal"](spark, SF0001), "events.parquet") == 1      # of the cases' reports


def test_reports_of_cases_equal_all_reports(spark):
    from riskframe.plans.q_cases import eval_set
    from riskframe.plans.q_guard import case_results
    from riskframe.sources import reports as rp
    cases = eval_set(spark, SF0001)
    every = rp.reports(spark, SF0001).select(F.col("txn_id").alias("transaction_id"), "recommended_action", "priority_raw", "error")
    want = cases.select("eval_id", "transaction_id").join(every, "transaction_id", "left").select(
        "eval_id", "recommended_action", "priority_raw", "error")
    got = case_results(spark, SF0001).select(*want.columns)
    assert sorted(map(str, want.collect())) == sorted(map(str, got.collect())) and want.count() == got.count()
