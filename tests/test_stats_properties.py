"""Property tests (hypothesis) for PSI, KS, AUC and kappa."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskframe.operators import agreement as ag
from riskframe.operators import drift as dr
from riskframe.operators import ranking

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
values = st.lists(st.floats(-100, 100, allow_nan=False, width=32), min_size=5, max_size=60)


@SETTINGS
@given(a=values, b=values)
def test_psi_non_negative_and_zero_on_itself(spark, a, b):
    ra = spark.createDataFrame(pd.DataFrame({"x": np.array(a, dtype=float)}))
    rb = spark.createDataFrame(pd.DataFrame({"x": np.array(b, dtype=float)}))
    p = dr.psi_table(ra, rb, ["x"]).first()["psi"]
    assert p >= -1e-12
    assert abs(dr.psi_table(ra, ra, ["x"]).first()["psi"]) < 1e-12


@SETTINGS
@given(a=values, b=values)
def test_ks_in_unit_interval(spark, a, b):
    ra = spark.createDataFrame(pd.DataFrame({"x": np.array(a, dtype=float)}))
    rb = spark.createDataFrame(pd.DataFrame({"x": np.array(b, dtype=float)}))
    r = dr.ks_test_raw(ra, rb, "x").first()
    assert 0.0 <= r["d"] <= 1.0 and 0.0 <= r["p"] <= 1.0
    ref = np.array(a, dtype=float)
    cur = np.array(b, dtype=float)
    grid = np.union1d(ref, cur)
    d = np.max(np.abs(np.searchsorted(np.sort(ref), grid, "right") / len(ref)
                      - np.searchsorted(np.sort(cur), grid, "right") / len(cur)))
    assert abs(r["d"] - d) < 1e-12


@SETTINGS
@given(s=st.lists(st.tuples(st.integers(0, 20), st.integers(0, 1)), min_size=4, max_size=80))
def test_auc_symmetry(spark, s):
    pdf = pd.DataFrame(s, columns=["score", "is_fraud"]).astype({"score": float})
    if pdf.is_fraud.nunique() < 2:
        return
    df = spark.createDataFrame(pdf)
    a = ranking.auc_ap(df).first()["roc_auc"]
    b = ranking.auc_ap(df.withColumn("score", -F.col("score"))).first()["roc_auc"]
    assert abs(a + b - 1.0) < 1e-12


@SETTINGS
@given(pairs=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=40))
def test_kappa_bounds(spark, pairs):
    df = spark.createDataFrame(pd.DataFrame(pairs, columns=["expected", "predicted"]))
    k = ag.cohen_kappa(df).first()["cohen_kappa"]
    assert -1.0 - 1e-9 <= k <= 1.0 + 1e-9
    if all(e == p for e, p in pairs):
        assert abs(k - 1.0) < 1e-9


def test_approx_edges_close_to_exact(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=5000), "y": rng.exponential(size=5000)}))
    long = dr.to_long(df, ["x", "y"])
    ex = {r["feature"]: r["edges"] for r in dr.reference_edges(long).collect()}
    ap = {r["feature"]: r["edges"] for r in dr.reference_edges(long, approx=True).collect()}
    for f in ("x", "y"):
        assert len(ex[f]) == len(ap[f])
        vals = np.sort(df.select(f).toPandas()[f].to_numpy())
        for a, b in zip(ex[f], ap[f]):
            ra, rb = np.searchsorted(vals, a), np.searchsorted(vals, b)
            assert abs(ra - rb) <= 5            # rank error of the sketch
    p_ex = dr.psi_table(df, df, ["x", "y"]).collect()
    p_ap = dr.psi_table(df, df, ["x", "y"], approx=True).collect()
    assert all(abs(r["psi"]) < 1e-12 for r in p_ex + p_ap)
