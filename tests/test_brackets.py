"""Order statistics and drift from sketch brackets, against numpy and plain Python."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import brackets, quantiles
from riskframe.operators import drift as dr

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 1.0]


@pytest.fixture(scope="module")
def groups():
    r = np.random.default_rng(7)
    return {"normal": r.normal(size=4000), "hot": np.concatenate([r.normal(size=2000), np.full(1500, 0.25)]),
            "few": r.integers(0, 3, 3000).astype(float), "one": np.full(2500, 7.5), "tiny": np.array([3.0, 1.0]),
            "wide": np.exp(r.normal(size=3000) * 20), "signs": np.concatenate([-r.exponential(size=1500), r.exponential(size=1500) + 5])}


@pytest.fixture(scope="module")
def frame(spark, groups):
    rows = pd.DataFrame([(g, float(x)) for g, v in groups.items() for x in v], columns=["g", "v"])
    nulls = spark.createDataFrame([(None, 1.0), (None, 2.0), ("normal", None), ("normal", float("nan")), ("empty", None)], "g string, v double")
    return spark.createDataFrame(rows).unionByName(nulls).repartition(6).cache()


def settings(monkeypatch, accuracy, small, finish):
    monkeypatch.setattr(brackets, "ACCURACY", accuracy)
    monkeypatch.setattr(brackets, "SMALL", small)
    monkeypatch.setattr(brackets, "FINISH_ROWS", finish)


@pytest.mark.parametrize("accuracy,small,finish", [(10_000, 20_000, 10 ** 6), (200, 600, 10 ** 6), (100, 300, 60)])
def test_quantiles_by_group_equal_numpy(spark, frame, groups, monkeypatch, accuracy, small, finish):
    settings(monkeypatch, accuracy, small, finish)
    got = {(r.g, r.qi): r for r in quantiles.exact_quantiles(frame, "v", PROBS, by=["g"]).collect()}
    assert len(got) == (len(groups) + 1) * len(PROBS)               # and the group without a name
    for g, v in groups.items():
        for i, q in enumerate(PROBS):
            assert got[g, i].n == len(v) and got[g, i].q == q
            assert math.isclose(got[g, i].quantile, np.percentile(v, q * 100), rel_tol=1e-12, abs_tol=1e-12), (g, q)
    assert got[None, 3].quantile == 1.5


def test_brackets_keep_few_rows(spark, frame, monkeypatch):
    settings(monkeypatch, 200, 600, 10 ** 6)
    v = F.nanvl(F.col("v"), F.lit(None))
    t = brackets.value_counts(frame.withColumn("x", v), "x", ["g"], [0.5]).groupBy("g").agg(
        F.count("*").alias("rows"), F.sum("_n").alias("n")).collect()
    kept = {r.g: r for r in t}
    assert kept["normal"].n == 4000 and kept["normal"].rows < 400
    assert kept["hot"].rows < 400 and kept["one"].rows <= 2
    settings(monkeypatch, 200, 50, 20)
    narrow = {r.g: r.rows for r in brackets.value_counts(frame.withColumn("x", v), "x", ["g"], [0.5]).groupBy("g").agg(
        F.count("*").alias("rows")).collect()}
    assert narrow["normal"] < kept["normal"].rows / 3


def test_many_groups_take_running_sums(spark, monkeypatch):
    monkeypatch.setattr(brackets, "MAX_GROUPS", 5)
    df = spark.range(300).select((F.col("id") % 20).alias("g"), (F.col("id") * 1.0).alias("v"))
    got = {r.g: r.quantile for r in quantiles.exact_quantiles(df, "v", [0.5], by=["g"]).collect()}
    assert got == {g: 140.0 + g for g in range(20)}


def plain_psi(ref, cur, buckets=10, eps=1e-4):
    ref, cur = ref[~np.isnan(ref)], cur[~np.isnan(cur)]
    if not len(ref) or not len(cur):
        return None, None
    inner = np.unique(np.percentile(ref, [100 * i / buckets for i in range(1, buckets)]))
    edges = np.concatenate([[-np.inf], inner, [np.inf]])
    r, c = np.histogram(ref, edges)[0], np.histogram(cur, edges)[0]
    rp, cp = ((x + eps) / (x.sum() + eps * len(x)) for x in (r, c))
    return (0.0 if len(edges) < 3 else float(((cp - rp) * np.log(cp / rp)).sum())), list(zip(r.tolist(), c.tolist()))


@pytest.mark.parametrize("accuracy,small,finish", [(10_000, 20_000, 10 ** 6), (100, 300, 60)])
def test_feature_bins_equal_numpy(spark, monkeypatch, accuracy, small, finish):
    settings(monkeypatch, accuracy, small, finish)
    r = np.random.default_rng(11)

    def side(n, shift):
        holes = r.random(n) < 0.3
        return pd.DataFrame({"a": r.normal(size=n) + shift, "b": np.where(holes, np.nan, r.integers(0, 6, n) + shift),
                             "flat": np.full(n, 2.0), "never": np.full(n, np.nan), "late": np.full(n, np.nan if not shift else 1.0),
                             "hot": np.where(r.random(n) < 0.4, 0.5, r.random(n))})
    ref, cur = side(3000, 0), side(2000, 0.4)
    names = list(ref.columns)
    both = dr.tag_sides(spark.createDataFrame(ref), spark.createDataFrame(cur), names)
    bins = {x.feature: x for x in dr.feature_bins(both, names).collect()}
    psi = {x.feature: x.psi for x in dr.psi_of(both, names).collect()}
    report = {x.feature: x for x in dr.feature_report_of(both, names).collect()}
    assert set(bins) == set(report) == set(names)
    for name in names:
        expected, counts = plain_psi(ref[name].to_numpy(), cur[name].to_numpy())
        if expected is None:
            assert psi.get(name) is None and report[name].psi is None and report[name].stability == "unknown"
        else:
            assert math.isclose(psi[name], expected, abs_tol=1e-12), name
            assert [tuple(b) for b in bins[name].bins] == counts, name
        for s, pdf in (("ref", ref), ("cur", cur)):
            assert report[name][f"{s}_missing_pct"] == pytest.approx(100 * pdf[name].isna().mean(), abs=0.0501)
            if pdf[name].notna().any():
                assert report[name][f"{s}_mean"] == pytest.approx(pdf[name].mean(), abs=0.000051)
            else:
                assert report[name][f"{s}_mean"] is None


def test_score_drift_equals_numpy(spark):
    r = np.random.default_rng(5)
    ref, cur = np.round(r.random(3000), 3), np.concatenate([np.round(r.random(1500) ** 2, 3), np.full(500, 0.125)])
    frames = [spark.createDataFrame(pd.DataFrame({"score": x})) for x in (ref, cur)]
    row = dr.score_drift_report(*frames).first()
    grid = np.unique(np.concatenate([ref, cur]))
    d = max(abs((ref <= x).mean() - (cur <= x).mean()) for x in grid)
    assert row.ks_statistic == round(d, 5) and row.drift_detected and row.action_required
    assert row.psi == pytest.approx(plain_psi(ref, cur)[0], abs=1e-5)
    assert row.ref_mean_score == pytest.approx(ref.mean(), abs=1e-5) and row.cur_mean_score == pytest.approx(cur.mean(), abs=1e-5)
    assert row.ref_p95_score == pytest.approx(np.percentile(ref, 95), abs=1e-5)
    assert row.cur_p95_score == pytest.approx(np.percentile(cur, 95), abs=1e-5)
    none = dr.score_drift_report(frames[0], frames[1].limit(0)).collect()
    assert len(none) == 1 and none[0].psi is None and none[0].ref_mean_score is not None and none[0].cur_mean_score is None


def test_drift_plans_do_not_join_on_features(spark):
    import __spark_entry__ as entry
    from conftest import SF0001
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, most in (("score_drift_report", 15), ("deployment_drift", 30), ("feature_psi_report", 15)):
            plan = entry.queries()[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") <= most, name
            assert "SortMergeJoin [feature" not in plan and "SortMergeJoin [side" not in plan, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_exact_ks_equals_path_counts(spark):
    from fractions import Fraction
    from functools import cache

    for n, m in ((1, 1), (3, 5), (7, 7), (12, 9), (20, 33)):
        for gap in {0, 1, n, m, n * m // 3, n * m // 2, n * m}:
            @cache
            def inside(i, j):
                if i < 0 or j < 0 or abs(i * m - j * n) >= gap:
                    return 0
                return 1 if i == j == 0 else inside(i - 1, j) + inside(i, j - 1)
            expected = 1 - Fraction(inside(n, m), math.comb(n + m, n))
            assert math.isclose(dr.exact_ks_p(n, m, gap), float(expected), abs_tol=1e-12)
    r = np.random.default_rng(2)
    a, b = (spark.createDataFrame(pd.DataFrame({"x": v})) for v in (r.random(60), r.random(80) + 0.2))
    small, large = dr.ks_test_auto(a, b, "x").first(), dr.ks_test_auto(a, b, "x", exact_up_to=79).first()
    assert small.method == "exact" and large.method == "asymptotic" and small.ks_statistic == large.ks_statistic
    assert large.p_value == dr.ks_test(a, b, "x").first().p_value and abs(small.p_value - large.p_value) < 0.01
    assert dr.ks_test_auto(a, b.limit(0), "x").first().p_value is None
    assert abs(dr.exact_ks_p(3000, 2000, int(0.05 * 6_000_000)) - 0.004) < 0.002        # no overflow


def test_first_values_of_a_hot_key(spark):
    from riskframe.operators.history import first_values
    rows = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id") % 50).alias("card"),
                                      F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("mail"))
    got = {r.card: r.m for r in first_values(rows, "card", "mail", "m").collect()}
    expected = {}
    for i in range(60_000):
        expected.setdefault(1 if i % 2 == 0 else i % 50, []).append(f"d{i:06d}")
    assert got == {k: ",".join(v[:5]) for k, v in expected.items()}
    plan = first_values(rows, "card", "mail", "m")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
