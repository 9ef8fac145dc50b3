"""Rolling windows from day tables against plain Python, with ties and a hot score."""

import numpy as np
import pandas as pd

from riskframe.operators import ranking, rolling


def plain(rows, by):
    out = {}
    for g, part in rows.groupby(by):
        part = part.sort_values(["score", "txn_id"], ascending=[False, True])
        y, s, n = part.is_fraud.to_numpy(), part.score.to_numpy(), len(part)
        p = int(y.sum())
        auc = ap = None
        if 0 < p < n:
            auc = sum(((s[y == 0] < x).sum() + (s[y == 0] == x).sum() / 2) for x in s[y == 1]) / (p * (n - p))
        if p:
            ap = sum(y[s == x].sum() * y[s >= x].sum() / (s >= x).sum() for x in np.unique(s)) / p
        fdr = [y[:max(1, int(n * r))].sum() / p if p else None for r in (0.03, 0.05)]
        out[g] = (n, p, auc, ap, *fdr)
    return out


def same(row, expected, rounded=4):
    assert tuple(row[:2]) == expected[:2]
    for a, b in zip(row[2:], expected[2:]):
        assert (a is None and b is None) or abs(a - b) <= 0.5001 * 10 ** -rounded, (row, expected)


def transactions(n=2500, days=75, seed=3):
    r = np.random.default_rng(seed)
    score = np.where(r.random(n) < 1 / 3, 0.9, r.integers(0, 40, n) / 40)          # a third shares one score
    return pd.DataFrame({"txn_id": r.permutation(n) + (1 << 60), "dt": r.integers(0, days * rolling.DAY, n),
                         "score": score, "is_fraud": (r.random(n) < 0.2).astype(int)})


def test_rolling_metrics_equal_brute_force(spark):
    rows = transactions()
    for length, slide in ((30, 7), (10, 4), (7, 7)):
        got = {r.window_start: r for r in rolling.rolling_metrics(spark.createDataFrame(rows).repartition(5), length * rolling.DAY,
                                                                  slide * rolling.DAY).collect()}
        at = rows.dt + rolling.EPOCH_2024
        parts = []
        for k in range(-(-length // slide)):
            start = at - at % (slide * rolling.DAY) - k * slide * rolling.DAY
            parts.append(rows.assign(w=start)[start + length * rolling.DAY > at])
        expected = plain(pd.concat(parts), "w")
        assert set(got) == set(expected)
        for w, e in expected.items():
            r = got[w]
            same((r.n_rows, r.n_pos, r.roc_auc, r.pr_auc, r.fdr_at_3pct, r.fdr_at_5pct), e)


def test_windows_without_positives_or_rows(spark):
    schema = "txn_id long, dt long, score double, is_fraud int"
    assert rolling.rolling_metrics(spark.createDataFrame([], schema)).count() == 0
    out = rolling.rolling_metrics(spark.createDataFrame([(1, 10, 0.5, 0), (2, 20, 0.5, 0), (3, None, 0.1, 1)], schema)).collect()
    assert out and all(r.n_rows == 2 and r.roc_auc is None and r.fdr_at_3pct is None for r in out)


def test_model_comparison_equals_brute_force(spark):
    a, b = transactions(seed=1).assign(model="a"), transactions(900, seed=2).assign(model="b")
    rows = pd.concat([a, b])
    expected = plain(rows, "model")
    for r in ranking.model_comparison(spark.createDataFrame(rows)).collect():
        n, p, *rest = expected[r.model]
        same((r.n_rows, 0, r.roc_auc, r.pr_auc, r.fdr_at_3pct, r.fdr_at_5pct), (n, 0, *rest))


def test_rolling_plan_has_no_join_on_the_window(spark):
    import __spark_entry__ as entry
    from conftest import SF0001
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = entry.queries()["rolling_30d_metrics"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
