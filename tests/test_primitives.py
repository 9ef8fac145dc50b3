"""Distributed primitives against brute force on small frames, including a hot
key holding a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import prefix, quantiles, ranking
from riskframe.operators import encode as en
from riskframe.operators import split as sp


def _frame(spark, n=3000, hot_share=1 / 3, seed=7):
    rng = np.random.default_rng(seed)
    score = rng.random(n).round(3)
    hot = rng.random(n) < hot_share
    score[hot] = 0.5                                   # one score holds a third of the rows
    pdf = pd.DataFrame({"txn_id": rng.permutation(n).astype("int64"), "score": score,
                        "is_fraud": (rng.random(n) < 0.1).astype("int32"),
                        "dt": np.where(hot, 1000, rng.integers(0, 5000, n)).astype("int64")})
    return spark.createDataFrame(pdf), pdf


def test_running_sum_matches_cumsum(spark):
    df, pdf = _frame(spark)
    g = pdf.groupby("score").size().rename("n").reset_index().sort_values("score")
    out = prefix.running_sum(spark.createDataFrame(g), "score", ["n"], buckets=7).toPandas()
    out = out.sort_values("score")
    assert list(out["n_cum"]) == list(g["n"].cumsum())
    down = prefix.running_sum(spark.createDataFrame(g), "score", ["n"], descending=True, buckets=5)
    d = down.toPandas().sort_values("score", ascending=False)
    assert list(d["n_cum"]) == list(g.sort_values("score", ascending=False)["n"].cumsum())


def test_top_k_with_hot_tie_matches_brute_force(spark):
    df, pdf = _frame(spark)
    order = pdf.sort_values(["score", "txn_id"], ascending=[False, True])
    for k in (1, 500, 1500, 2500):
        tg = spark.createDataFrame([(0, k)], "tid int, k long")
        r = ranking.top_k_caught(df, tg).first()
        top = order.head(k)
        assert r["caught"] == int(top["is_fraud"].sum())
        assert r["threshold"] == float(top["score"].iloc[-1])


def test_auc_and_ap_match_definitions(spark):
    df, pdf = _frame(spark)
    y, s = pdf["is_fraud"].to_numpy(), pdf["score"].to_numpy()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    ths = np.unique(s)[::-1]
    ap, prev_r = 0.0, 0.0
    for t in ths:
        sel = s >= t
        tp = (y[sel] == 1).sum()
        rec, prec = tp / len(pos), tp / sel.sum()
        ap += (rec - prev_r) * prec
        prev_r = rec
    r = ranking.auc_ap(df).first()
    assert abs(r["roc_auc"] - auc) < 1e-12
    assert abs(r["pr_auc"] - ap) < 1e-12


def test_time_split_with_hot_timestamp(spark):
    df, pdf = _frame(spark)
    s = sp.time_split(df, 0.2).toPandas()
    order = pdf.sort_values(["dt", "txn_id"])
    n_train = int(len(pdf) * 0.8)
    expect = set(order.head(n_train)["txn_id"])
    assert set(s[s.split == "train"]["txn_id"]) == expect


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=700), np.full(300, 0.25)])
    df = spark.createDataFrame(pd.DataFrame({"v": v, "g": np.arange(1000) % 2}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 1.0]
    q = quantiles.exact_quantiles(df, "v", probs).toPandas().sort_values("qi")
    assert np.allclose(q["quantile"], np.percentile(v, [p * 100 for p in probs]), rtol=0, atol=1e-12)
    qg = quantiles.exact_quantiles(df, "v", [0.5], by=["g"]).toPandas().sort_values("g")
    for g, row in zip(qg["g"], qg["quantile"]):
        assert abs(row - np.median(v[np.arange(1000) % 2 == g])) < 1e-12


def test_ordinal_dictionary_is_sorted_rank(spark):
    vals = ["b", "a", "é", "ab", "a", None, "zz", "B"]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    d = en.ordinal_dictionary(df, ["c"]).toPandas().sort_values("code")
    distinct = sorted({v for v in vals if v is not None}, key=lambda x: x.encode("utf-8"))
    assert list(d["value"]) == distinct
    assert list(d["code"]) == list(range(len(distinct)))


def test_target_encoding_out_of_fold(spark):
    rng = np.random.default_rng(1)
    n = 600
    pdf = pd.DataFrame({"txn_id": np.arange(n), "cat": rng.choice(["a", "b", "c", None], n),
                        "is_fraud": (rng.random(n) < 0.2).astype(int)})
    pdf["fold"] = pdf["txn_id"] % 5
    tr, _ = en.target_encode(spark.createDataFrame(pdf), None, ["cat"])
    got = tr.toPandas().set_index("txn_id")["cat_te"]
    key = pdf["cat"].fillna(en.NULL_KEY)
    for i in [0, 7, 123, 599]:
        f, k = pdf.loc[i, "fold"], key[i]
        oof = pdf[(pdf.fold != f)]
        y = oof["is_fraud"].to_numpy(float)
        yc = oof.loc[key[oof.index] == k, "is_fraud"].to_numpy(float)
        ym, yv = y.mean(), y.var()
        if len(yc) == 0:
            exp = ym
        else:
            lam = yv * len(yc) / (yv * len(yc) + yc.var())
            exp = lam * yc.mean() + (1 - lam) * ym
        assert abs(got[i] - exp) < 1e-12


def test_card_history_with_empty_windows(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from riskframe.functions.features import build_features
    from riskframe.operators import history as hi
    from riskframe.sources.tables import txn
    from conftest import SF0001
    f = build_features(txn(spark, SF0001))
    out = hi.customer_history_all(f, days=1).toPandas().set_index("card_id")
    pdf = f.select("card_id", "dt", "amt", "product").toPandas()
    cut = pdf.dt.max() - 86400
    assert set(out.index) == set(pdf.card_id)
    for card, g in pdf.groupby("card_id"):
        w = g[g.dt >= cut]
        row = out.loc[card]
        assert row.n_transactions_in_window == len(w)
        if len(w) == 0:
            assert row.total_amount is None or np.isnan(row.total_amount)
            assert row.unique_products is None
        else:
            exact = (sum(Decimal(repr(a)) for a in w.amt) / len(w)).quantize(Decimal("0.01"), ROUND_HALF_UP)
            assert row.mean_amount == float(exact)
            assert row.unique_products == ",".join(sorted(set(w["product"])))
    assert (out.n_transactions_in_window == 0).any()


def test_nan_is_missing_in_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,), (3.0,)], "v double")
    q = quantiles.exact_quantiles(df, "v", [0.0, 0.5, 1.0]).toPandas().sort_values("qi")
    assert list(q["quantile"]) == [1.0, 2.0, 3.0]
    assert int(q["n"].iloc[0]) == 3


def test_empty_inputs(spark):
    from riskframe.operators import drift as dr
    from riskframe.operators import fairness as fa
    empty = spark.createDataFrame([], "txn_id long, score double, is_fraud int, dt long, product string")
    assert ranking.threshold_table(empty).count() == 0
    r = ranking.auc_ap(empty).collect()
    assert r == [] or r[0]["roc_auc"] is None
    assert sp.time_split(empty).count() == 0
    assert quantiles.exact_quantiles(empty, "score", [0.5]).count() == 0
    some = spark.createDataFrame([(1, 0.5, 0, 10, "a"), (2, 0.7, 0, 20, "b")],
                                 "txn_id long, score double, is_fraud int, dt long, product string")
    p = dr.psi_table(some, empty, ["score"]).collect()
    assert all(row["psi"] is None for row in p)
    m = fa.fairness_suite(some, ["product"], 0.6).collect()   # no positives: tpr NULL
    assert all(row["tpr"] is None for row in m)
    assert ranking.auc_ap(some).first()["roc_auc"] is None


def test_all_rows_share_one_score(spark):
    rng = np.random.default_rng(11)
    n = 2000
    pdf = pd.DataFrame({"txn_id": rng.permutation(n).astype("int64"), "score": 0.42,
                        "is_fraud": (rng.random(n) < 0.1).astype("int32")})
    df = spark.createDataFrame(pdf)
    order = pdf.sort_values("txn_id")
    for k in (1, 60, 1999):
        r = ranking.top_k_caught(df, spark.createDataFrame([(0, k)], "tid int, k long")).first()
        assert r["caught"] == int(order.head(k)["is_fraud"].sum())
    r = ranking.auc_ap(df).first()
    assert r["roc_auc"] == 0.5


def test_ks_with_an_empty_side(spark):
    from riskframe.operators import drift as dr
    a = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    e = spark.createDataFrame([], "x double")
    r = dr.ks_test_raw(a, e, "x").collect()
    assert r == [] or (r[0]["d"] is None)


def test_degenerate_aggregates(spark):
    from riskframe.operators import agreement as ag
    from riskframe.operators import profile as pf
    empty = spark.createDataFrame([], "is_fraud int, expected int, predicted int")
    assert pf.class_balance(empty).first()["fraud_rate"] is None
    assert ag.cohen_kappa(empty).first()["cohen_kappa"] == 0.0
    one_fold = spark.createDataFrame([(1, "a", 1, 0), (2, "b", 0, 0)], "txn_id long, cat string, is_fraud int, fold int")
    tr, _ = en.target_encode(one_fold, None, ["cat"])
    assert tr.count() == 2


def test_point_in_time_history_one_day(spark):
    from riskframe.operators import history as hi
    from riskframe.sources.tables import txn
    from conftest import SF0001
    t = txn(spark, SF0001)
    got = hi.card_history_point_in_time(t, days=1).toPandas().set_index("txn_id")
    pdf = t.select("txn_id", "card_id", "dt", "amt").toPandas()
    for card, g in pdf.groupby("card_id"):
        dts, amts = g["dt"].to_numpy(), g["amt"].to_numpy()
        for tid, d in zip(g["txn_id"], dts):
            m = (dts >= d - 86400) & (dts <= d - 1)
            assert got.loc[tid, "n_prior"] == m.sum()
            if m.sum():
                assert abs(got.loc[tid, "amount_prior"] - round(amts[m].sum(), 2)) < 1e-9


def test_running_sum_keeps_64_bit_ids_and_strings(spark):
    ids = spark.range(3000).select((F.col("id") + F.lit(1 << 60)).alias("k"), F.lit(1).cast("long").alias("n"))
    for target in (1, 1500, 3000):
        assert prefix.key_at_count(ids, "k", target).first()["k"] == (1 << 60) + target - 1
    names = spark.range(20000).select(F.format_string("customer_%08d", "id").alias("k"), F.lit(1).cast("long").alias("n"))
    out = prefix.running_sum(names, "k", ["n"], buckets=16)
    assert out.filter(F.col("n_cum") != F.substring("k", 10, 8).cast("long") + 1).count() == 0
    down = prefix.running_sum(names, "k", ["n"], buckets=5, descending=True)
    assert down.filter(F.col("n_cum") != 20000 - F.substring("k", 10, 8).cast("long")).count() == 0


def test_running_sum_hot_group_small_groups_and_null_group(spark):
    g = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, F.col("id") % 5000)
    rows = spark.range(60000).select(g.alias("g"), F.col("id").alias("k"), (F.col("id") % 7).alias("n")).repartition(5)
    out = prefix.running_sum(rows, "k", ["n"], by=["g"], buckets=40).toPandas()
    out["g"] = out["g"].fillna(-9)
    out = out.sort_values(["g", "k"])
    assert (out.groupby("g")["n"].cumsum() == out["n_cum"]).all()
    few = spark.createDataFrame([(None, None, 2), (None, "a", 1), ("x", "b", 5)], "g string, k string, n long")
    assert sorted(r["n_cum"] for r in prefix.running_sum(few, "k", ["n"], by=["g"]).collect()) == [2, 3, 5]


def test_mean_half_up_at_the_ends(spark):
    from riskframe.functions.numeric import mean_half_up
    for value, n, digits, expected in ((1e12, 1000, 8, 1e12), (3e-11, 10, 12, 3e-11), (1e18, 1000, 4, 1e18),
                                       (-2.5, 3, 0, -3.0), (44.795, 64, 2, 44.8), (1e30, 2, 4, 1e30)):
        df = spark.createDataFrame([(value,)] * n, "v double")
        assert df.agg(mean_half_up("v", digits).alias("m")).first()["m"] == expected
    assert spark.createDataFrame([(None,)], "v double").agg(mean_half_up("v", 2).alias("m")).first()["m"] is None


def test_target_and_ordinal_codes_with_mostly_null_keys(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("c"), (F.col("id") % 35).cast("string"))).alias("c"))
    d = en.ordinal_dictionary(rows, ["c"])
    out = en.apply_ordinal(rows, d, ["c"])
    assert out.count() == 5000 and out.filter("c is null and c_code is not null").count() == 0
    assert out.filter("c is not null and c_code is null").count() == 0


def test_stream_reads_directory_tables(spark, tmp_path):
    from conftest import SF0001
    from riskframe.streaming import monitors as mon
    for t in ("events", "customer"):
        spark.read.parquet(f"{SF0001}/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    a, b = ({tuple(r) for r in mon.score_bins_stream(spark, p, [0.1, 0.5]).collect()} for p in (SF0001, str(tmp_path)))
    assert a == b and sum(r[2] for r in a) > 0


def test_checkpoint_folder_is_shared_or_refused():
    import pytest
    from riskframe.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context, Conf()
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session)


# ---- looking up without hot keys

@pytest.fixture
def by_shuffle(spark, monkeypatch):
    """Nothing is broadcast for its size, and partitions stay as they are dealt."""
    from riskframe.operators import lookup
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def _hot_rows(spark, rows=40_000):
    """80 % NULL, a tenth one value, the rest 2,000 values."""
    part = F.pmod(F.col("id"), F.lit(10))
    c = F.when(part < 8, F.lit(None).cast("string")).when(part == 8, F.lit("hot")).otherwise(
        F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(2000)).cast("string")))
    return spark.range(rows).repartition(4).select(F.col("id").alias("txn_id"), c.alias("c"),
                                                   F.pmod(F.col("id"), F.lit(5)).alias("fold"),
                                                   (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(7)) == 0).cast("int").alias("is_fraud"))


def _even(df):
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    return sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_ordinal_codes_with_hot_and_missing_values(spark, by_shuffle):
    df = _hot_rows(spark)
    out = en.apply_ordinal(df, en.ordinal_dictionary(df, ["c"]), ["c"])
    assert out.columns == [*df.columns, "c_code"]
    rows = out.collect()
    rank = {v: float(i) for i, v in enumerate(sorted({r.c for r in rows if r.c is not None}))}
    assert len(rows) == 40_000 and all(r.c_code == rank.get(r.c) for r in rows)
    assert _even(out)


def test_target_encoding_with_hot_and_missing_values(spark, by_shuffle, monkeypatch):
    from riskframe.operators import lookup
    df = _hot_rows(spark, 20_000)
    tr, ot = en.target_encode(df, df.select("txn_id", "c"), ["c"])
    shuffled = {r.txn_id: r.c_te for r in tr.collect()}, {r.txn_id: r.c_te for r in ot.collect()}
    assert _even(tr) and _even(ot)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 1 << 30)
    tr, ot = en.target_encode(df, df.select("txn_id", "c"), ["c"])
    assert shuffled == ({r.txn_id: r.c_te for r in tr.collect()}, {r.txn_id: r.c_te for r in ot.collect()})


def test_stratified_folds_hold_each_class(spark):
    df = spark.range(1003).select((F.col("id") * 7 + (1 << 60)).alias("txn_id"), (F.col("id") % 9 == 0).cast("int").alias("is_fraud"))
    folds = en.stratified_folds(df, "is_fraud", "txn_id")
    counts = {}
    for r in folds.groupBy("is_fraud", "fold").count().collect():
        counts.setdefault(r.is_fraud, []).append(r["count"])
    assert all(len(c) == 5 and max(c) - min(c) <= 1 for c in counts.values())
    again = en.stratified_folds(df.repartition(7), "is_fraud", "txn_id")
    assert sorted(folds.collect()) == sorted(again.collect())
    other = en.stratified_folds(df, "is_fraud", "txn_id", seed=1)
    assert sorted(other.collect()) != sorted(folds.collect())
