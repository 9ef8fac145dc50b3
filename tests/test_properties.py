"""Preprocessing properties on rows with hot ties, NULLs and 64-bit ids."""

from pyspark.sql import functions as F

from riskframe.functions.features import build_features
from riskframe.operators import encode as en
from riskframe.operators import ordering as od
from riskframe.operators import split as sp


def test_row_conservation_and_engineered_columns(fixture_txn):
    f = build_features(fixture_txn)
    s = sp.time_split(f, 0.2)
    assert s.count() == fixture_txn.count()
    for c in ("amt_log", "uid_card_email", "tx_hour", "tx_dayofweek"):
        assert c in s.columns


def test_no_temporal_leakage(fixture_txn):
    s = sp.time_split(fixture_txn, 0.2)
    r = sp.split_report(s).first()
    assert r["train_max_dt"] <= r["val_min_dt"]
    assert r["no_leakage"]


def test_order_kept_in_both_splits(fixture_txn, spark, tmp_path):
    s = od.sorted_by_range(sp.time_split(fixture_txn, 0.2), ["split", "dt", "txn_id"], 6)
    s.write.partitionBy("split").parquet(str(tmp_path / "t"))
    out = {r.split: r for r in od.written_order(spark.read.parquet(str(tmp_path / "t")), "dt").collect()}
    assert set(out) == {"train", "val"} and sum(r.n_rows for r in out.values()) == s.count()
    assert all(r.n_violations == 0 for r in out.values()) and out["train"].n_files > 1


def test_planted_swaps_are_counted(spark, tmp_path):
    """A row out of order inside a file, two files in the wrong order, NULL times between."""
    files = [[1, 2, 5, 3, None, 4], [None], [9, 10], [6, 7, 8]]
    for i, values in enumerate(files):
        spark.createDataFrame([(v,) for v in values], "dt long").coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
        (tmp_path / "t" / "split=val").mkdir(parents=True, exist_ok=True)
        part = next((tmp_path / f"f{i}").glob("*.parquet"))
        (tmp_path / "t" / "split=val" / f"part-{i:05d}.parquet").write_bytes(part.read_bytes())
    out = od.written_order(spark.read.parquet(str(tmp_path / "t")), "dt").collect()
    assert [(r.n_rows, r.n_files, r.n_violations) for r in out] == [(12, 4, 2)]


def test_unseen_category_is_missing(fixture_txn):
    s = sp.time_split(fixture_txn, 0.2)
    tr = s.filter(F.col("split") == "train")
    va = s.filter(F.col("split") == "val").withColumn(
        "product", F.when(F.col("txn_id") % 2 == 0, F.lit("NEVER_SEEN")).otherwise(F.col("product")))
    d = en.ordinal_dictionary(tr, ["product"])
    enc = en.apply_ordinal(va, d, ["product"])
    bad = enc.filter((F.col("product") == "NEVER_SEEN") & F.col("product_code").isNotNull()).count()
    assert bad == 0
    assert enc.filter(F.col("product") == "NEVER_SEEN").count() > 0


def test_split_fraction_within_one_row(fixture_txn):
    n = fixture_txn.count()
    for frac in (0.2, 0.25, 0.5):
        s = sp.time_split(fixture_txn, frac)
        n_val = s.filter(F.col("split") == "val").count()
        assert abs(n_val - n * frac) <= 1
