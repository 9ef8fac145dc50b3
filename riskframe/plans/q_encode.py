"""Encoder queries (survey 2.4, 2.5) fitted on the train split."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.numeric import rnd
from riskframe.operators import encode as en
from riskframe.plans.catalog import register
from riskframe.plans.oracle import with_txn
from riskframe.plans.q_drift import SPLITF_CTE, splits

CATS = ["product", "email", "device", "uid_card_email"]
TE_CATS = ["product", "email", "device"]
NUMS = ["amt", "dist1"]


def _dict_cte(c: str) -> str:
    return (f"d_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM "
            f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM tr WHERE {c} IS NOT NULL))")


_DICTS = ",\n".join(_dict_cte(c) for c in CATS)


def _codes_select(src: str) -> str:
    cols = ", ".join(f"d_{c}.code AS {c}_code" for c in CATS)
    joins = " ".join(f"LEFT JOIN d_{c} ON CAST({src}.{c} AS VARCHAR) = d_{c}.v" for c in CATS)
    return f"SELECT {src}.txn_id, {src}.split, {cols} FROM {src} {joins}"


@register("ordinal_encode", with_txn(SPLITF_CTE, _DICTS, body=_codes_select("sf")))
def q_ordinal_encode(spark, sf_dir):
    """Codes = 0-based rank of sorted distinct train values; missing and unseen -> NULL (all rows)."""
    tr, va = splits(spark, sf_dir)
    d = en.ordinal_dictionary(tr, CATS)
    rows = tr.unionByName(va)
    enc = en.apply_ordinal(rows, d, CATS)
    return enc.select("txn_id", "split", *[f"{c}_code" for c in CATS])


@register("join_dictionary", with_txn(SPLITF_CTE, _DICTS, "enc AS (" + _codes_select("va") + ")", body="""
SELECT * FROM (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(CASE WHEN va.{c} IS NULL THEN 1 END) AS n_missing,"
    f" count(CASE WHEN va.{c} IS NOT NULL AND enc.{c}_code IS NULL THEN 1 END) AS n_unseen"
    f" FROM va JOIN enc ON va.txn_id = enc.txn_id" for c in CATS) + ")"))
def q_join_dictionary(spark, sf_dir):
    """Val rows through the train dictionaries: rows, missing and unseen counts per column."""
    tr, va = splits(spark, sf_dir)
    enc = en.apply_ordinal(va, en.ordinal_dictionary(tr, CATS), CATS)
    return en.unseen_counts(enc, CATS)


def _te_sql_expr(n, s, yn, ys):
    ym = f"(CAST({ys} AS DOUBLE) / {yn})"
    yv = f"({ym} - {ym} * {ym})"
    mc = f"(CAST({s} AS DOUBLE) / {n})"
    vc = f"({mc} - {mc} * {mc})"
    lam = f"(({yv} * {n}) / ({yv} * {n} + {vc}))"
    return (f"CASE WHEN {n} = 0 THEN {ym} WHEN ({yv} * {n} + {vc}) = 0 THEN {ym} "
            f"ELSE {lam} * {mc} + (1.0 - {lam}) * {ym} END")


def _te_ctes(fold: str = "txn_id % 5") -> str:
    out = [f"""tb AS (SELECT txn_id, {fold} AS fold, CAST(is_fraud AS DOUBLE) AS y, """ + ", ".join(
        f"coalesce(CAST({c} AS VARCHAR), '__missing__') AS k_{c}" for c in TE_CATS) + """ FROM tr),
fst AS (SELECT fold, count(*) AS fn, sum(y) AS fs FROM tb GROUP BY fold),
ftot AS (SELECT sum(fn) AS N, sum(fs) AS S FROM fst),
vb AS (SELECT txn_id, """ + ", ".join(
        f"coalesce(CAST({c} AS VARCHAR), '__missing__') AS k_{c}" for c in TE_CATS) + """ FROM va)"""]
    for c in TE_CATS:
        out.append(f"""per_{c} AS (SELECT fold, k_{c} AS k, count(*) AS n, sum(y) AS s FROM tb GROUP BY fold, k_{c}),
all_{c} AS (SELECT k, sum(n) AS Nc, sum(s) AS Sc FROM per_{c} GROUP BY k),
oof_{c} AS (SELECT p.fold, p.k, {_te_sql_expr('(a.Nc - p.n)', '(a.Sc - p.s)', '(ftot.N - f.fn)', '(ftot.S - f.fs)')} AS e
            FROM per_{c} p JOIN all_{c} a ON p.k = a.k JOIN fst f ON p.fold = f.fold, ftot),
full_{c} AS (SELECT a.k, {_te_sql_expr('a.Nc', 'a.Sc', 'ftot.N', 'ftot.S')} AS e FROM all_{c} a, ftot)""")
    return ",\n".join(out)


_TE_BODY = """
SELECT tb.txn_id, 'train' AS split, """ + ", ".join(f"round(o_{c}.e, 6) AS {c}_te" for c in TE_CATS) + """
FROM tb """ + " ".join(f"LEFT JOIN oof_{c} o_{c} ON tb.fold = o_{c}.fold AND tb.k_{c} = o_{c}.k" for c in TE_CATS) + """
UNION ALL
SELECT vb.txn_id, 'val' AS split, """ + ", ".join(
    f"round(coalesce(f_{c}.e, (SELECT CAST(S AS DOUBLE) / N FROM ftot)), 6) AS {c}_te" for c in TE_CATS) + """
FROM vb """ + " ".join(f"LEFT JOIN full_{c} f_{c} ON vb.k_{c} = f_{c}.k" for c in TE_CATS)
STRATIFIED_SQL = ("(row_number() OVER (PARTITION BY is_fraud ORDER BY md5(concat(CAST(txn_id AS VARCHAR), ':', '42')), txn_id) - 1) % 5")


def _target_encoded(trf, va):
    te_tr, te_va = en.target_encode(trf, va, TE_CATS)
    cols = [rnd(f"{c}_te", 6).alias(f"{c}_te") for c in TE_CATS]
    return (te_tr.select("txn_id", F.lit("train").alias("split"), *cols)
            .unionByName(te_va.select("txn_id", F.lit("val").alias("split"), *cols)))


@register("target_encode", with_txn(SPLITF_CTE, _te_ctes(), body=_TE_BODY))
def q_target_encode(spark, sf_dir):
    """Binary target encoding (auto smoothing): train cross-fitted over 5 folds (id mod 5),
    val from all train rows; missing is its own category, unseen -> train mean."""
    tr, va = splits(spark, sf_dir)
    return _target_encoded(tr.withColumn("fold", F.pmod(F.col("txn_id"), F.lit(5))), va)


@register("target_encode_stratified", with_txn(SPLITF_CTE, _te_ctes(STRATIFIED_SQL), body=_TE_BODY))
def q_target_encode_stratified(spark, sf_dir):
    """Target encoding with seeded folds that hold each class's share to within one row."""
    tr, va = splits(spark, sf_dir)
    slim = tr.select("txn_id", "is_fraud", *TE_CATS)
    return _target_encoded(en.stratified_folds(slim, "is_fraud", "txn_id"), va)


_MED = ("med AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m FROM tr" for c in NUMS) + ")")


@register("impute_median", with_txn(SPLITF_CTE, _MED, body="""
SELECT txn_id, """ + ", ".join(
    f"round(coalesce(CAST({c} AS DOUBLE), (SELECT m FROM med WHERE col = '{c}')), 6) AS {c}" for c in NUMS) + """
FROM va
"""))
def q_impute_median(spark, sf_dir):
    """Val rows with missing numerics replaced by the exact train median."""
    tr, va = splits(spark, sf_dir)
    med = {r["column"]: r["median"] for r in en.medians(tr, NUMS).collect()}
    out = en.impute_median(va, med, NUMS)
    return out.select("txn_id", *[rnd(c, 6).alias(c) for c in NUMS])


@register("standard_scale", with_txn(SPLITF_CTE, _MED, """tri AS (SELECT """ + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT m FROM med WHERE col = '{c}')) AS {c}" for c in NUMS) + """ FROM tr),
vai AS (SELECT txn_id, """ + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT m FROM med WHERE col = '{c}')) AS {c}" for c in NUMS) + """ FROM va),
sts AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMS) + """ FROM tri)""", body="""
SELECT txn_id, """ + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}_scaled" for c in NUMS) + """ FROM vai, sts
"""))
def q_standard_scale(spark, sf_dir):
    """Val rows: median-imputed, then (x - train mean) / train population std."""
    tr, va = splits(spark, sf_dir)
    med = {r["column"]: r["median"] for r in en.medians(tr, NUMS).collect()}
    tri, vai = en.impute_median(tr, med, NUMS), en.impute_median(va, med, NUMS)
    st = en.scaler_stats(tri, NUMS)
    out = en.standard_scale(vai, st, NUMS)
    return out.select("txn_id", *[rnd(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in NUMS])


@register("class_weight", with_txn(SPLITF_CTE, body="""
SELECT count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS n_pos, count(*) - CAST(sum(is_fraud) AS BIGINT) AS n_neg,
       round(CAST(count(*) - sum(is_fraud) AS DOUBLE) / sum(is_fraud), 6) AS scale_pos_weight,
       round(CAST(count(*) AS DOUBLE) / (2 * sum(is_fraud)), 6) AS w_pos,
       round(CAST(count(*) AS DOUBLE) / (2 * (count(*) - sum(is_fraud))), 6) AS w_neg
FROM tr
"""))
def q_class_weight(spark, sf_dir):
    """Train class weights: neg/pos ratio and balanced weights n / (2 n_c)."""
    tr, _ = splits(spark, sf_dir)
    w = en.class_weight(tr)
    return w.select("n", "n_pos", "n_neg", *[rnd(c, 6).alias(c) for c in ["scale_pos_weight", "w_pos", "w_neg"]])


_SPARSE_COLS = ["amt", "dist1", "device", "email", "product"]


@register("drop_sparse_columns", with_txn(SPLITF_CTE, body="\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS missing_share,"
    f" avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE <= 0.95 AS kept FROM tr" for c in _SPARSE_COLS)))
def q_drop_sparse_columns(spark, sf_dir):
    """Train missing share per column; kept when at most 95 % missing."""
    tr, _ = splits(spark, sf_dir)
    s = en.sparse_columns(tr, _SPARSE_COLS, 0.95)
    return s.select("column", rnd("missing_share", 6).alias("missing_share"), "kept")


@register("prepare_tables", with_txn(SPLITF_CTE, _DICTS, body="""
SELECT x.txn_id, round(x.amt_log, 6) AS amt_log, x.tx_dayofweek, """ + ", ".join(f"{c}_code" for c in CATS) + """
FROM (""" + _codes_select("sf") + """) c JOIN sf x ON c.txn_id = x.txn_id
WHERE c.split = 'val'
"""))
def q_prepare_tables(spark, sf_dir):
    """Features, time split and train-fitted codes written once as parquet partitioned
    by split (shared folder), then the val partition read back."""
    from riskframe.plans.prepare import prepare
    t = prepare(spark, sf_dir, force=True)
    return t.filter(F.col("split") == "val").select(
        "txn_id", rnd("amt_log", 6).alias("amt_log"), "tx_dayofweek", *[f"{c}_code" for c in CATS])
