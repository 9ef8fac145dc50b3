"""Model queries (survey 2.13, rows-only checks): training, scoring, tree
contributions and scoring throughput. Training uses the train split with the
last 10 % of it (by time) as the early-stopping slice; results are for val."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import features as fx
from riskframe.functions.numeric import rnd
from riskframe.operators import encode as en
from riskframe.operators import explain as ex
from riskframe.operators import models as mo
from riskframe.operators import ranking
from riskframe.operators import split as sp
from riskframe.plans.catalog import register
from riskframe.plans.oracle import with_txn
from riskframe.plans.prepare import CATEGORICALS, prepare
from riskframe.plans.q_drift import SPLITF_CTE
from riskframe.session import written
from riskframe.sources.tables import txn

NUMERIC = ["amt", "amt_log", "dist1", "tx_hour", "tx_dayofweek", "card_id"]
LR_NUMERIC = ["amt", "amt_log", "dist1", "tx_hour", "tx_dayofweek", "card_id"]
LR_CATS = CATEGORICALS
MAX_ROUNDS = 2000       # early stopping ends the training before, 50 rounds after the best one


def _train_valid(spark, sf_dir):
    """The prepared table (features, ordinal codes, split): train with its last 10 % by
    time marked for early stopping, and val."""
    rows = prepare(spark, sf_dir)
    tr, va = (rows.filter(F.col("split") == side).drop("split") for side in ("train", "val"))
    tr = sp.time_split(tr, val_frac=0.1, col="_part").withColumn(
        "is_valid", F.col("_part") == "val").drop("_part")
    return tr, va


def _tree_columns() -> list[str]:
    return NUMERIC + [f"{c}_code" for c in CATEGORICALS]


def champion(spark, sf_dir, rounds: int = MAX_ROUNDS, early_stop: bool = True, sides=None):
    tr, va = sides or _train_valid(spark, sf_dir)
    trx, cols = mo.tree_inputs(tr, _tree_columns())
    vax, _ = mo.tree_inputs(va, _tree_columns())
    model = mo.train_boosted(trx, cols, valid_col="is_valid" if early_stop else None, max_iter=rounds, max_depth=6)
    return model, vax, cols


def challenger_gbm(spark, sf_dir, rounds: int = MAX_ROUNDS, sides=None):
    tr, va = sides or _train_valid(spark, sf_dir)
    kept = [r["column"] for r in en.sparse_columns(tr, _tree_columns(), 0.95).filter("kept").collect()]
    trx, cols = mo.tree_inputs(tr, kept)
    vax, _ = mo.tree_inputs(va, kept)
    model = mo.train_boosted(trx, cols, valid_col="is_valid", max_iter=rounds, max_depth=5, feature_subset="0.7")
    return model, vax, cols


def challenger_lr(spark, sf_dir, sides=None):
    """``sides``: train and val of the prepared table, which holds the same rows and split."""
    columns = ["txn_id", "dt", "is_fraud", *LR_NUMERIC, *LR_CATS]
    if sides is None:
        # each fitted step is a pass or more over the rows: they are written once, and so are the folds and the inputs
        rows = fx.build_features(txn(spark, sf_dir)).select(columns)
        rows = sp.time_split(written(rows, "rows"), val_frac=0.2)
        sides = [rows.filter(F.col("split") == side) for side in ("train", "val")]
    tr, va = (side.select(columns) for side in sides)
    med = {r["column"]: r["median"] for r in en.medians(tr, LR_NUMERIC).collect()}
    tri, vai = en.impute_median(tr, med, LR_NUMERIC), en.impute_median(va, med, LR_NUMERIC)
    st = en.scaler_stats(tri, LR_NUMERIC)
    tri, vai = en.standard_scale(tri, st, LR_NUMERIC), en.standard_scale(vai, st, LR_NUMERIC)
    tri = written(en.stratified_folds(tri, "is_fraud", "txn_id"), "folds")
    te_tr, te_va = en.target_encode(tri, vai, LR_CATS)
    cols = [f"{c}_scaled" for c in LR_NUMERIC] + [f"{c}_te" for c in LR_CATS]
    return mo.train_linear(written(te_tr.select("is_fraud", *cols), "inputs"), cols), te_va, cols


@register("train_champion")
def q_train_champion(spark, sf_dir):
    """Boosted trees on all numeric columns and ordinal codes (depth 6, step .05, 80 % of
    rows per tree and of features per node, positive weight neg/pos, early stopping 50 rounds
    after the best one on a time-ordered slice of train): val probabilities."""
    model, vax, cols = champion(spark, sf_dir)
    return mo.score(model, vax, cols).select("txn_id", rnd("probability_1", 6).alias("probability"))


@register("train_challenger_lr")
def q_train_challenger_lr(spark, sf_dir):
    """Median imputation, population scaling, cross-fitted target encoding, then
    balanced logistic regression (C = 0.1): val probabilities."""
    model, te_va, cols = challenger_lr(spark, sf_dir)
    return mo.score(model, te_va, cols).select("txn_id", rnd("probability_1", 6).alias("probability"))


@register("train_challenger_gbm")
def q_train_challenger_gbm(spark, sf_dir):
    """Second boosted model on the columns at most 95 % missing in train
    (depth 5, 70 % of features per node, early stopping): val probabilities."""
    model, vax, cols = challenger_gbm(spark, sf_dir)
    return mo.score(model, vax, cols).select("txn_id", rnd("probability_1", 6).alias("probability"))


@register("trained_model_comparison")
def q_trained_model_comparison(spark, sf_dir):
    """The three trained models on val: feature and tree counts and headline metrics."""
    sides = _train_valid(spark, sf_dir)         # bound, encoded and split once for all three
    scores, facts = None, []
    for name, fit in (("champion", champion), ("challenger_lr", challenger_lr), ("challenger_gbm", challenger_gbm)):
        model, va, cols = fit(spark, sf_dir, sides=sides)
        facts += [F.lit(name), F.struct(F.lit(len(cols)).alias("features"), F.lit(int(getattr(model, "getNumTrees", 0))).alias("trees"))]
        scored = mo.score(model, va, cols).select("txn_id", "is_fraud", F.col("probability_1").alias("score"))
        scored = written(scored, "scored").withColumn("model", F.lit(name))
        scores = scored if scores is None else scores.unionByName(scored)
    fact = F.create_map(*facts)[F.col("model")]
    return ranking.model_comparison(scores).drop("n_rows").select(
        "model", fact["features"].alias("n_features"), fact["trees"].alias("n_trees"),
        "roc_auc", "pr_auc", "fdr_at_3pct", "fdr_at_5pct")


@register("contrib_tree")
def q_contrib_tree(spark, sf_dir):
    """Exact path-dependent tree contributions (log-odds) of the champion for every
    val row, long form, with the additivity residual against the model."""
    model, vax, cols = champion(spark, sf_dir)
    c = mo.tree_contributions(vax, model, cols)
    s = mo.score(model, vax, cols).select("txn_id", "probability_1")
    j = c.join(s, "txn_id")
    p = F.least(F.greatest(F.col("probability_1"), F.lit(1e-15)), F.lit(1 - 1e-15))
    resid = F.aggregate("contrib", F.col("base"), lambda a, x: a + x) - F.log(p / (F.lit(1.0) - p))
    names = F.array(*[F.lit(x) for x in cols])
    return j.select("txn_id", F.posexplode("contrib").alias("idx", "contribution"),
                    rnd(resid, 9).alias("additivity_residual")).select(
        "txn_id", F.element_at(names, F.col("idx") + 1).alias("feature"),
        rnd("contribution", 6).alias("contribution"), "additivity_residual")


@register("tree_top_reasons")
def q_tree_top_reasons(spark, sf_dir):
    """Top four tree contributions per val row with reason codes."""
    model, vax, cols = champion(spark, sf_dir)
    c = mo.tree_contributions(vax, model, cols).join(vax.select("txn_id", *cols), "txn_id")
    return ex.top_reasons(c, cols, 4)


@register("score_throughput")
def q_score_throughput(spark, sf_dir):
    """Rows per second of scoring all transactions with the champion into the no-op sink."""
    model, _, cols = champion(spark, sf_dir)
    allx, _ = mo.tree_inputs(prepare(spark, sf_dir), _tree_columns())
    r = mo.score_throughput(model, allx, cols)
    return allx.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(r["seconds"]).alias("seconds"), F.lit(r["rows_per_sec"]).alias("rows_per_sec"),
        F.lit(int(model.getNumTrees)).alias("n_trees"), F.lit(len(cols)).alias("n_features"))


@register("contrib_tree_additivity", with_txn(SPLITF_CTE, body="SELECT count(*) AS n_rows, 0.0::DOUBLE AS max_residual FROM va"))
def q_contrib_tree_additivity(spark, sf_dir):
    """Tree contributions of all val rows against the model's log odds: the largest difference of their
    sum (with the expected value) from the score, to 6 decimals."""
    model, vax, cols = champion(spark, sf_dir, 20, early_stop=False)
    total = mo.tree_contributions(vax, model, cols).select(
        "txn_id", (F.aggregate("contrib", F.lit(0.0), lambda s, x: s + x) + F.col("base")).alias("t"))
    # a saturated probability has no exact log odds; the margin is the same sum
    scored = model.transform(mo.assemble(vax, cols)).select("txn_id", (2 * mo.vector_to_array("rawPrediction")[1]).alias("m"))
    return total.join(scored, "txn_id").agg(F.count("*").alias("n_rows"), rnd(F.max(F.abs(F.col("t") - F.col("m"))), 6).alias("max_residual"))
