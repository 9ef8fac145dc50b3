"""Encoders fitted on the train rows and applied to any rows.

* ordinal: code = 0-based rank of the sorted distinct train values; missing
  and unseen values stay NULL. The dictionary rank is a distributed running
  count (no single-task sort even for a key with a billion values); ``lookup``
  applies it.
* target: binary target encoding with empirical-Bayes smoothing, cross-fitted
  on train (a row's own fold never contributes to its value); other rows use
  the full train statistics. Out-of-fold sums are total minus fold; folds can be
  stratified by class in a seeded order.
* median imputation, population-std scaling, class weights, sparse-column drop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import lookup
from riskframe.operators.prefix import running_sum
from riskframe.operators.quantiles import exact_quantiles
from riskframe.session import written

NULL_KEY = "__missing__"   # stands for a missing category in target encoding


def ordinal_dictionary(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, code) for every distinct non-missing train value."""
    long = (train.select(*[F.col(c).cast("string").alias(c) for c in cols])
                 .unpivot([], list(cols), "column", "value")
                 .filter(F.col("value").isNotNull())
                 .groupBy("column", "value").agg(F.lit(1).cast("long").alias("_one")))
    ranked = running_sum(long, "value", ["_one"], by=["column"])
    return ranked.select("column", "value", (F.col("_one_cum") - 1).cast("double").alias("code"))


def apply_ordinal(df: DataFrame, dictionary: DataFrame, cols: Sequence[str],
                  suffix: str = "_code") -> DataFrame:
    """Add <col>_code from the dictionary (missing and unseen values -> NULL). The dictionary is
    written once; ``lookup`` keeps missing and hot values from meeting in one task."""
    d = written(dictionary, "dictionary")
    small = lookup.small_tables(d, "column", "value")
    empty = {c for c in cols} - {r["column"] for r in d.select("column").distinct().collect()}
    heavy = lookup.heavy_values(df, {c: F.col(c) for c in cols if c not in small | empty})
    out = df
    for c in cols:
        own = d.filter(F.col("column") == c).select("value", F.col("code").alias(f"{c}{suffix}"))
        out = lookup.look_up(out, F.col(c), own, "value", [f"{c}{suffix}"], c in small | empty, heavy.get(c, ()))
    return out


def unseen_counts(encoded: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """(column, n_rows, n_missing, n_unseen) for encoded rows, all columns in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"m_{c}"),
                 F.count(F.when(F.col(c).isNotNull() & F.col(f"{c}{suffix}").isNull(), 1)).alias(f"u_{c}")]
    wide = encoded.agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("n_missing"),
                                           F.col(f"u_{c}").alias("n_unseen")) for c in cols]))
    return wide.select("n_rows", stacked.alias("s")).select(
        "s.column", "n_rows", "s.n_missing", "s.n_unseen")


def _cat(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL_KEY))


def stratified_folds(train: DataFrame, label: str, id_col: str, folds: int = 5, seed: int = 42,
                     col: str = "fold") -> DataFrame:
    """Adds ``fold``: rows of each class are put in a seeded order (md5 of id and seed) and dealt
    out in turn, so every fold has each class's share to within one row. The rank in that order
    is a distributed running count; ids must be unique within a class."""
    shuffled = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    ranked = running_sum(train.withColumn("_one", F.lit(1).cast("long")), id_col, ["_one"], by=[label],
                         order=[shuffled, id_col])
    return ranked.withColumn(col, F.pmod(F.col("_one_cum") - 1, F.lit(folds)).cast("int")).drop("_one", "_one_cum")


def target_encode(train: DataFrame, other: DataFrame | None, cols: Sequence[str],
                  label: str = "is_fraud", fold: str = "fold", suffix: str = "_te"):
    """Cross-fitted encoding of ``train`` (by its ``fold`` column) and full-train
    encoding of ``other``. Returns (train_encoded, other_encoded).

    The per-(column, fold, category) label sums of all columns come from one
    aggregation over the unpivoted train rows; out-of-fold sums are total minus fold. The table
    that is looked up has one row per category, with the values of all folds as a map."""
    cols = list(cols)
    y = F.col(label).cast("double")
    # label statistics per fold (one row per fold)
    stats = train.groupBy(fold).agg(F.count(F.lit(1)).alias("fn"), F.sum(y).alias("fs")).collect()
    N, S = float(sum(r["fn"] for r in stats)), float(sum(r["fs"] or 0.0 for r in stats))
    long = (train.select(fold, y.alias("_y"), *[_cat(c).alias(c) for c in cols])
                 .unpivot([fold, "_y"], cols, "_col", "_k"))
    per = long.groupBy("_col", fold, "_k").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"))
    # one entry per fold of a category
    allc = per.groupBy("_col", "_k").agg(F.sum("n").alias("Nc"), F.sum("s").alias("Sc"),
                                         F.collect_list(F.struct(F.col(fold).alias("f"), "n", "s")).alias("parts"))
    others = [F.struct(F.lit(N - r["fn"]).alias("yn"), F.lit(S - (r["fs"] or 0.0)).alias("ys")) for r in stats]
    of_fold = F.create_map(*[x for r, o in zip(stats, others) for x in (F.lit(r[fold]), o)]) if stats else None

    def oof(p):
        rest = F.try_element_at(of_fold, p["f"])
        return F.struct(p["f"], _smoothed(F.col("Nc") - p["n"], F.col("Sc") - p["s"], rest["yn"], rest["ys"]))
    table = allc.select("_col", "_k", _smoothed(F.col("Nc"), F.col("Sc"), F.lit(N), F.lit(S)).alias("_full"),
                        (F.map_from_entries(F.transform("parts", oof)) if stats else F.lit(None)).alias("_oof"))
    table = written(table, "target-encoding")
    small = lookup.small_tables(table, "_col", "_k")
    large = {c: _cat(c) for c in cols if stats and c not in small}
    y_mean = S / N if N else None
    hot_tr = lookup.heavy_values(train, large)
    hot_ot = lookup.heavy_values(other, large) if other is not None else {}
    tr_out, ot_out = train, other
    for c in cols:
        own = table.filter(F.col("_col") == c)
        tr_out = lookup.look_up(tr_out, _cat(c), own, "_k", ["_oof"], c not in large, hot_tr.get(c, ()))
        tr_out = tr_out.withColumn(f"{c}{suffix}", F.try_element_at("_oof", F.col(fold)) if stats else F.lit(None).cast("double")).drop("_oof")
        if ot_out is not None:
            ot_out = lookup.look_up(ot_out, _cat(c), own, "_k", ["_full"], c not in large, hot_ot.get(c, ()))
            ot_out = ot_out.withColumn(f"{c}{suffix}", F.coalesce(F.col("_full"), F.lit(y_mean))).drop("_full")
    return tr_out, ot_out


def _smoothed(n, s, yn, ys):
    """lambda * mean_c + (1 - lambda) * mean_y with lambda = v_y n / (v_y n + v_c)
    (population variances of a binary label); the overall mean when n = 0 or
    lambda is undefined."""
    y_mean = F.try_divide(ys, yn)
    y_var = y_mean - y_mean * y_mean
    mean_c = s / n
    var_c = mean_c - mean_c * mean_c
    lam = (y_var * n) / (y_var * n + var_c)
    return (F.when(n == 0, y_mean)
             .when((y_var * n + var_c) == 0, y_mean)
             .otherwise(lam * mean_c + (F.lit(1.0) - lam) * y_mean))


def medians(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, median) on train, exact."""
    long = (train.select(*[F.col(c).cast("double").alias(c) for c in cols])
                 .unpivot([], list(cols), "column", "v"))
    q = exact_quantiles(long, "v", [0.5], by=["column"])
    return q.select("column", F.col("quantile").alias("median"))


def impute_median(df: DataFrame, med: dict, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in cols})


def scaler_stats(train: DataFrame, cols: Sequence[str]) -> dict:
    """Mean and population std per column (scalars, one pass)."""
    row = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
                    *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def standard_scale(df: DataFrame, stats: dict, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """(x - mean) / std_pop; a zero std leaves x - mean (as a unit scale)."""
    out = {}
    for c in cols:
        m, s = stats[c]
        sd = s if s else 1.0
        out[f"{c}{suffix}"] = (F.col(c).cast("double") - F.lit(m)) / F.lit(sd)
    return df.withColumns(out)


def class_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """n, positives, negatives, neg/pos ratio, balanced weights n / (2 n_c)."""
    y = F.col(label).cast("long")
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_pos"))
    neg = F.col("n") - F.col("n_pos")
    return a.select("n", "n_pos", neg.alias("n_neg"),
                    F.try_divide(neg.cast("double"), F.col("n_pos")).alias("scale_pos_weight"),
                    F.try_divide(F.col("n").cast("double"), F.col("n_pos") * 2).alias("w_pos"),
                    F.try_divide(F.col("n").cast("double"), neg * 2).alias("w_neg"))


def sparse_columns(train: DataFrame, cols: Sequence[str], max_missing: float = 0.95) -> DataFrame:
    """(column, missing_share, kept) with kept = share <= max_missing (one pass)."""
    wide = train.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), "column", "missing_share")
    return long.withColumn("kept", F.col("missing_share") <= F.lit(max_missing))
