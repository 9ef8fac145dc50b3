"""Exact ranking metrics: ROC-AUC, average precision, review-rate thresholds.

Rows are first reduced to one row per distinct score (map-side partial
aggregation), then running sums over the score order come from
``running_sum``. Ties in the top-k order are broken by id ascending; the rows
at a boundary score are ranked by id with the same distributed running sum,
so a score shared by a third of all rows is still split over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.numeric import rnd
from riskframe.operators.prefix import running_sum
from riskframe.session import written

# Review rates of the operational threshold table.
REVIEW_RATES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.10)
MAX_GROUPS = 10_000             # groups whose totals are broadcast


def score_table(df: DataFrame, score: str = "score", label: str = "is_fraud",
                by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct score): n, pos, neg."""
    return (df.groupBy(*by, F.col(score).alias("score"))
              .agg(F.count(F.lit(1)).alias("n"),
                   F.sum(F.col(label).cast("long")).alias("pos"))
              .withColumn("neg", F.col("n") - F.col("pos")))


def auc_ap(df: DataFrame, score: str = "score", label: str = "is_fraud",
           by: Sequence[str] = ()) -> DataFrame:
    """Unrounded ROC-AUC (ties count one half) and average precision per group."""
    by = list(by)
    st = score_table(df, score, label, by)
    up = running_sum(st, "score", ["neg", "pos", "n"], by=by)        # sums over score <= s
    # sums over score >= s = group total - sum over score <= s + this score's counts (exact integers)
    if by:
        tot = st.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("n").alias("_N"))
        up = up.join(tot, by)
    else:
        t = st.agg(F.sum("pos").alias("_P"), F.sum("n").alias("_N")).first()
        up = up.withColumns({"_P": F.lit(int(t["_P"] or 0)), "_N": F.lit(int(t["_N"] or 0))})
    down = up.withColumns({"pos_cum": F.col("_P") - F.col("pos_cum") + F.col("pos"),
                           "n_cum": F.col("_N") - F.col("n_cum") + F.col("n")})
    p = F.sum("pos")
    n = F.sum("neg")
    auc_num = F.sum(F.col("pos") * (F.col("neg_cum") - F.col("neg") + F.col("neg") / F.lit(2.0)))
    ap_num = F.sum(F.when(F.col("pos") > 0, F.col("pos") * (F.col("pos_cum") / F.col("n_cum")))
                   .otherwise(F.lit(0.0)))
    return down.groupBy(*by).agg(
        F.try_divide(auc_num, (p * n).cast("double")).alias("roc_auc"),
        F.try_divide(ap_num, p.cast("double")).alias("pr_auc"),
        F.sum("n").alias("n_rows"), p.alias("n_pos"))


def review_counts(n_rows: int, rates: Sequence[float]) -> list[int]:
    """Rows reviewed at each rate: max(1, int(N * rate)), the product in doubles."""
    return [max(1, int(n_rows * r)) for r in rates]


def top_k_caught(df: DataFrame, targets: DataFrame, score: str = "score",
                 label: str = "is_fraud", id_col: str = "txn_id",
                 by: Sequence[str] = ()) -> DataFrame:
    """For each target row (by..., tid, k): the k-th highest score of its group
    and the positives in the group's top k rows ordered by (score desc, id asc).

    Output: by..., tid, k, threshold, caught.
    """
    by = list(by)
    st = score_table(df, score, label, by)
    cum = running_sum(st, "score", ["n", "pos"], by=by, descending=True)
    # boundary score of each target: the first score whose running count reaches k
    if by:
        tg = targets.select(*[F.col(b).alias(f"_g_{b}") for b in by], "tid", "k")
        cond = (F.col("n_cum") - F.col("n") < F.col("k")) & (F.col("n_cum") >= F.col("k"))
        for b in by:
            cond = cond & (F.col(b) == F.col(f"_g_{b}"))
        matched = cum.join(tg, cond)
    else:
        # targets are the caller's few review counts: matched inside each row, no join
        lit_t = F.array(*[F.struct(F.lit(int(r["tid"])).alias("tid"), F.lit(int(r["k"])).cast("long").alias("k"))
                          for r in targets.select("tid", "k").collect()])
        inside = F.filter(lit_t, lambda t: (F.col("n_cum") - F.col("n") < t["k"]) & (F.col("n_cum") >= t["k"]))
        matched = (cum.select("*", F.explode(inside).alias("_t"))
                      .select("*", F.col("_t.tid").alias("tid"), F.col("_t.k").alias("k")).drop("_t"))
    hit = (matched
              .select(*by, "tid", "k", F.col("score").alias("threshold"),
                      (F.col("pos_cum") - F.col("pos")).alias("pos_before"),
                      (F.col("k") - (F.col("n_cum") - F.col("n"))).alias("m"),
                      F.col("n").alias("tie_n"), F.col("pos").alias("tie_pos")))
    # rows at a boundary score where only part of the tie is inside the top k
    partial = hit.filter((F.col("m") < F.col("tie_n")) & (F.col("tie_pos") > 0)
                         & (F.col("tie_pos") < F.col("tie_n")))
    part_small = partial.select(*by, "tid", "threshold", "m")
    tie_rows = (df.select(*by, F.col(score).alias("threshold"), F.col(id_col).alias("_id"),
                          F.col(label).cast("long").alias("_y"))
                  .join(part_small if by else F.broadcast(part_small), [*by, "threshold"]))
    ranked = running_sum(tie_rows.withColumn("_one", F.lit(1).cast("long")), "_id",
                         ["_one", "_y"], by=[*by, "tid"])
    tie_tp = (ranked.filter(F.col("_one_cum") == F.col("m"))
                    .select(*by, "tid", F.col("_y_cum").alias("tie_caught")))
    return (hit.join(tie_tp, [*by, "tid"], "left").select(
        *by, "tid", "k", "threshold",
        (F.col("pos_before") + F.coalesce(
            F.col("tie_caught"),
            F.when(F.col("m") >= F.col("tie_n"), F.col("tie_pos"))
             .when(F.col("tie_pos") == 0, F.lit(0).cast("long"))
             .otherwise(F.col("m")))).alias("caught")))


def grouped_metrics(counts: DataFrame, by: Sequence[str], rates: Sequence[float],
                    rows_at: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """by..., n_rows, n_pos, roc_auc, pr_auc (unrounded) and fdr: an array with the detection rate
    at each review rate, k = max(1, floor(n * rate)) in doubles.

    counts: by..., score, n, pos (one row per group and distinct score). One running sum by
    group gives the curves and the scores at which the reviews end; the groups' totals are
    broadcast (their number is checked). Where a review ends inside a tie, ``rows_at`` is given
    the few (by..., tid, threshold, m) and returns their rows (by..., tid, m, _id, _y), which are
    ranked by id with another running sum."""
    by = list(by)
    counts = written(counts.select(*by, "score", "n", "pos"), "counts")
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_N"), F.sum("pos").alias("_P"))
    few = totals.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS
    totals = totals.withColumnsRenamed({b: f"_g_{b}" for b in by})
    match = F.lit(True)
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    up = running_sum(counts, "score", ["n", "pos"], by=by)
    rows = up.join(F.broadcast(totals) if few else totals, match).drop(*[f"_g_{b}" for b in by])
    neg, neg_cum = F.col("n") - F.col("pos"), F.col("n_cum") - F.col("pos_cum")
    above = F.col("_N") - F.col("n_cum")                       # rows with a higher score
    reached, caught = above + F.col("n"), F.col("_P") - F.col("pos_cum") + F.col("pos")
    aggs = [F.max("_N").alias("n_rows"), F.max("_P").alias("n_pos"),
            F.sum(F.col("pos") * (neg_cum - neg + neg / F.lit(2.0))).alias("_auc"),
            F.sum(F.when(F.col("pos") > 0, F.col("pos") * (caught / reached)).otherwise(F.lit(0.0))).alias("_ap")]
    for i, rate in enumerate(rates):
        k = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_N").cast("double") * F.lit(float(rate))).cast("long"))
        end = F.struct(F.col("score").alias("threshold"), (k - above).alias("m"), F.col("n").alias("tie_n"),
                       F.col("pos").alias("tie_pos"), (caught - F.col("pos")).alias("before"))
        aggs.append(F.max(F.when((above < k) & (reached >= k), end)).alias(f"_e{i}"))
    found = written(rows.groupBy(*by).agg(*aggs), "groups")       # one row per group
    ends = F.array(*[F.struct(F.lit(i).alias("tid"), F.col(f"_e{i}.threshold").alias("threshold"), F.col(f"_e{i}.m").alias("m"),
                              F.col(f"_e{i}.tie_n").alias("tie_n"), F.col(f"_e{i}.tie_pos").alias("tie_pos")) for i in range(len(rates))])
    inside = found.select(*by, F.explode(ends).alias("_t")).select(*by, "_t.*") \
        .filter("m < tie_n AND tie_pos > 0 AND tie_pos < tie_n").select(*by, "tid", "threshold", "m")
    out = found.withColumn("_ties", F.lit(None).cast("map<int,bigint>"))
    if not inside.isEmpty():
        ranked = running_sum(rows_at(inside).withColumn("_one", F.lit(1).cast("long")), "_id", ["_one", "_y"], by=[*by, "tid"])
        # one entry per review rate
        ties = ranked.filter(F.col("_one_cum") == F.col("m")).groupBy(*by).agg(
            F.map_from_entries(F.collect_list(F.struct("tid", "_y_cum"))).alias("_ties")).withColumnsRenamed({b: f"_g_{b}" for b in by})
        out = found.join(F.broadcast(ties) if few else ties, match, "left").drop(*[f"_g_{b}" for b in by])

    def detected(i):
        e = F.col(f"_e{i}")
        tie = (F.when(e["m"] >= e["tie_n"], e["tie_pos"]).when(e["tie_pos"] == 0, F.lit(0).cast("long"))
                .when(e["tie_pos"] == e["tie_n"], e["m"]).otherwise(F.try_element_at("_ties", F.lit(i))))
        return F.try_divide((e["before"] + tie).cast("double"), F.col("n_pos"))
    p = F.col("n_pos")
    return out.select(*by, "n_rows", "n_pos", F.try_divide("_auc", (p * (F.col("n_rows") - p)).cast("double")).alias("roc_auc"),
                      F.try_divide("_ap", p.cast("double")).alias("pr_auc"),
                      F.array(*[detected(i) for i in range(len(rates))]).alias("fdr"))


def _totals(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")).first()
    return int(row["n"]), int(row["p"] or 0)


def _targets(spark: SparkSession, ks: Sequence[int], rates: Sequence[float]) -> DataFrame:
    return spark.createDataFrame(
        [(i, int(k), float(r)) for i, (k, r) in enumerate(zip(ks, rates))],
        "tid int, k long, rate double")


def threshold_table(df: DataFrame, score: str = "score", label: str = "is_fraud",
                    id_col: str = "txn_id", rates: Sequence[float] = REVIEW_RATES) -> DataFrame:
    """Per review rate: threshold, rows reviewed, fraud caught, detection rate, precision."""
    n_rows, n_pos = _totals(df, label)
    ks = review_counts(n_rows, rates)
    tg = _targets(df.sparkSession, ks, rates)
    res = top_k_caught(df, tg.select("tid", "k"), score, label, id_col).join(
        F.broadcast(tg.select("tid", "rate")), "tid")
    return res.select(
        rnd(F.col("rate") * 100, 1).alias("review_rate_pct"),
        rnd("threshold", 4).alias("threshold"),
        F.col("k").alias("n_reviewed"),
        F.col("caught").alias("fraud_caught"),
        rnd(F.try_divide(F.col("caught").cast("double"), F.lit(float(n_pos))), 4).alias("fdr"),
        rnd(F.col("caught") / F.col("k"), 4).alias("precision"),
    )


def fdr_at_rates(df: DataFrame, rates: Sequence[float], score: str = "score",
                 label: str = "is_fraud", id_col: str = "txn_id") -> DataFrame:
    n_rows, n_pos = _totals(df, label)
    ks = review_counts(n_rows, rates)
    tg = _targets(df.sparkSession, ks, rates)
    res = top_k_caught(df, tg.select("tid", "k"), score, label, id_col)
    return res.join(F.broadcast(tg.select("tid", "rate")), "tid").select(
        "tid", "rate", "k", "caught",
        F.try_divide(F.col("caught").cast("double"), F.lit(float(n_pos))).alias("fdr"))


def headline_metrics(df: DataFrame, score: str = "score", label: str = "is_fraud",
                     id_col: str = "txn_id") -> DataFrame:
    """roc_auc, pr_auc, fdr_at_3pct, fdr_at_5pct, rounded to 4 places, one row."""
    aa = auc_ap(df, score, label)
    fd = fdr_at_rates(df, (0.03, 0.05), score, label, id_col)
    piv = fd.groupBy().agg(
        F.max(F.when(F.col("tid") == 0, F.col("fdr"))).alias("f3"),
        F.max(F.when(F.col("tid") == 1, F.col("fdr"))).alias("f5"))
    row_f = piv.first()
    return aa.select(
        rnd("roc_auc", 4).alias("roc_auc"),
        rnd("pr_auc", 4).alias("pr_auc"),
        rnd(F.lit(row_f["f3"]).cast("double"), 4).alias("fdr_at_3pct"),
        rnd(F.lit(row_f["f5"]).cast("double"), 4).alias("fdr_at_5pct"))


def review_threshold_frame(df: DataFrame, rate: float, score: str = "score",
                           label: str = "is_fraud", id_col: str = "txn_id") -> DataFrame:
    """One row: the score of the n-th highest row, n = max(1, int(N * rate)), and n.
    Only the score table is needed; ties at the threshold are not ranked."""
    n_rows, _ = _totals(df, label)
    k = review_counts(n_rows, [rate])[0]
    cum = running_sum(score_table(df, score, label), "score", ["n"], descending=True)
    return cum.filter((F.col("n_cum") - F.col("n") < k) & (F.col("n_cum") >= k)).select(
        F.col("score").alias("threshold"), F.lit(k).cast("long").alias("k"))


def review_threshold(df: DataFrame, rate: float, score: str = "score",
                     label: str = "is_fraud", id_col: str = "txn_id") -> tuple[float, int]:
    """(threshold, n) as driver scalars, for use as a filter constant."""
    row = review_threshold_frame(df, rate, score, label, id_col).first()
    return float(row["threshold"]), int(row["k"])


def curve_points(df: DataFrame, score: str = "score", label: str = "is_fraud") -> DataFrame:
    """One point per distinct threshold (score >= t flagged): fpr, tpr, precision, recall."""
    st = score_table(df, score, label)
    cum = running_sum(st, "score", ["pos", "neg"], descending=True)
    tot = st.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = float(tot["P"] or 0), float(tot["N"] or 0)
    return cum.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_cum").cast("double"), F.lit(N)).alias("fpr"),
        F.try_divide(F.col("pos_cum").cast("double"), F.lit(P)).alias("tpr"),
        (F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))).alias("precision"),
        F.try_divide(F.col("pos_cum").cast("double"), F.lit(P)).alias("recall"))


def confusion_at_threshold(df: DataFrame, threshold: float, score: str = "score",
                           label: str = "is_fraud") -> DataFrame:
    """tp, fp, fn, tn at flag = score >= threshold; recall, precision, false discovery share."""
    flag = F.col(score) >= F.lit(threshold)
    y = F.col(label) == 1
    c = df.agg(F.count(F.when(flag & y, 1)).alias("tp"), F.count(F.when(flag & ~y, 1)).alias("fp"),
               F.count(F.when(~flag & y, 1)).alias("fn"), F.count(F.when(~flag & ~y, 1)).alias("tn"))
    d = F.try_divide
    return c.select("tp", "fp", "fn", "tn",
                    rnd(d(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), 4).alias("recall"),
                    rnd(d(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), 4).alias("precision"),
                    rnd(d(F.col("fp").cast("double"), F.col("tp") + F.col("fp")), 4)
                    .alias("false_discovery_share"))


def model_comparison(long: DataFrame, score: str = "score", label: str = "is_fraud",
                     id_col: str = "txn_id", group: str = "model") -> DataFrame:
    """Headline metrics per model from a long (model, id, label, score) table,
    all models in the same grouped jobs."""
    def rows_at(ends):
        at = ends.withColumnRenamed(group, "_at")
        rows = long.select(group, F.col(score).alias("_s"), F.col(id_col).alias("_id"), F.col(label).cast("long").alias("_y"))
        return rows.join(F.broadcast(at), F.col(group).eqNullSafe(F.col("_at")) & (F.col("_s") == F.col("threshold"))).select(
            group, "tid", "m", "_id", "_y")                     # models x review rates
    found = grouped_metrics(score_table(long, score, label, [group]), [group], (0.03, 0.05), rows_at)
    return found.select(
        group, rnd("roc_auc", 4).alias("roc_auc"), rnd("pr_auc", 4).alias("pr_auc"),
        rnd(F.col("fdr")[0], 4).alias("fdr_at_3pct"), rnd(F.col("fdr")[1], 4).alias("fdr_at_5pct"), F.col("n_rows"))


def top_k_by_score(df: DataFrame, k: int, score: str = "score", id_col: str = "txn_id") -> DataFrame:
    """The k highest-scored rows, ties by id (per-task top-k, then a merge)."""
    return df.orderBy(F.desc(score), F.asc(id_col)).limit(k)
