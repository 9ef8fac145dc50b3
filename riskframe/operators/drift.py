"""Distribution drift: PSI on reference-decile bins and the two-sample KS test.

All features are handled in one job: the frames are unpivoted to (feature, value), a sketch
per feature brackets the reference deciles, and one counting pass gives a small value table
from which exact edges, bin counts, means and missing shares are read (``brackets``). The
score's PSI, KS, means and percentiles come from one table of distinct scores.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.numeric import exact_sum_sql, mean_half_up_of_parts, nan_to_null, rnd
from riskframe.functions.codes import PSI_MODERATE, psi_label
from riskframe.operators import brackets
from riskframe.operators.prefix import running_sum
from riskframe.operators.quantiles import exact_quantiles
from riskframe.session import written

# Smoothing added to bin counts; reference deciles.
EPSILON = 1e-4
EXACT_KS = 10_000                # values of the larger sample up to which the p-value is exact
INNER_PROBS = [i / 10 for i in range(1, 10)]   # deciles; the ends become +-inf


def to_long(df: DataFrame, features: Sequence[str], keep_null: bool = False) -> DataFrame:
    """(feature, v double) rows; NULL values dropped unless ``keep_null``."""
    wide = df.select(*[nan_to_null(c).alias(c) for c in features])
    long = wide.unpivot([], list(features), "feature", "v")
    return long if keep_null else long.filter(F.col("v").isNotNull())


def reference_edges(ref_long: DataFrame, buckets: int = 10, approx: bool = False,
                    accuracy: int = 100000) -> DataFrame:
    """Per feature: sorted distinct inner edges of the reference quantiles.

    Exact by default (the distinct (feature, value) pairs are shuffled once).
    ``approx=True`` uses one mergeable quantile sketch per feature instead, so
    the shuffle is a sketch per feature and task, for very wide or very large
    references (rank error about 1 / accuracy)."""
    probs = [i / buckets for i in range(1, buckets)]
    if approx:
        q = ref_long.groupBy("feature").agg(F.percentile_approx("v", probs, accuracy).alias("_q"))
        return q.select("feature", F.array_sort(F.array_distinct("_q")).alias("edges"))
    q = exact_quantiles(ref_long, "v", probs, by=["feature"])
    # at most buckets-1 values per feature
    return q.groupBy("feature").agg(
        F.array_sort(F.array_distinct(F.collect_list("quantile"))).alias("edges"))


def bin_index(v: Column, edges: Column) -> Column:
    """Half-open bins [a, b), last closed: the number of inner edges <= v."""
    return F.size(F.filter(edges, lambda e: e <= v))


def tag_sides(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both frames as one, with _ref true for the reference rows."""
    return (ref.select(*columns, F.lit(True).alias("_ref"))
            .unionByName(cur.select(*columns, F.lit(False).alias("_ref"))))


def _side_counts(both: DataFrame, features: Sequence[str], buckets: int) -> DataFrame:
    """The value table of all features (``brackets``), with counts and means of both sides."""
    wide = both.select("_ref", *[nan_to_null(c).alias(c) for c in features])
    long = wide.unpivot(["_ref"], list(features), "feature", "v")
    probs = [i / buckets for i in range(1, buckets)]
    sides = {}
    for p, here in (("r", F.col("_ref")), ("c", ~F.col("_ref"))):
        own = F.when(here, F.col("v"))
        long = long.withColumn(f"_{p}", own)
        sides |= {f"{p}n": F.count(f"_{p}"), f"{p}_rows": F.count(F.when(here, 1)), f"{p}_sum": F.expr(exact_sum_sql(f"_{p}")),
                  f"{p}_plain": F.sum(f"_{p}"), f"{p}_top": F.max(F.abs(F.col(f"_{p}")))}
    counts = brackets.value_counts(long, "v", ["feature"], probs, F.col("_ref"), **sides)
    if counts is None:
        raise ValueError(f"more than {brackets.MAX_GROUPS} features at once")
    return counts


def _with_edges(counts: DataFrame, buckets: int) -> DataFrame:
    """Adds edges (the distinct inner edges of the feature's reference quantiles) to every row."""
    whole = Window.partitionBy("feature").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = brackets.with_running(counts, ["feature"])
    q = [brackets.statistic(i / buckets, lambda x: F.max(x).over(whole)) for i in range(1, buckets)]
    return run.withColumn("edges", F.when(F.col("_total") > 0, F.array_sort(F.array_distinct(F.array(*q)))))


def feature_bins(both: DataFrame, features: Sequence[str], buckets: int = 10) -> DataFrame:
    """One row per feature: edges, bins (array of struct rc, cc: counts of either side in every
    bin, empty ones too) and both sides' rows, missing shares and means.

    ``both`` carries _ref (``tag_sides``). One sketch pass and one counting pass over the rows;
    everything after that works on the value table, dealt by feature once."""
    t = _with_edges(_side_counts(both, features, buckets), buckets)
    t = t.withColumn("_bin", F.when(F.col("_slot") >= 0, bin_index(F.col("_v"), F.col("edges"))))
    parts = ["n", "_rows", "_sum", "_plain", "_top"]
    sums = {f"{p}{x}": (F.max if x == "_top" else F.sum)(f"{p}{x}") for p in "rc" for x in parts}
    by_bin = t.groupBy("feature", "_bin").agg(F.first("edges").alias("edges"), *[a.alias(c) for c, a in sums.items()])
    # at most `buckets` bins and one row of missing values per feature
    of_bin = F.map_from_entries(F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct(
        "_bin", F.struct(F.col("rn").alias("rc"), F.col("cn").alias("cc"))))))
    means = {}
    for p, side in (("r", "ref"), ("c", "cur")):
        means |= {f"n_{side}": F.sum(f"{p}n"), f"{side}_rows": F.sum(f"{p}_rows"),
                  f"{side}_mean": F.try_divide(F.sum(f"{p}_plain"), F.sum(f"{p}n")),
                  f"{side}_mean4": mean_half_up_of_parts(f"{p}_sum", f"{p}n", f"{p}_top", f"{p}_plain", 4)}
    one = by_bin.groupBy("feature").agg(F.first("edges").alias("edges"), of_bin.alias("_m"),
                                        *[a.alias(c) for c, a in means.items()])
    none = F.struct(F.lit(0).cast("long").alias("rc"), F.lit(0).cast("long").alias("cc"))
    bins = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), none))
    return one.withColumn("bins", F.when(F.col("edges").isNotNull(), bins)).drop("_m")


def _psi(eps: float) -> Column:
    """PSI of a ``feature_bins`` row (NULL where either side is empty, 0 without variation)."""
    n_bins = F.size("bins")

    def term(b):
        rp = (b["rc"].cast("double") + eps) / (F.col("n_ref") + eps * n_bins)
        cp = (b["cc"].cast("double") + eps) / (F.col("n_cur") + eps * n_bins)
        return (cp - rp) * F.log(cp / rp)
    return (F.when((F.col("n_ref") == 0) | (F.col("n_cur") == 0), F.lit(None).cast("double"))
             .when(n_bins + 1 < 3, F.lit(0.0))
             .otherwise(F.aggregate("bins", F.lit(0.0), lambda acc, b: acc + term(b))))


def psi_of(both: DataFrame, features: Sequence[str], buckets: int = 10, eps: float = EPSILON) -> DataFrame:
    """feature, psi (unrounded), n_ref, n_cur, n_bins of features with reference values."""
    return feature_bins(both, features, buckets).filter("n_ref > 0").select(
        "feature", _psi(eps).alias("psi"), "n_ref", "n_cur", F.size("bins").alias("n_bins"))


def psi_table(ref: DataFrame, cur: DataFrame, features: Sequence[str],
              buckets: int = 10, eps: float = EPSILON, approx: bool = False) -> DataFrame:
    """feature, psi (unrounded), n_ref, n_cur, n_bins."""
    both = tag_sides(ref, cur, features)
    if not approx:
        return psi_of(both, features, buckets, eps)
    long = both.select("_ref", *[nan_to_null(c).alias(c) for c in features]) \
        .unpivot(["_ref"], list(features), "feature", "v").filter("v IS NOT NULL")
    edges = reference_edges(long.filter("_ref"), buckets, approx=True)
    # one edge array (<= buckets values) per feature: broadcast while the features are as few as ever wanted
    side = F.broadcast(edges) if len(features) <= brackets.MAX_GROUPS else edges
    binned = long.join(side, "feature").groupBy("feature", "edges", bin_index(F.col("v"), F.col("edges")).alias("_bin")).agg(
        F.count(F.when(F.col("_ref"), 1)).alias("rc"), F.count(F.when(~F.col("_ref"), 1)).alias("cc"))
    one = binned.groupBy("feature", "edges").agg(
        F.map_from_entries(F.collect_list(F.struct("_bin", F.struct("rc", "cc")))).alias("_m"),
        F.sum("rc").alias("n_ref"), F.sum("cc").alias("n_cur"))
    none = F.struct(F.lit(0).cast("long").alias("rc"), F.lit(0).cast("long").alias("cc"))
    bins = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), none))
    return one.withColumn("bins", bins).select("feature", _psi(eps).alias("psi"), "n_ref", "n_cur", F.size("bins").alias("n_bins"))


def feature_report_of(both: DataFrame, features: Sequence[str], buckets: int = 10) -> DataFrame:
    """Per feature: psi(5), stability, means(4), mean shift %(2), missing %(1), all from the one
    value table. A feature without reference values has a NULL psi."""
    t = feature_bins(both, features, buckets).withColumn("psi", F.when(F.col("n_ref") > 0, _psi(EPSILON)))
    shift = (F.col("cur_mean") - F.col("ref_mean")) / (F.abs(F.col("ref_mean")) + F.lit(1e-8)) * 100

    def missing(side):
        return rnd(F.try_divide((F.col(f"{side}_rows") - F.col(f"n_{side}")).cast("double"), F.col(f"{side}_rows")) * 100, 1)
    return t.select(
        "feature", rnd("psi", 5).alias("psi"), psi_label(F.col("psi")).alias("stability"),
        F.col("ref_mean4").alias("ref_mean"), F.col("cur_mean4").alias("cur_mean"), rnd(shift, 2).alias("mean_shift_pct"),
        missing("ref").alias("ref_missing_pct"), missing("cur").alias("cur_missing_pct"))


def feature_psi_report(ref: DataFrame, cur: DataFrame, features: Sequence[str],
                       buckets: int = 10) -> DataFrame:
    return feature_report_of(tag_sides(ref, cur, features), features, buckets)


def ks_statistic(ref: DataFrame, cur: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Two-sample KS statistic D = sup |F_ref - F_cur| over non-missing values, with n_ref, n_cur.

    Distinct values are counted per side and running counts are taken over the
    value order (distributed running sums)."""
    by = list(by)
    r = ref.filter(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("v"),
                                                  F.lit(1).alias("r"), F.lit(0).alias("c"))
    c = cur.filter(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("v"),
                                                  F.lit(0).alias("r"), F.lit(1).alias("c"))
    counts = r.unionByName(c).groupBy(*by, "v").agg(
        F.sum("r").cast("long").alias("rc"), F.sum("c").cast("long").alias("cc"))
    cum = running_sum(counts, "v", ["rc", "cc"], by=by)
    if by:
        tot = counts.groupBy(*by).agg(F.sum("rc").alias("n_ref"), F.sum("cc").alias("n_cur"))
        j = cum.join(tot, by, "inner")
    else:                                # one group: the totals are two scalars
        t = counts.agg(F.sum("rc").alias("r"), F.sum("cc").alias("c")).first()
        j = cum.withColumns({"n_ref": F.lit(int(t["r"] or 0)).cast("long"),
                             "n_cur": F.lit(int(t["c"] or 0)).cast("long")})
    gap = F.abs(F.try_divide(F.col("rc_cum").cast("double"), F.col("n_ref"))
                - F.try_divide(F.col("cc_cum").cast("double"), F.col("n_cur")))
    return j.groupBy(*by, "n_ref", "n_cur").agg(F.max(gap).alias("ks_d"))


def kolmogorov_p(d: Column, n_ref: Column, n_cur: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value: Q(sqrt(n m / (n + m)) * D), Kolmogorov series."""
    en = F.try_divide(n_ref.cast("double") * n_cur.cast("double"), (n_ref + n_cur).cast("double"))
    z = F.sqrt(en) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * k * k * z * z))
    return F.when(z < 0.03, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * series)))


def exact_ks_p(n: int, m: int, gap: int) -> float:
    """Probability that two samples of n and m values from one continuous distribution have
    max |i m - j n| >= gap (the KS statistic times n m): one less the share of the lattice paths from
    (0, 0) to (n, m) that stay inside. Paths are followed by their length, all at once, as shares
    of those that reach each place, so no count is too large. Work is n m, memory n."""
    if gap <= 0:
        return 1.0
    i = np.arange(n + 1)
    inside = (i == 0).astype(float)
    for k in range(1, n + m + 1):
        j = k - i
        came = (j / k) * inside
        came[1:] += (i[1:] / k) * inside[:-1]
        inside = np.where((j >= 0) & (j <= m) & (np.abs(i * m - j * n) < gap), came, 0.0)
    return float(min(max(1.0 - inside[n], 0.0), 1.0))


def ks_test_auto(ref: DataFrame, cur: DataFrame, col: str, exact_up_to: int = EXACT_KS) -> DataFrame:
    """``ks_test`` with the exact p-value where the larger sample has at most ``exact_up_to`` values
    (tied values make it conservative), else the asymptotic series; ``method`` says which."""
    r = ks_statistic(ref, cur, col).select("ks_d", "n_ref", "n_cur",
                                           kolmogorov_p(F.col("ks_d"), F.col("n_ref"), F.col("n_cur")).alias("p")).first()
    d, n, m, p, method = (r["ks_d"], int(r["n_ref"]), int(r["n_cur"]), r["p"], "asymptotic") if r else (None, 0, 0, None, "asymptotic")
    if d is None:                       # a side without values has no distance
        p = None
    elif max(n, m) <= exact_up_to:
        p, method = exact_ks_p(n, m, round(d * n * m)), "exact"
    out = ref.sparkSession.createDataFrame([(d, p, method)], "d double, p double, method string")
    return out.select(rnd("d", 5).alias("ks_statistic"), rnd("p", 6).alias("p_value"),
                      ((F.col("d") > 0.05) & (F.col("p") < 0.05)).alias("drift_detected"), "method")


def ks_test(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    d = ks_statistic(ref, cur, col)
    p = kolmogorov_p(F.col("ks_d"), F.col("n_ref"), F.col("n_cur"))
    return d.select(rnd("ks_d", 5).alias("ks_statistic"), rnd(p, 6).alias("p_value"),
                    ((F.col("ks_d") > 0.05) & (p < 0.05)).alias("drift_detected"))


def score_summary(both: DataFrame, score: str = "score", buckets: int = 10) -> dict:
    """Scalars of both sides from one table of (score, counts): n, mean and p95 of either side, the
    KS statistic and the inner edges of the reference quantiles. One aggregation by score and
    one running sum over it give them all; ``both`` carries _ref."""
    counts = both.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_v")).agg(
        F.count(F.when(F.col("_ref"), 1)).alias("r"), F.count(F.when(~F.col("_ref"), 1)).alias("c"))
    # the totals decide the ranks; they are read off the same counts, which are written once
    counts = written(counts, "score-counts")
    t = counts.agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum(F.col("_v") * F.col("r")).alias("rs"),
                   F.sum(F.col("_v") * F.col("c")).alias("cs")).first()
    n = {"r": int(t["r"] or 0), "c": int(t["c"] or 0)}
    cum = running_sum(counts, "_v", ["r", "c"])
    wanted = [("r", i / buckets) for i in range(1, buckets)] + [("r", 0.95), ("c", 0.95)]
    picks, parts = [], []
    for k, (side, q) in enumerate(wanted):
        h = max(n[side] - 1, 0) * q
        parts.append(h - math.floor(h))
        for end, rank in (("lo", math.floor(h)), ("hi", math.ceil(h))):
            here = (F.col(f"{side}_cum") - F.col(side) <= rank) & (F.lit(rank) < F.col(f"{side}_cum"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"{end}{k}"))
    gap = F.abs(F.try_divide(F.col("r_cum").cast("double"), F.lit(n["r"]))
                - F.try_divide(F.col("c_cum").cast("double"), F.lit(n["c"])))
    row = cum.agg(F.max(gap).alias("d"), *picks).first()
    at = [None if row[f"lo{k}"] is None else row[f"lo{k}"] + (row[f"hi{k}"] - row[f"lo{k}"]) * part
          for k, part in enumerate(parts)]
    return {"n_ref": n["r"], "n_cur": n["c"], "d": row["d"],
            "ref_mean": t["rs"] / n["r"] if n["r"] else None, "cur_mean": t["cs"] / n["c"] if n["c"] else None,
            "ref_p95": at[-2], "cur_p95": at[-1], "edges": sorted({x for x in at[:-2] if x is not None}), "counts": counts}


def score_drift_of(both: DataFrame, score: str = "score", window: str = "current", buckets: int = 10) -> DataFrame:
    """One row: window, psi, label, KS statistic, p, drift flag, means, p95s, action."""
    s = score_summary(both, score, buckets)
    n_bins = len(s["edges"]) + 1
    edges = F.array(*[F.lit(e) for e in s["edges"]]).cast("array<double>")
    bins = s["counts"].groupBy(bin_index(F.col("_v"), edges).alias("_bin")).agg(F.sum("r").alias("rc"), F.sum("c").alias("cc"))
    bins = bins.agg(F.map_from_entries(F.collect_list(F.struct("_bin", F.struct("rc", "cc")))).alias("_m"))
    none = F.struct(F.lit(0).cast("long").alias("rc"), F.lit(0).cast("long").alias("cc"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), none))
    one = bins.select(filled.alias("bins"), *[F.lit(s[k]).cast(t).alias(k) for k, t in (
        ("n_ref", "long"), ("n_cur", "long"), ("d", "double"), ("ref_mean", "double"), ("cur_mean", "double"),
        ("ref_p95", "double"), ("cur_p95", "double"))])
    one = one.withColumns({"psi": F.when(F.col("n_ref") > 0, _psi(EPSILON)),
                           "p": kolmogorov_p(F.col("d"), F.col("n_ref"), F.col("n_cur"))})
    drift = (F.col("d") > 0.05) & (F.col("p") < 0.05)
    return one.select(
        F.lit(window).alias("window"), rnd("psi", 5).alias("psi"), psi_label(F.col("psi")).alias("psi_label"),
        rnd("d", 5).alias("ks_statistic"), rnd("p", 6).alias("p_value"), drift.alias("drift_detected"),
        rnd("ref_mean", 5).alias("ref_mean_score"), rnd("cur_mean", 5).alias("cur_mean_score"),
        rnd("ref_p95", 5).alias("ref_p95_score"), rnd("cur_p95", 5).alias("cur_p95_score"),
        ((F.col("psi") >= PSI_MODERATE) | drift).alias("action_required"))


def score_drift_report(ref: DataFrame, cur: DataFrame, score: str = "score", window: str = "current") -> DataFrame:
    return score_drift_of(tag_sides(ref, cur, [score]), score, window)


def ks_test_raw(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """Unrounded D and p (columns d, p)."""
    d = ks_statistic(ref, cur, col)
    return d.select(F.col("ks_d").alias("d"),
                    kolmogorov_p(F.col("ks_d"), F.col("n_ref"), F.col("n_cur")).alias("p"))


def ks_policy(ks: DataFrame) -> DataFrame:
    """Monitoring-plan KS levels: D > .10 and p < .01 escalate; D > .05 and p < .05 flag."""
    level = (F.when((F.col("d") > 0.10) & (F.col("p") < 0.01), F.lit("escalate"))
              .when((F.col("d") > 0.05) & (F.col("p") < 0.05), F.lit("flag"))
              .otherwise(F.lit("none")))
    return ks.select(rnd("d", 5).alias("ks_statistic"), rnd("p", 6).alias("p_value"),
                     level.alias("ks_level"))


def drift_summary(psi: DataFrame, top: int = 10) -> DataFrame:
    """Feature count, significant (>= .20) and moderate (.10-.20) counts, and the
    ``top`` features by rounded psi (ties by name), comma separated."""
    p5 = rnd("psi", 5)
    key = F.struct(F.when(p5.isNull(), F.lit(float("inf"))).otherwise(-p5).alias("k"),
                   F.col("feature").alias("feature"))
    # one entry per monitored feature: bounded by the caller's feature list
    return psi.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count(F.when(F.col("psi") >= PSI_MODERATE, 1)).alias("n_significant"),
        F.count(F.when((F.col("psi") >= 0.10) & (F.col("psi") < PSI_MODERATE), 1)).alias("n_moderate"),
        F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(key)), 1, top),
                                 lambda s: s["feature"]), ",").alias("top_features"))
