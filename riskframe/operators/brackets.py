"""Exact order statistics from sketches: a mergeable quantile sketch per group brackets each
wanted rank, and one counting pass keeps single values only inside the brackets.

Pass 1 (`find_brackets`): one sketch per group and task, merged; its rank error is at most
1 / ACCURACY, and a bracket is three times as wide on either side. Groups of at most
SMALL rows are one bracket. Where the brackets of a group would still hold more than
FINISH_ROWS rows they are narrowed by further sketches of the rows inside.

Pass 2 (`value_counts`): a row's slot is odd inside a bracket and even between two. Counts are
grouped by (group, slot, value inside a bracket), so all rows between two brackets are one row
of the result, however many, and so is a value that a third of all rows share. What is shuffled
is that table after partial aggregation, never the values themselves.

Running counts over the table give the order statistics, and counts on either side of any point
in a bracket, exactly. The brackets (groups x probabilities) are broadcast; their number is
checked, and above MAX_GROUPS groups `value_counts` returns None and the caller takes the
running sums of ``prefix``, which hold for any number of groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

ACCURACY = 10_000
SMALL = 20_000              # rows of a group that need no sketch
FINISH_ROWS = 1_000_000     # rows of a group inside its brackets
MAX_GROUPS = 10_000
STEPS = 256                 # points of a narrowing sketch

Intervals = list[tuple[float, float]]


def _merged(intervals: Intervals) -> Intervals:
    out: Intervals = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _with_slots(rows: DataFrame, v: str, by: Sequence[str], brackets: dict[tuple, Intervals]) -> DataFrame:
    """Adds _slot: 2 k + 1 inside the k-th bracket of the group, even between them, -1 without a value."""
    if by:
        kind = StructType([StructField(f"_b_{b}", rows.schema[b].dataType) for b in by]
                          + [StructField(c, ArrayType(DoubleType())) for c in ("_los", "_his")])
        side = rows.sparkSession.createDataFrame(
            [(*key, [lo for lo, _ in x], [hi for _, hi in x]) for key, x in brackets.items()], kind)
        match = F.lit(True)
        for b in by:
            match = match & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
        rows = rows.join(F.broadcast(side), match, "left").drop(*[f"_b_{b}" for b in by])    # at most MAX_GROUPS rows
    else:
        own = next(iter(brackets.values()), [])
        rows = rows.withColumns({name: F.array(*[F.lit(x[k]) for x in own]).cast("array<double>")
                                 for k, name in enumerate(("_los", "_his"))})
    inside = F.size(F.filter("_los", lambda e: e <= F.col(v))) + F.size(F.filter("_his", lambda e: e < F.col(v)))
    slot = F.when(F.col(v).isNull(), F.lit(-1)).when(F.col("_los").isNull(), F.lit(0)).otherwise(inside)
    return rows.withColumn("_slot", slot).drop("_los", "_his")


def _ranks(n: int, q: float) -> tuple[int, int]:
    h = (n - 1) * q
    return math.floor(h), math.ceil(h)


def _narrowed(rows: DataFrame, v: str, by: Sequence[str], probs: Sequence[float],
              brackets: dict[tuple, Intervals], counts: dict[tuple, int]) -> tuple[dict[tuple, Intervals], dict[tuple, float]]:
    """Narrower brackets, and about how many rows are inside them. A step is wider than the sketch's
    error, and a bracket reaches a step further than the rank; one of few rows stays."""
    steps = min(STEPS, ACCURACY // 4)
    points = [i / steps for i in range(steps + 1)]
    inside = F.when(F.col("_slot") % 2 == 1, F.col(v))
    got = _with_slots(rows, v, by, brackets).groupBy(*by, "_slot").agg(
        F.count("*").alias("_m"), F.percentile_approx(inside, points, ACCURACY).alias("_q")).collect()
    of_group: dict[tuple, list] = {}
    for r in got:
        of_group.setdefault(tuple(r[b] for b in by), []).append((r["_slot"], r["_m"], r["_q"]))
    out, sizes = dict(brackets), {}
    for key, parts in of_group.items():
        n, before, new, size = counts.get(key, 0), 0, [], 0.0
        for slot, m, q in sorted(parts, key=lambda p: p[0]):
            for a, b in (_ranks(n, p) for p in probs) if slot % 2 else ():
                if before <= a < before + m:
                    i = math.floor((a - before) / m * steps) - 1 if m > SMALL else 0
                    j = math.ceil((b + 1 - before) / m * steps) + 1 if m > SMALL else steps
                    lo, hi = brackets[key][slot // 2]
                    new.append((q[i] if i > 0 else lo, q[j] if j < steps else hi))
                    size += m * (min(j, steps) - max(i, 0)) / steps
            before += m
        if new:
            out[key], sizes[key] = _merged(new), size
    return out, sizes


def find_brackets(rows: DataFrame, v: str, by: Sequence[str], probs: Sequence[float]) -> dict[tuple, Intervals] | None:
    """Group -> disjoint intervals in order that hold the order statistics of ``probs``."""
    margin = 3 / ACCURACY
    points = sorted({min(max(q + d, 0.0), 1.0) for q in probs for d in (-margin, margin)})
    at = {p: i for i, p in enumerate(points)}
    present = rows.filter(F.col(v).isNotNull())
    got = present.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx(v, points, ACCURACY).alias("_q")) \
        .limit(MAX_GROUPS + 1).collect()
    if len(got) > MAX_GROUPS:
        return None
    brackets, counts, sizes = {}, {}, {}
    for r in got:
        key, n = tuple(r[b] for b in by), r["_n"]
        if not n:
            continue
        counts[key] = n
        if n <= SMALL:
            brackets[key], sizes[key] = [(-math.inf, math.inf)], 0
            continue
        brackets[key] = _merged([
            (r["_q"][at[q - margin]] if q - margin > 0 else -math.inf,
             r["_q"][at[q + margin]] if q + margin < 1 else math.inf) for q in probs])
        sizes[key] = min(8 * n * len(probs) / ACCURACY, n)
    while max(sizes.values(), default=0) > FINISH_ROWS:
        brackets, smaller = _narrowed(present, v, by, probs, brackets, counts)
        if max(smaller.values(), default=0) > 0.9 * max(sizes.values()):    # few values, many times each
            break
        sizes = smaller
    return brackets


def value_counts(rows: DataFrame, v: str, by: Sequence[str], probs: Sequence[float],
                 of: Column | None = None, **aggregates: Column) -> DataFrame | None:
    """by..., _slot, _v, _n and the aggregates of every slot (between brackets) or value (inside).

    ``of`` names the rows whose order statistics are wanted (all by default); _n counts their
    values. _v is the smallest value of the row, so the rows of a group are in order by it."""
    by = list(by)
    wanted = rows if of is None else rows.filter(of)
    brackets = find_brackets(wanted.select(*by, v), v, by, probs)
    if brackets is None:
        return None
    held = F.col(v).isNotNull() if of is None else of & F.col(v).isNotNull()
    return _with_slots(rows, v, by, brackets).groupBy(
        *by, "_slot", F.when(F.col("_slot") % 2 == 1, F.col(v)).alias("_inside")).agg(
        F.min(v).alias("_v"), F.count(F.when(held, 1)).alias("_n"), *[a.alias(c) for c, a in aggregates.items()]).drop("_inside")


def with_running(counts: DataFrame, by: Sequence[str], *more: str) -> DataFrame:
    """Adds _cum (running _n by value), _total (the group's) and <c>_total of further columns.
    A group's table is at most FINISH_ROWS and a few rows."""
    rows = Window.partitionBy(*by).orderBy("_v")
    whole = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.withColumns({
        "_cum": F.sum("_n").over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_total": F.sum("_n").over(whole), **{f"{c}_total": F.sum(c).over(whole) for c in more}})


def statistic(q: float, over=lambda x: F.max(x)) -> Column:
    """The quantile of ``with_running`` rows by linear interpolation; ``over`` aggregates (or takes
    over a window) the one row of the group that holds a rank."""
    h = (F.col("_total") - 1).cast("double") * F.lit(float(q))

    def at(rank):
        here = (F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum"))
        missed = F.raise_error(F.lit("a quantile bracket missed its rank")).cast("double")
        return over(F.when(here, F.when(F.col("_slot") % 2 == 1, F.col("_v")).otherwise(missed)))
    lo, hi = at(F.floor(h).cast("long")), at(F.ceil(h).cast("long"))
    part = over(h - F.floor(h).cast("double"))
    return lo + (hi - lo) * part
