"""Exact running sums over a global order, without a single-partition window.

``Window.orderBy(x)`` with no partition moves every row to one task. Instead the
rows, in the order (by..., key), are cut into buckets at sampled rows. A window
runs inside each (bucket, group); what a group has in earlier buckets is added
from a table with at most one row per bucket: only the first group of a bucket
can have begun before it.

Cut points are rows of the table with their own types, compared as a whole
(group and key), so 64-bit integers and strings stay exact, strings with a long
common prefix are cut as well as others, small groups share a bucket and a large
group is spread over many. They are read once, as literals, from the rows with the smallest hashes
(a sample that does not depend on partitioning). They only balance the work.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, ByteType, DoubleType, IntegerType, LongType, Row, ShortType, StringType, StructType,
)

from riskframe.session import shuffle_partitions

_BKT = "_pfx_bucket"
ROWS_PER_BUCKET = 2_000_000     # more buckets as the rows grow; their number has no ceiling
SAMPLE = 2_000                  # rows of the first sample
SAMPLE_PER_BUCKET = 20
_JSON_SAFE = (BooleanType, ByteType, DoubleType, IntegerType, LongType, ShortType, StringType)


def _sample(keyed: DataFrame, size: int) -> tuple[list[Row], float]:
    """(the ``size`` rows with the smallest hashes in key order, estimated row count)."""
    h = F.xxhash64("_k").alias("_h")
    rows = keyed.select("_k", h).orderBy("_h").limit(size).orderBy("_k").collect()
    if len(rows) < size:
        return rows, float(len(rows))
    top = max(r["_h"] for r in rows)
    return rows, size * 2.0 ** 64 / max(float(top + (1 << 63)), 1.0)


def _literal(value, kind) -> Column:
    """A literal of exactly the given type (a struct field by field)."""
    if isinstance(kind, StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
    return F.lit(value).cast(kind)


def _cut_table(cuts: list, kind: StructType) -> Column:
    """The cut points as one array literal. As JSON text it is a single node of the plan
    until it is folded; types that JSON would not keep exactly are written out."""
    if all(isinstance(f.dataType, _JSON_SAFE) for f in kind.fields):
        return F.from_json(F.lit(json.dumps([dict(zip(kind.names, c)) for c in cuts])), ArrayType(kind))
    return F.array(*[_literal(c, kind) for c in cuts])


def _bucket(key: Column, cuts: list, kind: StructType) -> Column:
    """How many cut points are not above the key (binary search)."""
    if not cuts:
        return F.lit(0)
    table = _cut_table(cuts, kind)

    def halve(lo_hi, t, k):
        mid = F.floor((lo_hi["lo"] + lo_hi["hi"]) / 2).cast("int")
        up = t[mid] <= k
        return F.when(lo_hi["lo"] >= lo_hi["hi"], lo_hi).otherwise(F.struct(
            F.when(up, mid + 1).otherwise(lo_hi["lo"]).alias("lo"), F.when(up, lo_hi["hi"]).otherwise(mid).alias("hi")))
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(steps, start, lambda acc, _: halve(acc, table, key), lambda acc: acc["lo"])


def running_sum(df: DataFrame, key: str | Column, cols: Sequence[str],
                by: Sequence[str] = (), descending: bool = False,
                buckets: int | None = None, suffix: str = "_cum",
                order: Sequence[str | Column] | None = None) -> DataFrame:
    """Add ``<col><suffix>`` = inclusive running sum of each col, ordered by key.

    ``key`` (any orderable type) must be unique within each ``by`` group
    (aggregate first). ``order`` replaces it by several columns that are unique
    together. ``descending`` runs the sum from the largest key down. Rows whose group
    is NULL form a group of their own.
    """
    by = list(by)
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    keys = [as_col(c) for c in (order or [key])]
    whole = F.struct(*[F.col(b).alias(f"b{i}") for i, b in enumerate(by)],
                     *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    keyed = df.select(whole.alias("_k"))
    kind = keyed.schema["_k"].dataType
    want = buckets or max(2, shuffle_partitions(df.sparkSession))
    rows, n = _sample(keyed, SAMPLE)
    if buckets is None:
        want = max(want, int(-(-n // ROWS_PER_BUCKET)))
    if len(rows) == SAMPLE and want * SAMPLE_PER_BUCKET > SAMPLE:
        rows, n = _sample(keyed, want * SAMPLE_PER_BUCKET)
    picked = [rows[i * len(rows) // want]["_k"] for i in range(1, want)] if rows else []
    cuts = [c for i, c in enumerate(picked) if i == 0 or c != picked[i - 1]]
    ordered = df.withColumn("_pfx_key", whole)
    ordered = ordered.withColumn(_BKT, _bucket(F.col("_pfx_key"), cuts, kind)).drop("_pfx_key")

    # what a group has before a bucket; at most one group a bucket has anything
    totals = ordered.groupBy(*by, _BKT).agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    side = F.desc(_BKT) if descending else F.asc(_BKT)
    before = Window.partitionBy(*by).orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(b).alias(f"_g_{b}") for b in by], (-F.col(_BKT)).alias("_pfx_b"),
        F.row_number().over(Window.partitionBy(*by).orderBy(side)).alias("_pfx_n"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols])
    offsets = F.broadcast(offsets.filter("_pfx_n > 1").drop("_pfx_n"))     # rows <= len(cuts)

    down = [F.desc(k) if descending else F.asc(k) for k in keys]
    run = Window.partitionBy(_BKT, *by).orderBy(*down).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ordered.withColumns({f"_r_{c}": F.sum(c).over(run) for c in cols})
    # an equality of two plain columns would let the optimizer copy the bucket's defining
    # expression to the offsets' side, where its columns do not exist
    match = -F.col(_BKT) == F.col("_pfx_b")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    out = out.join(offsets, match, "left")
    out = out.withColumns({f"{c}{suffix}": F.coalesce(F.col(f"_o_{c}"), F.lit(0)) + F.col(f"_r_{c}") for c in cols})
    return out.drop(_BKT, "_pfx_b", *[f"_g_{b}" for b in by], *[f"_{x}_{c}" for x in "ro" for c in cols])


def key_at_count(df: DataFrame, key: str, target: int,
                 by: Sequence[str] = ()) -> DataFrame:
    """Rows whose key is the ``target``-th smallest in their group (1-based).

    Exact selection over a unique key using running counts, so a group of
    any size is split over many tasks.
    """
    counted = running_sum(df.withColumn("_one", F.lit(1).cast("long")), key, ["_one"], by=by)
    return counted.filter(F.col("_one_cum") == target).drop("_one", "_one_cum")
