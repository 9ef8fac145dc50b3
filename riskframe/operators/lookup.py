"""Looking rows up in a table of values (a dictionary, an encoding) without a hot key.

A table of at most BROADCAST_BYTES (measured) is broadcast, and the rows stay where they are.
Beyond that the rows are shuffled by the value, except those that would meet in one task: rows
without a value, and values that make up 1 / HEAVY_PARTS or more of the rows. The heavy values
are found by a mergeable counting sketch in one pass (it only balances the work); their part of the
table, at most HEAVY_PARTS rows, is broadcast. Rows that are settled are dealt out by a hash of
the whole row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 << 20
ROW_BYTES = 64              # of a table row besides its value
HEAVY_PARTS = 1000
TRACKED = 10_000            # values a sketch counts


def heavy_values(df: DataFrame, keys: Mapping[str, Column]) -> dict[str, list[str]]:
    """For each named key, the values that make up about 1 / HEAVY_PARTS of the rows or more."""
    if not keys:
        return {}
    named = df.select(*[k.cast("string").alias(n) for n, k in keys.items()])
    row = named.agg(F.count("*").alias("_n"), *[
        F.expr(f"approx_top_k(`{n}`, {HEAVY_PARTS}, {TRACKED})").alias(n) for n in keys]).first()
    return {n: [x["item"] for x in row[n] or () if x["item"] is not None and x["count"] * HEAVY_PARTS >= row["_n"]] for n in keys}


def small_tables(table: DataFrame, name: str, value: str) -> set[str]:
    """The names whose rows in ``table`` (name, value, ...) may be broadcast."""
    sizes = table.groupBy(name).agg(F.sum(F.octet_length(F.coalesce(value, F.lit(""))) + ROW_BYTES).alias("_b"))
    return {r[name] for r in sizes.collect() if r["_b"] <= BROADCAST_BYTES}


def look_up(df: DataFrame, key: Column, table: DataFrame, value: str, outs: Sequence[str], small: bool,
            heavy: Sequence[str] = ()) -> DataFrame:
    """Adds the columns ``outs`` of the table's row whose ``value`` equals the key (NULL where
    there is none). Values of the table must be distinct."""
    slim = table.select(F.col(value).alias("_value"), *[F.col(o).alias(f"_o_{o}") for o in outs])
    keyed = df.withColumn("_key", key.cast("string"))
    if small:
        out = keyed.join(F.broadcast(slim), F.col("_key") == F.col("_value"), "left")
        return out.withColumnsRenamed({f"_o_{o}": o for o in outs}).drop("_key", "_value")
    if heavy:
        hot = F.col("_key").isin(list(heavy))
        first = slim.filter(F.col("_value").isin(list(heavy))).withColumnsRenamed({f"_o_{o}": f"_h_{o}" for o in outs})
        keyed = keyed.join(F.broadcast(first), F.col("_key") == F.col("_value"), "left").drop("_value")
        keyed = keyed.withColumn("_rest", F.when(~hot, F.col("_key")))
    else:
        keyed = keyed.withColumns({"_rest": F.col("_key"), **{f"_h_{o}": F.lit(None).cast(table.schema[o].dataType) for o in outs}})
    settled = F.col("_rest").isNull()
    keyed = keyed.withColumn("_salt", F.when(settled, F.xxhash64(*df.columns)).otherwise(F.lit(0).cast("long")))
    rest = slim.withColumn("_zero", F.pmod(F.xxhash64("_value"), F.lit(1).cast("long")))
    out = keyed.join(rest, (F.col("_rest") == F.col("_value")) & (F.col("_salt") == F.col("_zero")), "left")
    return out.withColumns({o: F.coalesce(f"_h_{o}", f"_o_{o}") for o in outs}).drop(
        "_key", "_rest", "_salt", "_zero", "_value", *[f"_{x}_{o}" for x in "ho" for o in outs])
