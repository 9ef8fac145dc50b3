"""Combine one-row aggregates into one row without a join.

Joining one-row frames on a constant key plans as a cartesian product; here
each frame is widened to the union of the columns (NULL elsewhere), the
frames are unioned (k rows) and one global aggregate keeps the non-null
value of every column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(*frames: DataFrame) -> DataFrame:
    fields = [f for df in frames for f in df.schema.fields]
    names = [f.name for f in fields]
    if len(set(names)) != len(names):
        raise ValueError(f"column names must be unique across frames: {names}")
    parts = []
    for df in frames:
        own = set(df.columns)
        parts.append(df.select(*[F.col(f.name) if f.name in own else F.lit(None).cast(f.dataType).alias(f.name)
                                 for f in fields]))
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return u.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
