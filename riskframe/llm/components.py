"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import materialize


def _minimum(nbr: DataFrame) -> DataFrame:
    # one row per node: partial minima are combined before the shuffle, so a node
    # with very many links costs no task more than others
    return nbr.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minimum(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node without links of its own."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(
        edges.select("v", F.lit(0), F.lit(1)))
    at = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return at.filter((F.col("out") > 1) | (F.col("out") > 0) & (F.col("into") > 0)).limit(1).count() == 0


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) for every id in ``edges`` (columns u, v; direction and repeats
    don't matter; self-links and nulls are ignored), component = smallest id reachable.
    Each round writes its edges to the shared folder, until all of them form stars
    around the smallest ids. An empty input gives no rows."""
    now = materialize(edges.select("u", "v").filter("u is not null and v is not null and u != v")
                      .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-0")
    k = 0
    while not _is_stars(now):
        k += 1
        now = materialize(_small_star(_large_star(now)), f"{label}-{k}")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        now.select("v", "v").distinct())
