"""Table access and the ``txn`` binding.

No fraud data ships with the test tables, so every transaction operator runs
on a deterministic binding of ``events`` (transactions) left joined with the
``BUILDING`` customers (a sparse identity side). The binding only renames and
derives columns; it performs none of the operators' work.

Role map: txn_id=TransactionID, dt=TransactionDT, amt=TransactionAmt,
card_id=card1, product=ProductCD, email=P_emaildomain, dist1=dist1,
device=DeviceType, is_fraud=isFraud, score=model score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.numeric import nan_to_null

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan over the cluster's cores when it arrives in fewer
    partitions than that (a small file or a single row group). Large inputs are
    already split by the scan and are returned unchanged (no extra shuffle)."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < target:
            return df.repartition(target)
    except Exception:  # noqa: BLE001 - no RDD view (remote sessions): leave as is
        pass
    return df


def fact_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A large-side table, spread over the cores when its scan is narrow."""
    return spread(table(spark, sf_dir, name))


# Fixed values of the binding (shared with the SQL text in plans/oracle.py).
K_EXPR = "cast(get_json_object(props, '$.k') as int)"
DT_EXPR = ("cast(unix_timestamp(ts) - unix_timestamp(timestamp_ntz'2024-01-01 00:00:00')"
           " as bigint)")


EPOCH_2024 = 1704067200          # 2024-01-01 00:00:00 UTC in epoch seconds


def identity_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
            .select("c_custkey", "c_nationkey"))


def txn_from_events(ev: DataFrame, ident: DataFrame, event_time: bool = False) -> DataFrame:
    """The binding over any events frame (batch or stream) and the identity side.
    ``event_time`` adds an instant column for streaming windows and watermarks."""
    b = ev.select(
        F.col("event_id").alias("txn_id"),
        F.expr(DT_EXPR).alias("dt"),
        nan_to_null("value").alias("amt"),
        F.col("user_id").alias("card_id"),
        F.col("event_type").alias("product"),
        F.expr(K_EXPR).alias("k"),
    )
    u = (F.pmod(F.col("txn_id") * 7919 + F.col("k") * 104729, F.lit(10007)).cast("double")
         / F.lit(10007.0))
    b = b.withColumn("u", u).withColumn(
        "is_fraud", F.when(F.col("k") % 28 == 0, 1).otherwise(0))
    one = F.lit(1.0)
    b = b.withColumns({
        "score": F.when(F.col("is_fraud") == 1,
                        one - (one - F.col("u")) * (one - F.col("u")) * (one - F.col("u")))
                  .otherwise(F.col("u") * F.col("u") * F.col("u")),
        "email": F.when(F.col("k") % 6 == 0, F.lit(None).cast("string"))
                  .otherwise(F.concat(F.lit("dom"), (F.col("k") % 9).cast("string"))),
        "dist1": F.when(F.col("k") % 5 < 3, F.lit(None).cast("double"))
                  .otherwise(F.col("amt") * F.lit(0.5)),
    })
    device: Column = (F.when(F.col("c_custkey").isNull(), F.lit(None).cast("string"))
                      .when(F.col("c_nationkey") % 2 == 0, F.lit("mobile"))
                      .otherwise(F.lit("desktop")))
    cols = ["txn_id", "dt", "amt", "card_id", "product", "k", "u", "is_fraud",
            "score", "email", "dist1", device.alias("device")]
    if event_time:
        cols.append(F.timestamp_seconds(F.col("dt") + F.lit(EPOCH_2024)).alias("event_time"))
    return b.join(ident, b.card_id == ident.c_custkey, "left").select(*cols)


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored transaction table (12 columns)."""
    return txn_from_events(fact_table(spark, sf_dir, "events"), identity_side(spark, sf_dir))


def txn_of(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """The rows of ``txn`` for the few transactions in ``ids`` (txn_id), taken from the scan
    before the identity side is joined."""
    few = F.broadcast(ids.select(F.col("txn_id").alias("event_id")))
    return txn_from_events(table(spark, sf_dir, "events").join(few, "event_id", "left_semi"), identity_side(spark, sf_dir))


def lineitem_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger binding for throughput runs: label = returned line, score = a fixed
    linear mix of discount, tax and quantity, id = a 64-bit hash of the line's key
    columns (a tie-break key; the (order, line number) pair alone is not unique)."""
    li = fact_table(spark, sf_dir, "lineitem")
    return li.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                   "l_shipdate", "l_quantity").alias("txn_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_fraud"),
        (F.col("l_discount") * 5 + F.col("l_tax") * 3
         + F.col("l_quantity") / 50.0).alias("score"),
        F.col("l_extendedprice").alias("amt"),
        F.col("l_returnflag"), F.col("l_linestatus"),
    )
