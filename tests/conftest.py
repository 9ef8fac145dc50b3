import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from riskframe.session import local_session
    s = local_session(cores=4, shuffle_partitions=8, app="riskframe-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fixture_txn(spark):
    """1,700 transactions from hash expressions: ids from 2**60 on, a timestamp that a third
    of the rows share, a hot card, and columns that are NULL at various rates."""
    from pyspark.sql import functions as F
    rows = 1700

    def pick(values, salt, nulls=0):
        return F.get(F.array(*map(F.lit, values)), spread(salt, len(values) + nulls).cast("int"))

    def spread(salt, size):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(size))
    return spark.range(rows).repartition(5).select(
        (F.col("id") + F.lit(1 << 60)).alias("txn_id"),
        F.when(spread(1, 3) == 0, F.lit(5_000_000)).otherwise(spread(2, 9_000_000)).cast("long").alias("dt"),
        (spread(3, 500_000) / 100.0).alias("amt"),
        pick(["web", "app", "till", "phone"], 4).alias("product"),
        F.when(spread(5, 4) == 0, F.lit(77)).otherwise(spread(6, 400)).cast("long").alias("card_id"),
        pick(["red", "blue"], 7, 1).alias("card4"), pick(["gold"], 8, 1).alias("card6"),
        pick(["mail.example", "post.example"], 9, 2).alias("email"),
        pick(["inbox.example"], 10, 3).alias("r_email"), pick(["yes", "no"], 11, 5).alias("m1"),
        (spread(12, 25) == 0).cast("int").alias("is_fraud"))
