"""Transaction lookups and per-card history, single and batch forms.

The batch forms are what a Spark user runs: every card or every requested id
at once, as one grouped job or one join, instead of a loop of point lookups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.numeric import mean_half_up, rnd

SECONDS_PER_DAY = 86400
DETAIL_FIELDS = ["txn_id", "amt", "dt", "product", "card_id", "email", "dist1",
                 "tx_hour", "tx_dayofweek", "device"]


def lookback_filter(df: DataFrame, days: int, order: str = "dt") -> DataFrame:
    """Rows with dt >= max(dt) - days * 86400 (anchored to the table's last time)."""
    max_dt = df.agg(F.max(order)).first()[0]
    if max_dt is None:
        return df.limit(0)
    return df.filter(F.col(order) >= F.lit(max_dt - days * SECONDS_PER_DAY))


EMAILS = "unique_email_domains"


def _history_aggs(amt: str, product: str, hour: str):
    return [
        F.count(F.lit(1)).alias("n_transactions_in_window"),
        rnd(F.sum(amt), 2).alias("total_amount"),
        mean_half_up(amt, 2).alias("mean_amount"),
        rnd(F.max(amt), 2).alias("max_amount"),
        rnd(F.min(amt), 2).alias("min_amount"),
        # product codes are a short list, hours at most 25; mail domains are not bounded: ``first_values``
        F.array_join(F.array_sort(F.collect_set(product)), ",").alias("unique_products"),
        F.array_join(F.array_sort(F.collect_set(F.bround(F.col(hour), 0).cast("int"))), ",")
         .alias("hours_active"),
    ]


def first_values(df: DataFrame, key: str, value: str, out: str, most: int = 5) -> DataFrame:
    """key, out: the ``most`` smallest distinct values of each key, comma separated. Pairs are made
    distinct by (key, value), so a key with millions of values is spread over the tasks, and the
    rank limit is taken inside each task before rows meet by key."""
    pairs = df.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("_v")).distinct()
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_v"))).filter(F.col("_r") <= most)
    return ranked.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("_v")), ",").alias(out))     # at most `most`


def customer_history_all(df: DataFrame, days: int = 30, card: str = "card_id",
                         amt: str = "amt", product: str = "product", email: str = "email",
                         hour: str = "tx_hour", order: str = "dt") -> DataFrame:
    """For every card: window statistics over the last ``days`` days of the table.

    One grouped pass over all rows: the inputs are masked to the window, so a
    card with history but none inside the window gets a zero-count row. The mail domains
    come from a bounded aggregate of their own, joined by card (one row each)."""
    max_dt = df.agg(F.max(order)).first()[0]
    if max_dt is None:
        return df.sparkSession.createDataFrame([], f"{card} long, n_transactions_in_window long")
    inw = F.col(order) >= F.lit(max_dt - days * SECONDS_PER_DAY)
    x = df.select(card, inw.alias("_in"), *[F.when(inw, F.col(c)).alias(f"_w_{c}") for c in (amt, product, email, hour)])
    aggs = _history_aggs(f"_w_{amt}", f"_w_{product}", f"_w_{hour}")
    aggs[0] = F.count(F.when(F.col("_in"), 1)).alias("n_transactions_in_window")
    emails = first_values(x, card, f"_w_{email}", "_mails").withColumnRenamed(card, "_card")
    agg = x.groupBy(card).agg(*aggs).join(emails, F.col(card).eqNullSafe(F.col("_card")), "left") \
        .withColumn(EMAILS, F.coalesce("_mails", F.lit(""))).drop("_card", "_mails")
    has = F.col("n_transactions_in_window") > 0
    return agg.select(card, "n_transactions_in_window", *[
        F.when(has, F.col(c)).alias(c) for c in agg.columns if c not in (card, "n_transactions_in_window")]
    ).withColumn("lookback_days", F.lit(days))


def customer_history(df: DataFrame, card_id: int, days: int = 30, **kw) -> DataFrame:
    """One card: statistics, or a zero-count record with a note when the card is
    unknown or has no rows in the window."""
    card = kw.get("card", "card_id")
    window = lookback_filter(df, days, kw.get("order", "dt"))
    own = window.filter(F.col(card) == F.lit(card_id))
    # five values at most
    mails = [r[0] for r in own.select(kw.get("email", "email")).na.drop().distinct().orderBy(kw.get("email", "email")).limit(5).collect()]
    one = own.agg(*_history_aggs(kw.get("amt", "amt"), kw.get("product", "product"), kw.get("hour", "tx_hour"))) \
        .withColumn(EMAILS, F.lit(",".join(mails)))
    known = df.filter(F.col(card) == F.lit(card_id)).limit(1).count() > 0
    note = (F.when(F.col("n_transactions_in_window") > 0, F.lit(None).cast("string"))
             .otherwise(F.lit("No transaction history found for this card." if not known
                              else f"No transactions in the last {days} days.")))
    return one.select(F.lit(card_id).cast("long").alias("card_id"), F.lit(days).alias("lookback_days"),
                      "*", note.alias("note"))


def txn_details(df: DataFrame, fields=DETAIL_FIELDS, score: str = "score") -> DataFrame:
    """Readable fields with doubles rounded to 4 (NULL kept) and the score (4)."""
    types = dict(df.dtypes)
    cols = [rnd(f, 4).alias(f) if types[f] == "double" else F.col(f)
            for f in fields if f in types]
    return df.select(*cols, rnd(score, 4).alias("fraud_score"))


def lookup_txn(requests: DataFrame, table: DataFrame, id_col: str = "txn_id") -> DataFrame:
    """Batch point lookup: every requested id with found=true/false and the row."""
    hit = table.withColumn("_found", F.lit(True))
    return (requests.select(id_col).join(hit, id_col, "left")
                    .withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found"))


def score_range(df: DataFrame, lo: float, hi: float, score: str = "score") -> DataFrame:
    return df.filter(F.col(score).between(lo, hi))


def card_history_point_in_time(df: DataFrame, days: int = 30, card: str = "card_id", order: str = "dt",
                               amt: str = "amt", id_col: str = "txn_id") -> DataFrame:
    """For every transaction: count and amount sum of the same card's rows in
    [t - days, t - 1 second] (the point-in-time form of the card history).

    Rows are reduced to (card, second) totals; a probe row is added at each
    window start t - days, sorted before data rows of the same second; one
    distributed running sum per card (bucketed, so a hot card is split over many
    tasks) gives, at a data row, the total before t and, at its probe, the total
    before t - days. The window is their difference; no range join."""
    from riskframe.operators.prefix import running_sum
    span = days * SECONDS_PER_DAY
    per = df.groupBy(card, order).agg(F.count(F.lit(1)).alias("_c"), F.sum(amt).alias("_s"))
    data = per.select(card, F.col(order).alias("_t"), F.lit(1).alias("_kind"), F.col(order).alias("_for"),
                      "_c", "_s")
    probes = per.select(card, (F.col(order) - F.lit(span)).alias("_t"), F.lit(0).alias("_kind"),
                        F.col(order).alias("_for"), F.lit(0).cast("long").alias("_c"),
                        F.lit(0.0).alias("_s"))
    run = running_sum(data.unionByName(probes), "_t", ["_c", "_s"], by=[card],
                      order=[F.col("_t"), F.col("_kind")])
    before_t = run.filter(F.col("_kind") == 1).select(
        card, F.col("_for").alias(order), (F.col("_c_cum") - F.col("_c")).alias("_cb"),
        (F.col("_s_cum") - F.col("_s")).alias("_sb"))
    before_start = run.filter(F.col("_kind") == 0).select(
        card, F.col("_for").alias(order), F.col("_c_cum").alias("_cp"), F.col("_s_cum").alias("_sp"))
    win = before_t.join(before_start, [card, order]).select(
        card, order, (F.col("_cb") - F.col("_cp")).alias("n_prior"), (F.col("_sb") - F.col("_sp")).alias("_sum"))
    return df.select(id_col, card, order).join(win, [card, order]).select(
        id_col, "n_prior", F.when(F.col("n_prior") > 0, rnd("_sum", 2)).alias("amount_prior"))
