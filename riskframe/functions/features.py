"""Row-local engineered features as Column expressions (stay in codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def amount_log(amt: str = "amt") -> Column:
    """log1p of the amount (NULL where the amount is NULL or <= -1)."""
    return F.log1p(F.col(amt))


def card_email_uid(card: str = "card_id", email: str = "email") -> Column:
    """card id, '_', email domain; a missing domain is written 'nan'."""
    return F.concat_ws("_", F.col(card).cast("string"), F.coalesce(F.col(email), F.lit("nan")))


def tx_hour(dt: str = "dt") -> Column:
    """Hour of day as a fraction in [0, 24) from the seconds counter."""
    return F.pmod(F.col(dt), F.lit(SECONDS_PER_DAY)).cast("double") / F.lit(3600.0)


def tx_day(dt: str = "dt") -> Column:
    return F.floor(F.col(dt) / F.lit(SECONDS_PER_DAY)).cast("long")


def tx_dayofweek(dt: str = "dt") -> Column:
    """(day number) mod 7: a weekday proxy, not a calendar weekday."""
    return F.pmod(tx_day(dt), F.lit(7)).cast("long")


def build_features(df: DataFrame, amt: str = "amt", dt: str = "dt",
                   card: str = "card_id", email: str = "email") -> DataFrame:
    """Add amt_log, uid_card_email, tx_hour, tx_dayofweek, tx_day in one projection."""
    return df.withColumns({
        "amt_log": amount_log(amt),
        "uid_card_email": card_email_uid(card, email),
        "tx_hour": tx_hour(dt),
        "tx_dayofweek": tx_dayofweek(dt),
        "tx_day": tx_day(dt),
    })


ID_TARGET = ("txn_id", "is_fraud")


def select_features(df: DataFrame, exclude=ID_TARGET) -> list[str]:
    """All columns except id and target."""
    return [c for c in df.columns if c not in set(exclude)]


def select_available(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """(present, missing) of a requested feature list, order kept."""
    cols = set(df.columns)
    return [c for c in wanted if c in cols], [c for c in wanted if c not in cols]


def categorical_columns(df: DataFrame, exclude=ID_TARGET) -> list[str]:
    """String-typed columns that are neither id nor target."""
    return [f.name for f in df.schema.fields
            if f.dataType.simpleString() == "string" and f.name not in set(exclude)]
