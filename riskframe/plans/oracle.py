"""SQL text of the ``txn`` binding for the DuckDB oracle (same rows as
``sources.tables.txn``). Each oracle query is ``WITH <txn>, ... SELECT``."""

from __future__ import annotations

TXN_CTE = """txn_b AS (
  SELECT event_id AS txn_id,
         CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) AS BIGINT) AS dt,
         CASE WHEN isnan(value) THEN NULL ELSE value END AS amt, user_id AS card_id, event_type AS product,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events),
txn_u AS (
  SELECT txn_b.*,
         CAST((txn_id * 7919 + k * 104729) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS u,
         CASE WHEN k % 28 = 0 THEN 1 ELSE 0 END AS is_fraud
  FROM txn_b),
txn_t AS (
  SELECT txn_u.*,
         CASE WHEN is_fraud = 1 THEN CAST(1 AS DOUBLE) - (1 - u) * (1 - u) * (1 - u)
              ELSE u * u * u END AS score,
         CASE WHEN k % 6 = 0 THEN NULL ELSE concat('dom', CAST(k % 9 AS VARCHAR)) END AS email,
         CASE WHEN k % 5 < 3 THEN NULL ELSE amt * CAST(0.5 AS DOUBLE) END AS dist1
  FROM txn_u),
txn AS (
  SELECT txn_t.txn_id, txn_t.dt, txn_t.amt, txn_t.card_id, txn_t.product, txn_t.k, txn_t.u,
         txn_t.is_fraud, txn_t.score, txn_t.email, txn_t.dist1,
         CASE WHEN c.c_custkey IS NULL THEN NULL
              WHEN c.c_nationkey % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device
  FROM txn_t LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c
       ON txn_t.card_id = c.c_custkey)"""

# Engineered features (build_features) over txn, as SQL.
FEAT_CTE = """feat AS (
  SELECT txn.*,
         ln(1 + amt) AS amt_log,
         concat(CAST(card_id AS VARCHAR), '_', coalesce(email, 'nan')) AS uid_card_email,
         CAST(dt % 86400 AS DOUBLE) / CAST(3600 AS DOUBLE) AS tx_hour,
         CAST((dt // 86400) % 7 AS BIGINT) AS tx_dayofweek,
         CAST(dt // 86400 AS BIGINT) AS tx_day
  FROM txn)"""


def with_txn(*ctes: str, body: str) -> str:
    parts = [TXN_CTE, *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def reason_code_sql(x: str) -> str:
    """The feature -> code rule of functions.codes as a SQL CASE expression."""
    from riskframe.functions import codes
    parts = [f"WHEN {x} = '{k}' THEN '{v}'" for k, v in codes.FEATURE_CODES.items()]
    parts += [f"WHEN regexp_matches({x}, '{p}') THEN '{c}'" for p, c in codes.FEATURE_PATTERNS]
    return "CASE " + " ".join(parts) + f" ELSE '{codes.FALLBACK_CODE}' END"


def reason_text_sql(x: str) -> str:
    from riskframe.functions import codes
    parts = [f"WHEN {x} = '{k}' THEN '{v}'" for k, v in codes.REASON_CODES.items()]
    return "CASE " + " ".join(parts) + " END"


def mean_half_up_sql(x: str, d: int) -> str:
    """SQL form of functions.numeric.mean_half_up: exact decimal sum in units of 1e-14
    (the text of a double has the same digits in both engines), integer division."""
    s = f"sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,14)))"
    units = (f"(CAST(trunc({s}) AS HUGEINT) * 100000000000000"
             f" + CAST(({s} - trunc({s})) * 100000000000000 AS HUGEINT))")
    n = f"(CAST(count({x}) AS HUGEINT) * {10 ** (14 - d)})"
    return (f"(CASE WHEN count({x}) = 0 THEN NULL ELSE sign({s}) * CAST((abs({units}) * 2 + {n}) // ({n} * 2) AS DOUBLE)"
            f" / {10 ** d} END)")
