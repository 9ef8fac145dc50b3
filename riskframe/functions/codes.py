"""Fixed lookup values and label rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# ---------------------------------------------------------------------------

# Stability thresholds for PSI.
PSI_STABLE = 0.10
PSI_MODERATE = 0.20

# Score bands and the action attached to each band.
RISK_HIGH = 0.70
RISK_MEDIUM = 0.40
ACTION_FOR_RISK = {"high": "auto_decline", "medium": "escalate", "low": "auto_approve"}

# Action classes as ordinals; unknown or absent counts as escalate.
ACTION_ORDINAL = {"auto_approve": 0, "escalate": 1, "auto_decline": 2}
ACTION_DEFAULT = 1

# Four-fifths rule threshold.
FOUR_FIFTHS = 0.80

# Adverse-action reason codes and their texts.
REASON_CODES = {
    "R01": "Unusual transaction amount relative to account history",
    "R02": "High transaction velocity or frequency on this card",
    "R03": "Email domain associated with elevated fraud risk",
    "R04": "Transaction inconsistent with typical geographic pattern",
    "R05": "Device characteristics inconsistent with account profile",
    "R06": "Transaction pattern deviates from established account behavior",
    "R07": "Time-of-day or day-of-week anomaly for this account",
    "R08": "Billing or shipping address information inconsistency",
    "R09": "Card type or issuer profile associated with elevated risk",
    "R10": "Multiple identity fields could not be verified",
    "R11": "Product category associated with elevated fraud risk",
    "R12": "Aggregate risk score across behavioral dimensions elevated",
    "R13": "Transaction amount exceeds typical category spend",
    "R14": "Cross-channel or cross-device activity pattern detected",
    "R15": "Account-level risk signal from historical transaction graph",
}

# Named feature -> reason code (the source feature names).
FEATURE_CODES = {
    "TransactionAmt": "R01",
    "TransactionAmt_log": "R01",
    "ProductCD": "R11",
    "card1": "R09", "card2": "R09", "card3": "R09",
    "card4": "R09", "card5": "R09", "card6": "R09",
    "addr1": "R08", "addr2": "R08",
    "dist1": "R04", "dist2": "R04",
    "P_emaildomain": "R03",
    "R_emaildomain": "R03",
    "uid_card1_email": "R09",
    "tx_hour": "R07",
    "tx_dayofweek": "R07",
    "DeviceType": "R05",
    "DeviceInfo": "R05",
}

# Ordered pattern fallbacks (first match wins), then the catch-all code.
FEATURE_PATTERNS = [
    (r"^C\d+$", "R02"),
    (r"^D\d+$", "R06"),
    (r"^M\d+$", "R08"),
    (r"^id_0[1-9]$|^id_1[0-9]$|^id_2[0-4]$", "R10"),
    (r"^id_2[5-9]$|^id_3[0-8]$", "R05"),
    (r"^V\d+$", "R12"),
]
FALLBACK_CODE = "R12"

# Our binding's column names for the source features (role map of the txn table).
BINDING_FEATURE_NAMES = {
    "amt": "TransactionAmt",
    "amt_log": "TransactionAmt_log",
    "product": "ProductCD",
    "card_id": "card1",
    "email": "P_emaildomain",
    "dist1": "dist1",
    "device": "DeviceType",
    "uid_card_email": "uid_card1_email",
    "tx_hour": "tx_hour",
    "tx_dayofweek": "tx_dayofweek",
}


def _map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def risk_band(score: Column) -> Column:
    return (F.when(score >= RISK_HIGH, F.lit("high"))
             .when(score >= RISK_MEDIUM, F.lit("medium"))
             .otherwise(F.lit("low")))


def risk_action(band: Column) -> Column:
    return F.element_at(_map_literal(ACTION_FOR_RISK), band)


def psi_label(psi: Column) -> Column:
    return (F.when(psi.isNull() | F.isnan(psi), F.lit("unknown"))
             .when(psi < PSI_STABLE, F.lit("stable"))
             .when(psi < PSI_MODERATE, F.lit("moderate_drift"))
             .otherwise(F.lit("significant_drift")))


def action_ordinal(action: Column) -> Column:
    return F.coalesce(F.try_element_at(_map_literal(ACTION_ORDINAL), action),
                      F.lit(ACTION_DEFAULT))


def reason_code(feature: Column) -> Column:
    """Feature name -> code: direct map, then ordered patterns, else the catch-all."""
    (first_pat, first_code), *rest = FEATURE_PATTERNS
    expr = F.when(feature.rlike(first_pat), F.lit(first_code))
    for pat, code in rest:
        expr = expr.when(feature.rlike(pat), F.lit(code))
    expr = expr.otherwise(F.lit(FALLBACK_CODE))
    return F.coalesce(F.try_element_at(_map_literal(FEATURE_CODES), feature), expr)


def reason_text(code: Column) -> Column:
    return F.try_element_at(_map_literal(REASON_CODES), code)
