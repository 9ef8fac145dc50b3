"""Report guardrails as column expressions over a table of reports.

Each check returns per-report columns (passed flag, issue counts); all four
run in one projection, so checking a billion reports is one map-only pass.
The personal-data scan also runs over free text (``documents.text``), whole
texts, as a map-only pass of regex counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Required keys, enumerations, patterns.
# ---------------------------------------------------------------------------
REQUIRED_FIELDS = {            # report key -> our column
    "transaction_id": "txn_id",
    "risk_assessment": "risk_assessment",
    "recommended_action": "recommended_action",
    "priority_score": "priority_raw",
    "sar_narrative": "sar_narrative",
    "adverse_action_reason_codes": "reason_codes",
    "supporting_evidence": "evidence",
}
LISTS = ["adverse_action_reason_codes", "supporting_evidence"]
VALID_RISK = ["low", "medium", "high"]
VALID_ACTION = ["auto_approve", "escalate", "auto_decline"]
MIN_NARRATIVE = 20
FEATURE_MENTION = r"\b(v\d+|c\d+|d\d+|m[1-9]\d*|card\d+)\b"
PII_PATTERNS = [
    ("card_number", r"\b\d{13,16}\b"),
    ("ssn", r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b"),
    ("cvv", r"(?i)\b\d{3,4}\b(?=\s*(cvv|cvc|security code))"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("account_number", r"\b\d{9,10}\b"),
]


def _present(c: str) -> Column:
    return F.col(c).isNotNull()


def _wrong_type(r: DataFrame, key: str) -> Column:
    """Whether the report has the key with a value of another type (known for reports read from JSON)."""
    return F.coalesce(F.array_contains("wrong_types", key), F.lit(False)) if "wrong_types" in r.columns else F.lit(False)


def schema_check(r: DataFrame) -> DataFrame:
    """schema_issues (count) and schema_passed."""
    missing = sum((~_present(c) & ~_wrong_type(r, key)).cast("int") for key, c in REQUIRED_FIELDS.items())
    bad_risk = (_present("risk_assessment") & ~F.col("risk_assessment").isin(VALID_RISK)).cast("int")
    bad_action = (_present("recommended_action") & ~F.col("recommended_action").isin(VALID_ACTION)).cast("int")
    is_int = F.col("priority_raw").rlike(r"^-?[0-9]+$")
    pr = F.when(is_int, F.col("priority_raw").cast("decimal(38,0)"))
    bad_prio = (_present("priority_raw") & ~(is_int & (pr >= 1) & (pr <= 10))).cast("int")
    ev_absent = F.when(_present("evidence"), F.aggregate(
        "evidence", F.lit(0),
        lambda acc, e: acc + e["claim"].isNull().cast("int") + e["source"].isNull().cast("int")
        + e["value"].isNull().cast("int"))).otherwise(F.lit(0))
    # reports read from JSON bring the number of keys that are not there; a null value is not a missing key
    ev_missing = F.coalesce("evidence_missing", ev_absent) if "evidence_missing" in r.columns else ev_absent
    not_text = _wrong_type(r, "sar_narrative")
    short = ((_present("sar_narrative") & (F.length("sar_narrative") < MIN_NARRATIVE)) | not_text).cast("int")
    no_list = sum(_wrong_type(r, key).cast("int") for key in LISTS)
    # missing keys are reported as one issue
    n = (F.when(missing > 0, 1).otherwise(0) + bad_risk + bad_action + bad_prio + ev_missing + short + no_list)
    return r.withColumns({"schema_issues": n, "schema_passed": n == 0})


def grounding_check(r: DataFrame) -> DataFrame:
    """grounding_passed, n_cited, n_hallucinated, shap_sourced."""
    ev = F.coalesce(F.col("evidence"), F.array().cast("array<struct<claim:string,source:string,value:string>>"))
    shap_ev = F.filter(ev, lambda e: F.lower(F.coalesce(e["source"], F.lit(""))).contains("shap"))
    shap_sourced = F.size(shap_ev) > 0
    text = F.lower(F.array_join(F.transform(
        shap_ev, lambda e: F.concat(F.coalesce(e["claim"], F.lit("")), F.lit(" "),
                                    F.coalesce(e["value"], F.lit("")))), " "))
    top = F.transform(F.col("top_features"), lambda x: F.lower(x))
    found = F.regexp_extract_all(text, F.lit(FEATURE_MENTION), 1)
    halluc = F.filter(found, lambda x: ~F.array_contains(top, x))
    cited = F.filter(top, lambda x: text.contains(x))
    tool_ok = F.col("top_features").isNotNull() & (F.size("top_features") > 0)
    passed = tool_ok & shap_sourced & (F.size(halluc) == 0)
    return r.withColumns({
        "shap_sourced": shap_sourced,
        "n_cited": F.when(tool_ok, F.size(cited)).otherwise(F.lit(0)),
        "n_hallucinated": F.when(tool_ok, F.size(halluc)).otherwise(F.lit(0)),
        "grounding_passed": F.coalesce(passed, F.lit(False)),
    })


def report_text(r: DataFrame) -> Column:
    """All string values of a report joined by spaces (keys in report order)."""
    ev_vals = F.flatten(F.transform(
        F.coalesce(F.col("evidence"), F.array().cast("array<struct<claim:string,source:string,value:string>>")),
        lambda e: F.array(e["claim"], e["source"], e["value"])))
    return F.concat_ws(" ", F.col("risk_assessment"), F.col("recommended_action"), F.col("sar_narrative"),
                       F.array_join(F.coalesce(F.col("reason_codes"), F.array().cast("array<string>")), " "),
                       F.array_join(ev_vals, " "))


def pii_counts(text: Column, prefix: str = "pii_") -> dict[str, Column]:
    return {f"{prefix}{name}": F.regexp_count(text, F.lit(pat)) for name, pat in PII_PATTERNS}


def pii_check(r: DataFrame) -> DataFrame:
    """pii_types_found and pii_passed over all string values of the report."""
    cnt = pii_counts(report_text(r))
    n_types = sum((c > 0).cast("int") for c in cnt.values())
    return r.withColumns({"pii_types_found": n_types, "pii_passed": n_types == 0})


def action_check(r: DataFrame) -> DataFrame:
    """Decline without codes is a violation; three contradictions are warnings."""
    action = F.coalesce(F.col("recommended_action"), F.lit(""))
    risk = F.coalesce(F.col("risk_assessment"), F.lit(""))
    n_codes = F.coalesce(F.size("reason_codes"), F.lit(0))
    violation = (action == "auto_decline") & (n_codes == 0)
    warnings = (((action == "auto_approve") & (n_codes > 0)).cast("int")
                + ((risk == "high") & (action == "auto_approve")).cast("int")
                + ((risk == "low") & (action == "auto_decline")).cast("int"))
    return r.withColumns({"action_passed": ~violation, "action_warnings": warnings})


def guard_all(r: DataFrame, strict: bool = False) -> DataFrame:
    """All four checks and the overall flag (an errored run fails overall; with
    ``strict`` a warning of the action check does too)."""
    g = action_check(pii_check(grounding_check(schema_check(r))))
    passed = (F.col("schema_passed") & F.col("grounding_passed")
              & F.col("pii_passed") & F.col("action_passed") & F.col("error").isNull())
    return g.withColumn("all_passed", passed & (F.col("action_warnings") == 0) if strict else passed)


def findings(r: DataFrame) -> DataFrame:
    """Why a report fails: per check the list of what was found.

    schema_issues_found (``missing:<key>``, ``invalid:<key>``, ``type:<key>``, ``missing:evidence.<key>``),
    cited_features, invented_features, pii_types, violations, warnings. The lists
    explain the flags of ``guard_all``, which stay as they are."""
    def some(*pairs):
        return F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in pairs]), lambda x: x.isNotNull())
    prio_int = F.col("priority_raw").rlike(r"^-?[0-9]+$")
    prio = F.when(prio_int, F.col("priority_raw").cast("decimal(38,0)"))
    schema = some(
        *[(f"missing:{key}", ~_present(c) & ~_wrong_type(r, key)) for key, c in REQUIRED_FIELDS.items()],
        *[(f"type:{key}", _wrong_type(r, key)) for key in (*LISTS, "sar_narrative")],
        ("invalid:risk_assessment", _present("risk_assessment") & ~F.col("risk_assessment").isin(VALID_RISK)),
        ("invalid:recommended_action", _present("recommended_action") & ~F.col("recommended_action").isin(VALID_ACTION)),
        ("invalid:priority_score", _present("priority_raw") & ~F.coalesce(prio_int & prio.between(1, 10), F.lit(False))),
        ("invalid:sar_narrative", _present("sar_narrative") & (F.length("sar_narrative") < MIN_NARRATIVE)))
    evidence = F.coalesce(F.col("evidence"), F.array().cast("array<struct<claim:string,source:string,value:string>>"))
    if "evidence_missing" in r.columns:
        gaps = some(("missing:evidence_keys", F.coalesce(F.col("evidence_missing"), F.lit(0)) > 0))
    else:
        def lacks(k):
            return F.exists(evidence, lambda e: e[k].isNull())
        gaps = some(*[(f"missing:evidence.{k}", lacks(k)) for k in ("claim", "source", "value")])
    ev = F.filter(evidence, lambda e: F.lower(F.coalesce(e["source"], F.lit(""))).contains("shap"))
    text = F.lower(F.array_join(F.transform(ev, lambda e: F.concat_ws(" ", e["claim"], e["value"])), " "))
    top = F.transform(F.coalesce("top_features", F.array().cast("array<string>")), lambda x: F.lower(x))
    action, risk = F.coalesce("recommended_action", F.lit("")), F.coalesce("risk_assessment", F.lit(""))
    n_codes = F.coalesce(F.size("reason_codes"), F.lit(0))
    return r.withColumns({
        "schema_issues_found": F.concat(schema, gaps),
        "cited_features": F.filter(top, lambda x: text.contains(x)),
        "invented_features": F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(FEATURE_MENTION), 1),
                                                       lambda x: ~F.array_contains(top, x))),
        "pii_types": some(*[(name, c > 0) for name, c in pii_counts(report_text(r), "").items()]),
        "violations": some(("decline_without_codes", (action == "auto_decline") & (n_codes <= 0))),
        "warnings": some(("approve_with_codes", (action == "auto_approve") & (n_codes > 0)),
                         ("approve_high_risk", (risk == "high") & (action == "auto_approve")),
                         ("decline_low_risk", (risk == "low") & (action == "auto_decline")))})


def tool_output(r: DataFrame, tool: str) -> Column:
    """Output of the first log entry of ``tool`` (NULL when never called)."""
    return F.try_element_at(F.filter(F.col("tool_log"), lambda x: x["tool"] == F.lit(tool)), F.lit(1))["output"]


def needs_review(g: DataFrame) -> Column:
    """Review triggers: a decline, any failed guardrail, or priority >= 9."""
    prio = F.when(F.col("priority_raw").rlike(r"^-?[0-9]+$"), F.col("priority_raw").cast("decimal(38,0)"))
    return F.coalesce((F.col("recommended_action") == "auto_decline"), F.lit(False)) | ~F.col("all_passed") | \
        F.coalesce(prio >= 9, F.lit(False))


def scan_text_pii(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """Per text: match counts of each personal-data pattern over the whole text."""
    return df.select(id_col, *[c.alias(n) for n, c in pii_counts(F.col(text), "").items()])
