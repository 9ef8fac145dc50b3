"""Guardrail and agreement queries (survey 2.14) over the investigation reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from riskframe.functions import codes
from riskframe.operators import agreement as ag
from riskframe.operators import guardrails as gr
from riskframe.operators.extract import extract_json_frame
from riskframe.plans.catalog import register
from riskframe.plans.oracle import with_txn
from riskframe.plans.q_cases import _EVAL_CTE, eval_set
from riskframe.session import ensure_checkpoint_dir, written
from riskframe.sources import reports as rp
from riskframe.sources.tables import fact_table, txn_of

_TOP_SQL = "[" + ", ".join(f"'{x}'" for x in rp.TOP_FEATURES) + "]"

REPORTS_CTE = f"""rb AS (
  SELECT txn.*, txn_id % 10 AS d,
         CASE WHEN score >= 0.70 THEN 'high' WHEN score >= 0.40 THEN 'medium' ELSE 'low' END AS band,
         CASE WHEN score >= 0.70 THEN 'auto_decline' WHEN score >= 0.40 THEN 'escalate' ELSE 'auto_approve' END AS act0,
         CAST(floor(score * 9) + 1 AS INTEGER) AS prio,
         CAST(floor(CAST(dt % 86400 AS DOUBLE) / CAST(3600 AS DOUBLE)) AS INTEGER) AS hr
  FROM txn),
rep AS (
  SELECT txn_id,
    CASE WHEN d = 0 THEN 'run stopped: iteration limit' END AS error,
    CASE WHEN d = 0 THEN NULL WHEN d = 1 THEN 'critical' ELSE band END AS risk_assessment,
    CASE WHEN d = 0 THEN NULL WHEN d = 8 THEN 'auto_decline' ELSE act0 END AS recommended_action,
    CASE WHEN d = 0 THEN NULL WHEN d = 2 THEN '11' ELSE CAST(prio AS VARCHAR) END AS priority_raw,
    CASE WHEN d = 0 THEN NULL WHEN d = 4 THEN 'Flagged.'
         WHEN d = 7 THEN 'Transaction ' || CAST(txn_id AS VARCHAR) || ' reviewed. Contact jane.doe@example.com about card 4111111111111111 before release.'
         ELSE 'Transaction ' || CAST(txn_id AS VARCHAR) || ' on card ' || CAST(card_id AS VARCHAR) || ' reviewed with priority '
              || CAST(prio AS VARCHAR) || ' in product ' || product || '.' END AS sar_narrative,
    CASE WHEN d = 0 THEN NULL WHEN d = 8 THEN CAST([] AS VARCHAR[])
         WHEN act0 = 'auto_decline' THEN ['R01', 'R07'] WHEN act0 = 'escalate' THEN ['R07']
         ELSE CAST([] AS VARCHAR[]) END AS reason_codes,
    CASE WHEN d = 0 THEN NULL ELSE [
      {{'claim': CASE WHEN d = 6 THEN 'Driven by V258 and card3 values'
                     ELSE 'Largest contribution from tx_hour at hour ' || CAST(hr AS VARCHAR) END,
       'source': CASE WHEN d = 5 THEN 'model_output' ELSE 'shap_explanation' END,
       'value': CAST(card_id AS VARCHAR)}},
      {{'claim': 'Card ' || CAST(card_id AS VARCHAR) || ' history', 'source': 'customer_history',
       'value': CASE WHEN d = 3 THEN NULL ELSE CAST(k AS VARCHAR) END}}] END AS evidence,
    CASE WHEN d = 0 THEN NULL ELSE {_TOP_SQL} END AS top_features,
    CASE WHEN d = 0 THEN [{{'iteration': 1, 'tool': 'get_transaction_details',
                           'output': '{{"transaction_id": ' || CAST(txn_id AS VARCHAR) || '}}'}}]
         ELSE [{{'iteration': 1, 'tool': 'get_transaction_details', 'output': '{{"transaction_id": ' || CAST(txn_id AS VARCHAR) || '}}'}},
               {{'iteration': 2, 'tool': 'get_shap_explanation',
                'output': '{{"transaction_id": ' || CAST(txn_id AS VARCHAR) || ', "n_features": 5}}'}},
               {{'iteration': 3, 'tool': 'get_customer_history', 'output': '{{"card_id": ' || CAST(card_id AS VARCHAR) || '}}'}},
               {{'iteration': 4, 'tool': 'get_reason_codes',
                'output': '{{"transaction_id": ' || CAST(txn_id AS VARCHAR) || ', "n_codes": '
                          || CASE WHEN act0 = 'auto_decline' THEN '2' WHEN act0 = 'escalate' THEN '1' ELSE '0' END || '}}'}}]
    END AS tool_log,
    score, is_fraud
  FROM rb)"""

_CVV_SQL = r"(?i)\b\d{3,4}\b\s*(cvv|cvc|security code)"
PII_SQL = [(n, _CVV_SQL if n == "cvv" else p) for n, p in gr.PII_PATTERNS]


def _pii_sql(text: str) -> list[str]:
    return [f"CAST(len(regexp_extract_all({text}, '{p}')) AS INTEGER) AS pii_{n}" for n, p in PII_SQL]


GUARD_CTE = REPORTS_CTE + f""",
g1 AS (
  SELECT rep.*,
    (CASE WHEN (txn_id IS NULL)::INT + (risk_assessment IS NULL)::INT + (recommended_action IS NULL)::INT
               + (priority_raw IS NULL)::INT + (sar_narrative IS NULL)::INT + (reason_codes IS NULL)::INT
               + (evidence IS NULL)::INT > 0 THEN 1 ELSE 0 END)
    + (risk_assessment IS NOT NULL AND risk_assessment NOT IN ('low', 'medium', 'high'))::INT
    + (recommended_action IS NOT NULL AND recommended_action NOT IN ('auto_approve', 'escalate', 'auto_decline'))::INT
    + (priority_raw IS NOT NULL AND NOT coalesce(regexp_matches(priority_raw, '^-?[0-9]+$')
          AND TRY_CAST(priority_raw AS DECIMAL(38,0)) BETWEEN 1 AND 10, false))::INT
    + CASE WHEN evidence IS NOT NULL THEN coalesce(list_sum(list_transform(evidence, lambda e:
          (e.claim IS NULL)::INT + (e.source IS NULL)::INT + (e.value IS NULL)::INT)), 0) ELSE 0 END
    + (sar_narrative IS NOT NULL AND length(sar_narrative) < 20)::INT AS schema_issues_raw,
    list_filter(coalesce(evidence, []), lambda e: contains(lower(coalesce(e.source, '')), 'shap')) AS shap_ev
  FROM rep),
g2 AS (
  SELECT g1.*, lower(array_to_string(list_transform(shap_ev, lambda e: coalesce(e.claim, '') || ' ' || coalesce(e.value, '')), ' ')) AS gtext,
         concat_ws(' ', risk_assessment, recommended_action, sar_narrative,
                   array_to_string(coalesce(reason_codes, CAST([] AS VARCHAR[])), ' '),
                   array_to_string(flatten(list_transform(coalesce(evidence, []), lambda e: [e.claim, e.source, e.value])), ' ')) AS ptext
  FROM g1),
g3 AS (
  SELECT g2.*,
    len(shap_ev) > 0 AS shap_sourced,
    list_filter(regexp_extract_all(gtext, '{gr.FEATURE_MENTION}', 1), lambda x: NOT list_contains(top_features, x)) AS halluc,
    list_filter(top_features, lambda x: contains(gtext, x)) AS cited,
    top_features IS NOT NULL AND len(top_features) > 0 AS tool_ok,
    {", ".join(_pii_sql('ptext'))}
  FROM g2),
g AS (
  SELECT g3.*,
    CAST(schema_issues_raw AS INTEGER) AS schema_issues,
    schema_issues_raw = 0 AS schema_passed,
    CAST(CASE WHEN tool_ok THEN len(cited) ELSE 0 END AS INTEGER) AS n_cited,
    CAST(CASE WHEN tool_ok THEN len(halluc) ELSE 0 END AS INTEGER) AS n_hallucinated,
    coalesce(tool_ok AND shap_sourced AND len(halluc) = 0, false) AS grounding_passed,
    ({" + ".join(f"(pii_{n} > 0)::INT" for n, _ in PII_SQL)}) AS pii_types_found,
    NOT (coalesce(recommended_action, '') = 'auto_decline' AND coalesce(len(reason_codes), 0) = 0) AS action_passed,
    ((coalesce(recommended_action, '') = 'auto_approve' AND coalesce(len(reason_codes), 0) > 0)::INT
     + (coalesce(risk_assessment, '') = 'high' AND coalesce(recommended_action, '') = 'auto_approve')::INT
     + (coalesce(risk_assessment, '') = 'low' AND coalesce(recommended_action, '') = 'auto_decline')::INT) AS action_warnings
  FROM g3),
ga AS (
  SELECT g.*, pii_types_found = 0 AS pii_passed,
         schema_passed AND grounding_passed AND pii_types_found = 0 AND action_passed AND error IS NULL AS all_passed
  FROM g)"""


def guarded(spark, sf_dir):
    return gr.guard_all(rp.reports(spark, sf_dir))


@register("guard_schema", with_txn(GUARD_CTE, body="SELECT txn_id, schema_issues, schema_passed FROM ga"))
def q_guard_schema(spark, sf_dir):
    """Required keys, enumerations, integer priority 1-10, evidence item keys, narrative length."""
    return gr.schema_check(rp.reports(spark, sf_dir)).select("txn_id", "schema_issues", "schema_passed")


@register("guard_grounding", with_txn(GUARD_CTE, body="""
SELECT txn_id, shap_sourced, n_cited, n_hallucinated, grounding_passed FROM ga"""))
def q_guard_grounding(spark, sf_dir):
    """Explanation-sourced evidence present; no feature named there outside the explanation's list."""
    return gr.grounding_check(rp.reports(spark, sf_dir)).select(
        "txn_id", "shap_sourced", "n_cited", "n_hallucinated", "grounding_passed")


@register("guard_pii", with_txn(GUARD_CTE, body="SELECT txn_id, " + ", ".join(
    f"pii_{n}" for n, _ in PII_SQL) + ", pii_passed FROM ga"))
def q_guard_pii(spark, sf_dir):
    """Match counts of five personal-data patterns over all string values of each report."""
    r = rp.reports(spark, sf_dir)
    cnt = gr.pii_counts(gr.report_text(r))
    out = r.select("txn_id", *[c.alias(n) for n, c in cnt.items()])
    return out.withColumn("pii_passed", sum((F.col(n) > 0).cast("int") for n in cnt) == 0)


@register("guard_action", with_txn(GUARD_CTE, body="SELECT txn_id, action_passed, action_warnings FROM ga"))
def q_guard_action(spark, sf_dir):
    """Decline without codes fails; approve with codes, high+approve, low+decline warn."""
    return gr.action_check(rp.reports(spark, sf_dir)).select("txn_id", "action_passed", "action_warnings")


_ALL_COLS = "txn_id, schema_passed, grounding_passed, pii_passed, action_passed, all_passed"


@register("guard_all", with_txn(GUARD_CTE, body=f"SELECT {_ALL_COLS} FROM ga"))
def q_guard_all(spark, sf_dir):
    """The four checks and the overall flag per report (errored runs fail overall)."""
    return guarded(spark, sf_dir).select(*[c.strip() for c in _ALL_COLS.split(",")])


@register("guard_findings")
def q_guard_findings(spark, sf_dir):
    """What each check found in each report, as lists (the reasons behind the flags)."""
    f = gr.findings(rp.reports(spark, sf_dir))
    lists = ["schema_issues_found", "cited_features", "invented_features", "pii_types", "violations", "warnings"]
    return f.select("txn_id", *[F.array_join(c, ",").alias(c) for c in lists])


@register("guard_recheck", with_txn(GUARD_CTE, body=f"SELECT {_ALL_COLS} FROM ga"))
def q_guard_recheck(spark, sf_dir):
    """Reports written to the shared checkpoint folder, read back and checked again."""
    path = ensure_checkpoint_dir(spark).rstrip("/") + "/reports_" + hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
    rp.reports(spark, sf_dir).write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    return gr.guard_all(stored).select(*[c.strip() for c in _ALL_COLS.split(",")])


@register("tool_output_extract", with_txn(REPORTS_CTE, body="""
SELECT txn_id, list_filter(tool_log, lambda x: x.tool = 'get_shap_explanation')[1].output AS shap_output,
       CAST(json_extract(list_filter(tool_log, lambda x: x.tool = 'get_shap_explanation')[1].output, '$.n_features') AS INTEGER) AS n_features
FROM rep"""))
def q_tool_output_extract(spark, sf_dir):
    """Output of the first explanation-tool call in each report's tool log."""
    r = rp.reports(spark, sf_dir)
    out = gr.tool_output(r, "get_shap_explanation")
    return r.select("txn_id", out.alias("shap_output"),
                    F.get_json_object(out, "$.n_features").cast("int").alias("n_features"))


@register("needs_review", with_txn(GUARD_CTE, body="""
SELECT txn_id, coalesce(recommended_action = 'auto_decline', false) OR NOT all_passed
       OR coalesce(CASE WHEN regexp_matches(priority_raw, '^-?[0-9]+$') THEN TRY_CAST(priority_raw AS DECIMAL(38,0)) END >= 9, false)
       AS needs_review
FROM ga"""))
def q_needs_review(spark, sf_dir):
    """Review trigger per report: a decline, any failed guardrail, or priority >= 9."""
    g = guarded(spark, sf_dir)
    return g.select("txn_id", gr.needs_review(g).alias("needs_review"))


@register("guard_pass_rates", with_txn(GUARD_CTE, body="""
SELECT count(*) AS n_cases, count(CASE WHEN error IS NULL THEN 1 END) AS n_completed,
       count(CASE WHEN error IS NOT NULL THEN 1 END) AS n_errors,
       round(avg(schema_passed::DOUBLE), 3) AS schema_rate, round(avg(grounding_passed::DOUBLE), 3) AS grounding_rate,
       round(avg(pii_passed::DOUBLE), 3) AS pii_rate, round(avg(action_passed::DOUBLE), 3) AS action_rate,
       round(avg(all_passed::DOUBLE), 3) AS all_rate
FROM ga"""))
def q_guard_pass_rates(spark, sf_dir):
    """Share of reports passing each check and all checks; completed and errored runs."""
    return ag.guard_pass_rates(guarded(spark, sf_dir))


@register("pii_scan_documents", with_txn(body="SELECT doc_id, " + ", ".join(
    f"CAST(len(regexp_extract_all(text, '{p}')) AS INTEGER) AS {n}" for n, p in PII_SQL) + " FROM documents"))
def q_pii_scan_documents(spark, sf_dir):
    """Personal-data pattern counts over every whole document text."""
    return gr.scan_text_pii(fact_table(spark, sf_dir, "documents"), "text", "doc_id")


# --- agreement over the evaluation cases -----------------------------------

_ORD_SQL = "CASE {x} WHEN 'auto_approve' THEN 0 WHEN 'escalate' THEN 1 WHEN 'auto_decline' THEN 2 ELSE 1 END"

_CASE_RES = _EVAL_CTE + ",\n" + REPORTS_CTE + f""",
cr AS (
  SELECT evs.*, rep.recommended_action, rep.priority_raw, rep.error,
         {_ORD_SQL.format(x='evs.expected_action')} AS expected,
         {_ORD_SQL.format(x='rep.recommended_action')} AS predicted,
         coalesce(TRY_CAST(rep.priority_raw AS INTEGER), 5) AS priority
  FROM evs LEFT JOIN rep ON evs.transaction_id = rep.txn_id)"""


def case_results(spark, sf_dir):
    """Each case with the report of its run, which carries the case's eval_id. The cases are drawn
    once and written; reports are formed from the transactions of the cases."""
    cases = written(eval_set(spark, sf_dir), "cases")
    of_case = cases.select("eval_id", F.col("transaction_id").alias("txn_id"))       # 30 cases
    runs = rp.build_reports(txn_of(spark, sf_dir, of_case)).join(F.broadcast(of_case), "txn_id")
    return ag.case_results(cases, runs)


@register("join_case_results", with_txn(_CASE_RES, body="""
SELECT eval_id, transaction_id, expected_action, recommended_action, error FROM cr"""))
def q_join_case_results(spark, sf_dir):
    """Evaluation cases left joined with the reports of their runs by eval_id."""
    return case_results(spark, sf_dir).select("eval_id", "transaction_id", "expected_action",
                                              "recommended_action", "error")


@register("action_ordinal", with_txn(_CASE_RES, body="SELECT eval_id, expected, predicted FROM cr"))
def q_action_ordinal(spark, sf_dir):
    """Actions as ordinals (approve 0, escalate 1, decline 2; unknown or absent -> 1)."""
    return case_results(spark, sf_dir).select("eval_id", "expected", "predicted")


_KAPPA_SQL = """
SELECT round(po, 6) AS observed_agreement, round(pe, 6) AS expected_agreement,
       round(CASE WHEN n = 0 THEN 0.0 WHEN pe = 1.0 THEN 1.0 ELSE (po - pe) / (1.0 - pe) END, 6) AS cohen_kappa,
       n AS n_cases
FROM (SELECT n, CAST(agree AS DOUBLE) / n AS po,
             (CAST(e0 AS DOUBLE) / n) * (CAST(p0 AS DOUBLE) / n) + (CAST(e1 AS DOUBLE) / n) * (CAST(p1 AS DOUBLE) / n)
             + (CAST(e2 AS DOUBLE) / n) * (CAST(p2 AS DOUBLE) / n) AS pe
      FROM (SELECT count(*) AS n, count(CASE WHEN expected = predicted THEN 1 END) AS agree,
                   count(CASE WHEN expected = 0 THEN 1 END) AS e0, count(CASE WHEN predicted = 0 THEN 1 END) AS p0,
                   count(CASE WHEN expected = 1 THEN 1 END) AS e1, count(CASE WHEN predicted = 1 THEN 1 END) AS p1,
                   count(CASE WHEN expected = 2 THEN 1 END) AS e2, count(CASE WHEN predicted = 2 THEN 1 END) AS p2
            FROM {src}))"""


@register("action_agreement", with_txn(_CASE_RES, body="""
SELECT round(avg(CASE WHEN expected = predicted THEN 1.0 ELSE 0.0 END)::DOUBLE, 3) AS exact_match_rate,
       count(*) AS n_cases FROM cr"""))
def q_action_agreement(spark, sf_dir):
    """Share of cases whose recommended action equals the expected action."""
    return ag.action_agreement(case_results(spark, sf_dir))


@register("cohen_kappa", with_txn(_CASE_RES, body=_KAPPA_SQL.format(src="cr")))
def q_cohen_kappa(spark, sf_dir):
    """Cohen's kappa between expected and recommended actions over three classes."""
    return ag.cohen_kappa(case_results(spark, sf_dir))


@register("action_confusion", with_txn(_CASE_RES, """grid(expected, predicted, expected_action, predicted_action) AS (
  VALUES """ + ", ".join(
    f"({e}, {p}, '{le}', '{lp}')" for e, le in enumerate(codes.ACTION_ORDINAL)
    for p, lp in enumerate(codes.ACTION_ORDINAL)) + ")", body="""
SELECT g.expected_action, g.predicted_action, coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN (SELECT expected, predicted, count(*) AS n FROM cr GROUP BY expected, predicted) c
  ON g.expected = c.expected AND g.predicted = c.predicted"""))
def q_action_confusion(spark, sf_dir):
    """Expected x recommended action counts, 3x3 with zeros."""
    return ag.action_confusion(spark, case_results(spark, sf_dir))


@register("priority_gap", with_txn(_CASE_RES, body="""
SELECT round(avg(CASE WHEN actual_fraud = 1 THEN priority::DOUBLE END), 2) AS mean_fraud_priority,
       round(avg(CASE WHEN actual_fraud <> 1 THEN priority::DOUBLE END), 2) AS mean_legit_priority,
       count(CASE WHEN actual_fraud = 1 THEN 1 END) AS n_fraud, count(CASE WHEN actual_fraud <> 1 THEN 1 END) AS n_legit,
       round(avg(CASE WHEN actual_fraud = 1 THEN priority::DOUBLE END)
             - avg(CASE WHEN actual_fraud <> 1 THEN priority::DOUBLE END), 2) AS priority_gap
FROM cr"""))
def q_priority_gap(spark, sf_dir):
    """Mean priority of fraud and legitimate cases (missing -> 5), counts and gap."""
    return ag.priority_gap(case_results(spark, sf_dir))


@register("adversarial_accuracy", with_txn(_CASE_RES, body="""
SELECT count(*) AS n_adversarial, count(CASE WHEN expected = predicted THEN 1 END) AS n_correct,
       round(CAST(count(CASE WHEN expected = predicted THEN 1 END) AS DOUBLE) / count(*), 3) AS accuracy
FROM cr WHERE adversarial"""))
def q_adversarial_accuracy(spark, sf_dir):
    """Correct actions among the adversarial cases."""
    return ag.adversarial_accuracy(case_results(spark, sf_dir))


# --- agreement over every report (expected = band action of the score) ------

_ALL_RES = REPORTS_CTE + f""",
ar AS (SELECT {_ORD_SQL.format(x="CASE WHEN score >= 0.70 THEN 'auto_decline' WHEN score >= 0.40 THEN 'escalate' ELSE 'auto_approve' END")} AS expected,
              {_ORD_SQL.format(x='recommended_action')} AS predicted FROM rep)"""


def all_results(spark, sf_dir):
    r = rp.reports(spark, sf_dir)
    return r.select(
        codes.action_ordinal(codes.risk_action(codes.risk_band(F.col("score")))).alias("expected"),
        codes.action_ordinal(F.col("recommended_action")).alias("predicted"))


@register("report_kappa_all", with_txn(_ALL_RES, body=_KAPPA_SQL.format(src="ar")))
def q_report_kappa_all(spark, sf_dir):
    """Cohen's kappa of every report's action against the score-band action."""
    return ag.cohen_kappa(all_results(spark, sf_dir))


_EXTRACT_SQL = r"""
WITH texts AS (
  SELECT 'conversations' AS source_table, concat_ws(':', conv_id, turn) AS id, text FROM conversations
  UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages
  UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), text FROM documents),
parts AS (SELECT source_table, id, regexp_extract(text, '```(?:json)?\s*(\{.*?\})\s*```', 1, 's') AS fenced,
    CASE WHEN instr(text, '{') > 0 THEN substr(text, instr(text, '{')) END AS rest FROM texts),
ends AS (SELECT *, CASE WHEN rest IS NOT NULL AND coalesce(fenced, '') = '' THEN
    list_reduce(regexp_extract_all(rest, '[\\"{}]|[^\\"{}]+'), lambda s, t: CASE WHEN s.e > 0 THEN s ELSE {
      'd': CAST(s.d + CASE WHEN s.x OR s.q THEN 0 WHEN t = '{' THEN 1 WHEN t = '}' THEN -1 ELSE 0 END AS INTEGER),
      'q': CASE WHEN NOT s.x AND t = '"' THEN NOT s.q ELSE s.q END,
      'x': NOT s.x AND s.q AND t = '\',
      'n': CAST(s.n + length(t) AS INTEGER),
      'e': CAST(CASE WHEN s.d + CASE WHEN s.x OR s.q THEN 0 WHEN t = '{' THEN 1 WHEN t = '}' THEN -1 ELSE 0 END = 0
                THEN s.n + length(t) ELSE 0 END AS INTEGER)} END,
      {'d': CAST(0 AS INTEGER), 'q': false, 'x': false, 'n': CAST(0 AS INTEGER), 'e': CAST(0 AS INTEGER)}).e END AS stop FROM parts),
found AS (SELECT source_table, id, CASE WHEN fenced <> '' THEN 'fence' WHEN stop > 0 THEN 'walk' END AS method,
    CASE WHEN fenced <> '' THEN fenced WHEN stop > 0 THEN substr(rest, 1, stop) END AS json_text FROM ends)
SELECT source_table, id, method, json_text, coalesce(json_valid(json_text), false) AS is_valid,
  CASE WHEN json_valid(json_text) THEN CAST(len(json_keys(json_text)) AS INTEGER) END AS n_keys FROM found"""


@register("extract_json", _EXTRACT_SQL)
def q_extract_json(spark, sf_dir):
    """First JSON object (fenced block, else balanced-brace walk) of every conversation
    turn, page and document text, whole texts; validity by parsing."""
    conv = fact_table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("source_table"), F.concat_ws(":", "conv_id", "turn").alias("id"),
        F.col("text"))
    pages = fact_table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("source_table"), F.col("page_id").cast("string").alias("id"), F.col("html").alias("text"))
    docs = fact_table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source_table"), F.col("doc_id").cast("string").alias("id"), F.col("text"))
    return extract_json_frame(conv.unionByName(pages).unionByName(docs), "text", ["source_table", "id"])
