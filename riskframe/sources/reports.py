"""Investigation reports: the table the report guardrails and agreement metrics run on.

No model-written reports ship with the test tables, so one report per txn row
is formed from that row's columns, with one defect class per ``txn_id % 10``
(0 errored run, 1 bad risk value, 2 priority out of range, 3 evidence item
without value, 4 short narrative, 5 no explanation-sourced evidence,
6 unlisted feature names in explanation evidence, 7 personal data in the
narrative, 8 decline without codes, 9 clean). This module only shapes rows;
every check lives in ``operators.guardrails``.

A missing key of the report is a NULL field; ``priority_raw`` keeps the JSON
text of the priority value so its type can be checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import codes
from riskframe.functions.features import tx_hour
from riskframe.sources.tables import txn

# explanation tool output: lower-cased names of the scorecard features
TOP_FEATURES = ["transactionamt_log", "dist1", "tx_hour", "tx_dayofweek", "card1"]
TOOLS = ["get_transaction_details", "get_shap_explanation", "get_customer_history", "get_reason_codes"]


def _s(c: Column) -> Column:
    return c.cast("string")


def build_reports(t: DataFrame, keep: list[str] | None = None) -> DataFrame:
    d = F.pmod(F.col("txn_id"), F.lit(10))
    err = d == 0
    band = codes.risk_band(F.col("score"))
    action = codes.risk_action(band)
    hour = F.floor(tx_hour()).cast("int")
    prio = (F.floor(F.col("score") * 9) + 1).cast("int")

    risk = F.when(err, None).when(d == 1, F.lit("critical")).otherwise(band)
    act = F.when(err, None).when(d == 8, F.lit("auto_decline")).otherwise(action)
    prio_raw = F.when(err, None).when(d == 2, F.lit("11")).otherwise(_s(prio))
    narrative = (F.when(err, None)
                  .when(d == 4, F.lit("Flagged."))
                  .when(d == 7, F.concat(F.lit("Transaction "), _s(F.col("txn_id")),
                                         F.lit(" reviewed. Contact jane.doe@example.com about card "
                                               "4111111111111111 before release.")))
                  .otherwise(F.concat(F.lit("Transaction "), _s(F.col("txn_id")), F.lit(" on card "),
                                      _s(F.col("card_id")), F.lit(" reviewed with priority "), _s(prio),
                                      F.lit(" in product "), F.col("product"), F.lit("."))))
    rc = (F.when(err, None)
           .when(d == 8, F.array().cast("array<string>"))
           .when(action == "auto_decline", F.array(F.lit("R01"), F.lit("R07")))
           .when(action == "escalate", F.array(F.lit("R07")))
           .otherwise(F.array().cast("array<string>")))
    ev_struct = "struct<claim:string,source:string,value:string>"
    shap_claim = (F.when(d == 6, F.lit("Driven by V258 and card3 values"))
                   .otherwise(F.concat(F.lit("Largest contribution from tx_hour at hour "), _s(hour))))
    shap_src = F.when(d == 5, F.lit("model_output")).otherwise(F.lit("shap_explanation"))
    ev1 = F.struct(shap_claim.alias("claim"), shap_src.alias("source"), _s(F.col("card_id")).alias("value"))
    ev2 = F.struct(F.concat(F.lit("Card "), _s(F.col("card_id")), F.lit(" history")).alias("claim"),
                   F.lit("customer_history").alias("source"),
                   F.when(d == 3, F.lit(None).cast("string")).otherwise(_s(F.col("k"))).alias("value"))
    evidence = F.when(err, F.lit(None).cast(f"array<{ev_struct}>")).otherwise(F.array(ev1, ev2))
    top = F.when(err, F.lit(None).cast("array<string>")).otherwise(F.array(*[F.lit(x) for x in TOP_FEATURES]))
    log_entry = "struct<iteration:int,tool:string,output:string>"
    details_out = F.concat(F.lit('{"transaction_id": '), _s(F.col("txn_id")), F.lit("}"))
    shap_out = F.concat(F.lit('{"transaction_id": '), _s(F.col("txn_id")), F.lit(', "n_features": 5}'))
    hist_out = F.concat(F.lit('{"card_id": '), _s(F.col("card_id")), F.lit("}"))
    codes_out = F.concat(F.lit('{"transaction_id": '), _s(F.col("txn_id")), F.lit(', "n_codes": '),
                         _s(F.when(action == "auto_decline", 2).when(action == "escalate", 1).otherwise(0)),
                         F.lit("}"))
    full_log = F.array(*[F.struct(F.lit(i + 1).alias("iteration"), F.lit(tool).alias("tool"), out.alias("output"))
                         for i, (tool, out) in enumerate(zip(TOOLS, [details_out, shap_out, hist_out, codes_out]))])
    log = F.when(err, F.array(F.struct(F.lit(1).alias("iteration"), F.lit(TOOLS[0]).alias("tool"),
                                       details_out.alias("output")))).otherwise(full_log).cast(f"array<{log_entry}>")
    return t.select(
        F.col("txn_id"),
        F.when(err, F.lit("run stopped: iteration limit")).otherwise(F.lit(None).cast("string")).alias("error"),
        risk.alias("risk_assessment"), act.alias("recommended_action"), prio_raw.alias("priority_raw"),
        narrative.alias("sar_narrative"), rc.alias("reason_codes"), evidence.alias("evidence"),
        top.alias("top_features"), log.alias("tool_log"),
        F.col("score"), F.col("is_fraud"), *(keep or []))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_reports(txn(spark, sf_dir))
