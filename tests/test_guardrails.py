"""One row per guardrail rule: each defect class fails the intended check."""

from pyspark.sql import functions as F

from riskframe.operators import guardrails as gr
from riskframe.sources import reports as rp

from conftest import SF0001


def _by_defect(spark):
    g = gr.guard_all(rp.reports(spark, SF0001)).withColumn("d", F.pmod("txn_id", F.lit(10)))
    return {r["d"]: r for r in g.groupBy("d").agg(
        F.min(F.col("schema_passed").cast("int")).alias("schema"),
        F.min(F.col("grounding_passed").cast("int")).alias("grounding"),
        F.min(F.col("pii_passed").cast("int")).alias("pii"),
        F.min(F.col("action_passed").cast("int")).alias("action"),
        F.max(F.col("all_passed").cast("int")).alias("any_all"),
        F.max("n_hallucinated").alias("halluc")).collect()}


def test_rule_table(spark):
    d = _by_defect(spark)
    assert d[0]["schema"] == 0 and d[0]["grounding"] == 0 and d[0]["any_all"] == 0   # errored run
    assert d[1]["schema"] == 0                       # risk value outside the enumeration
    assert d[2]["schema"] == 0                       # priority 11
    assert d[3]["schema"] == 0                       # evidence item without value
    assert d[4]["schema"] == 0                       # short narrative
    assert d[5]["grounding"] == 0                    # no explanation-sourced evidence
    assert d[6]["grounding"] == 0 and d[6]["halluc"] == 2
    assert d[7]["pii"] == 0                          # email and card number
    assert d[8]["action"] == 0                       # decline without codes
    assert d[9]["any_all"] == 1 and d[9]["schema"] == 1 and d[9]["grounding"] == 1


def test_pii_patterns(spark):
    rows = [(1, "card 4111111111111111 here"), (2, "ssn 123-45-6789"), (3, "code 123 cvv"),
            (4, "mail a.b@example.org"), (5, "acct 123456789"), (6, "nothing 12 here"),
            (7, "pi 5.778888888888889")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = {r["id"]: r for r in gr.scan_text_pii(df, "text", "id").collect()}
    assert out[1]["card_number"] == 1
    assert out[2]["ssn"] == 1
    assert out[3]["cvv"] == 1
    assert out[4]["email"] == 1
    assert out[5]["account_number"] == 1 and out[5]["ssn"] == 1
    assert sum(out[6][k] for k in ("card_number", "ssn", "cvv", "email", "account_number")) == 0
    assert out[7]["card_number"] == 1                # decimals hit the card pattern (kept as is)


def walked(text):
    """The balanced object character by character."""
    start = -1 if text is None else text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if escaped:
            escaped = False
        elif quoted and c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start:i + 1]
    return None


def test_balanced_object_walk(spark):
    import random

    from pyspark.sql import functions as F

    from riskframe.operators.extract import balanced_object
    r = random.Random(4)
    texts = ['x {"a": "}{", "b": {"c": 1}} y', '{"a": "\\"}"} tail', "no braces", "{unclosed", None, "", "}{}", '{"é😀": 1} x', '\\"{ "a"}',
             '{"a\\\\"}"} {}', "{" * 300 + "}" * 300, '{"' + "\\n" * 20000 + '"}']
    texts += ["".join(r.choice('{}"\\ax\n') for _ in range(r.randrange(30))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.o for x in rows.select("i", balanced_object(F.col("t")).alias("o")).collect()}
    assert [got[i] for i in range(len(texts))] == [walked(t) for t in texts]


def test_extract_json_prefers_fence(spark):
    from riskframe.operators.extract import extract_json_frame
    rows = [(1, 'prose {"x": 1} ```json\n{"a": {"b": 2}}\n``` more'), (2, 'pre {"k": "v}"} post'),
            (3, "nothing here"), (4, "{bad json}")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = {r["id"]: r for r in extract_json_frame(df, "text", ["id"]).collect()}
    assert out[1]["method"] == "fence" and out[1]["json_text"] == '{"a": {"b": 2}}' and out[1]["is_valid"]
    assert out[2]["method"] == "walk" and out[2]["json_text"] == '{"k": "v}"}' and out[2]["n_keys"] == 1
    assert out[3]["method"] is None and not out[3]["is_valid"]
    assert out[4]["method"] == "walk" and not out[4]["is_valid"]


def test_findings_explain_the_flags(spark):
    from riskframe.sources import reports as rp
    g = gr.findings(gr.guard_all(rp.reports(spark, SF0001))).collect()
    strict = {r["txn_id"]: r["all_passed"] for r in gr.guard_all(rp.reports(spark, SF0001), strict=True).collect()}
    assert len(g) > 0 and any(r["schema_issues_found"] for r in g) and any(r["pii_types"] for r in g)
    for r in g:
        assert r["schema_passed"] == (not r["schema_issues_found"])
        assert r["pii_passed"] == (not r["pii_types"]) and len(r["pii_types"]) == r["pii_types_found"]
        assert r["action_passed"] == (not r["violations"]) and len(r["warnings"]) == r["action_warnings"]
        if r["top_features"]:
            assert len(r["cited_features"]) == r["n_cited"]
            assert bool(r["invented_features"]) == (r["n_hallucinated"] > 0)
        assert strict[r["txn_id"]] == (r["all_passed"] and not r["warnings"])
