"""Streaming queries (survey 2.16). Their SQL is the batch result on the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import drift as dr
from riskframe.plans.catalog import register
from riskframe.plans.oracle import with_txn
from riskframe.plans.q_drift import SPLITF_CTE, _psi_ctes, splits
from riskframe.plans.q_guard import GUARD_CTE
from riskframe.streaming import monitors as mon


def reference_edges(spark, sf_dir) -> list[float]:
    """Score edges stored from the training split (deciles, de-duplicated)."""
    tr, _ = splits(spark, sf_dir)
    row = dr.reference_edges(dr.to_long(tr, ["score"])).first()
    return [float(e) for e in row["edges"]] if row else []


# 7-day windows are aligned to the epoch
_WINDOW = "CAST((dt + 1704067200) // 604800 * 604800 AS BIGINT)"
_BINS_CTE = f"""wbins AS (SELECT {_WINDOW} AS window_start, CAST(len(list_filter(e, lambda x: x <= score)) AS INTEGER) AS bin,
                 count(*) AS n FROM sf CROSS JOIN edges WHERE score IS NOT NULL GROUP BY ALL)"""


@register("stream_score_bins", with_txn(SPLITF_CTE, _psi_ctes(["score"]), _BINS_CTE, body="""
SELECT window_start, bin, n FROM wbins"""))
def q_stream_score_bins(spark, sf_dir):
    """Streamed events: score counts per (7-day window, reference bin) with a watermark."""
    return mon.score_bins_stream(spark, sf_dir, reference_edges(spark, sf_dir))


@register("stream_window_psi", with_txn(SPLITF_CTE, _psi_ctes(["score"]), _BINS_CTE, body="""
SELECT window_start, round(sum((cp - rp) * ln(cp / rp)), 5) AS psi, CAST(any_value(total) AS BIGINT) AS n_rows
FROM (SELECT w.window_start, w.total, (coalesce(b.n, 0) + 1e-4) / (w.total + 1e-4 * f.n_bins) AS cp,
             (f.rc + 1e-4) / (t.n_ref + 1e-4 * f.n_bins) AS rp
      FROM (SELECT window_start, sum(n) AS total FROM wbins GROUP BY window_start) w
      CROSS JOIN fullb f CROSS JOIN tot t LEFT JOIN wbins b ON b.window_start = w.window_start AND b.bin = f.bin)
GROUP BY window_start"""))
def q_stream_window_psi(spark, sf_dir):
    """PSI of each streamed 7-day window against the training split, from the bin table."""
    edges = reference_edges(spark, sf_dir)
    bins = mon.score_bins_stream(spark, sf_dir, edges)
    tr, _ = splits(spark, sf_dir)
    arr = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<double>")
    ref = (tr.filter(F.col("score").isNotNull())
             .select(F.size(F.filter(arr, lambda e: e <= F.col("score"))).alias("bin"))
             .groupBy("bin").agg(F.count(F.lit(1)).alias("ref_n")))
    return mon.psi_from_bins(bins, ref, len(edges) + 1)


@register("stream_guard_rates", with_txn(GUARD_CTE, body=f"""
SELECT {_WINDOW} AS window_start, count(*) AS n_reports, CAST(count_if(all_passed) AS BIGINT) AS n_all_passed,
       CAST(count_if(schema_passed) AS BIGINT) AS n_schema_passed, CAST(count_if(grounding_passed) AS BIGINT) AS n_grounding_passed,
       CAST(count_if(pii_passed) AS BIGINT) AS n_pii_passed, CAST(count_if(action_passed) AS BIGINT) AS n_action_passed
FROM ga JOIN (SELECT txn_id AS _t, dt FROM txn) d ON ga.txn_id = d._t GROUP BY 1"""))
def q_stream_guard_rates(spark, sf_dir):
    """Streamed reports: weekly guardrail pass counts with a watermark."""
    return mon.guard_rates_stream(spark, sf_dir)

