"""Structured Streaming monitors.

* ``score_bins_stream``: counts per (7-day window, reference bin) of the score,
  binned against reference edges fixed in advance (from the training split),
  so the streaming state is at most windows x bins rows. PSI for a window is
  a batch read of that table (``psi_from_bins``).
* ``guard_rates_stream``: weekly guardrail pass rates of streamed reports.

Both use event-time watermarks and update output mode; an event that arrives twice inside the
watermark counts once. The sink is a table by window in the shared checkpoint folder
(``window_upsert``): a micro-batch rewrites only the windows it touches, a replayed batch rewrites
the same version, and files of other windows stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskframe.functions.numeric import rnd
from riskframe.operators import guardrails as gr
from riskframe.session import ensure_checkpoint_dir
from riskframe.sources import reports as rp
from riskframe.sources.tables import identity_side, table, txn_from_events

EPSILON = 1e-4


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table (one file or a directory of part files) as a file stream. A file
    stream's path has to be a directory: a single file is picked by name from its folder."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files_per_trigger)
    first = events.select("_metadata.file_path").first()
    if first and first[0].rsplit("/", 1)[-1] == "events.parquet":
        return stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def txn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn_from_events(events_stream(spark, sf_dir), identity_side(spark, sf_dir), event_time=True)


def window_upsert(base: str, schema: StructType, keys: Sequence[str], window: str = "window_start"):
    """foreachBatch writer of a table kept by window: only the windows a batch touches are written
    again (their rows without the updated keys, and the batch's), under data/v=<epoch>. A manifest
    per epoch says which version holds each window; it is written last, so a reader sees a batch
    whole or not at all, and a replayed batch starts from the manifest before its own."""
    keys = list(keys)

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        touched = [r[0] for r in batch.select(window).distinct().collect()]      # windows still open
        if touched:
            held = _manifest(spark, base, epoch_id)
            rows, old = batch, {w: held[w] for w in touched if w in held}
            if old:
                rows = _windows(spark, base, schema, old, window).join(batch.select(*keys), keys, "left_anti").unionByName(batch)
            rows.select(*schema.names).write.mode("overwrite").partitionBy(window).parquet(f"{base}/data/v={epoch_id:010d}")
            now = sorted((held | {w: epoch_id for w in touched}).items())
            spark.createDataFrame(now, f"{window} long, version long").coalesce(1).write.mode("overwrite").parquet(
                f"{base}/manifest/epoch={epoch_id:010d}")
        batch.unpersist()
    return write


def _manifest(spark: SparkSession, base: str, before: int | None = None) -> dict[int, int]:
    """Window -> version by the newest manifest (of an epoch below ``before``)."""
    try:
        rows = spark.read.parquet(f"{base}/manifest")
    except AnalysisException as e:                  # nothing written yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return {}
    if before is not None:
        rows = rows.filter(F.col("epoch") < before)
    newest = rows.agg(F.max("epoch")).first()[0]
    return {r[0]: r[1] for r in rows.filter(F.col("epoch") == newest).drop("epoch").collect()} if newest is not None else {}


def _windows(spark: SparkSession, base: str, schema: StructType, versions: dict[int, int], window: str) -> DataFrame:
    paths = [f"{base}/data/v={v:010d}/{window}={w}" for w, v in versions.items()]
    return spark.read.schema(schema).option("basePath", f"{base}/data").parquet(*paths).select(*schema.names)


def latest_snapshot(spark: SparkSession, base: str, schema: StructType, window: str = "window_start") -> DataFrame:
    """Every window by its newest version."""
    held = _manifest(spark, base)
    return _windows(spark, base, schema, held, window) if held else spark.createDataFrame([], schema)


def _run(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/streams/{name}-{uuid.uuid4().hex[:10]}"
    q = (df.writeStream.outputMode("update")
         .option("checkpointLocation", root + "/_checkpoint")
         .foreachBatch(window_upsert(root + "/table", df.schema, keys))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_snapshot(spark, root + "/table", df.schema)


def _once(txn: DataFrame, watermark: str, id_col: str = "txn_id") -> DataFrame:
    """A stream with its watermark, each event once; a batch frame as it is."""
    if not txn.isStreaming:
        return txn
    return txn.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark([id_col])


def score_bins(txn: DataFrame, edges: Sequence[float], window: str = "7 days",
               watermark: str = "30 days") -> DataFrame:
    """(window_start, bin, n): the streaming aggregation (works on batch frames too)."""
    arr = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    binned = _once(txn.filter(F.col("score").isNotNull()), watermark).select(
        "event_time", F.size(F.filter(arr, lambda e: e <= F.col("score"))).alias("bin"))
    agg = binned.groupBy(F.window("event_time", window).alias("w"), "bin").agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.unix_seconds(F.col("w.start")).alias("window_start"), "bin", "n")


def score_bins_stream(spark: SparkSession, sf_dir: str, edges: Sequence[float],
                      window: str = "7 days") -> DataFrame:
    return _run(score_bins(txn_stream(spark, sf_dir), edges, window), ["window_start", "bin"], "score-bins")


def psi_from_bins(bins: DataFrame, ref_counts: DataFrame, n_bins: int) -> DataFrame:
    """PSI per window from streamed bin counts and the reference bin counts (bin, ref_n)."""
    all_bins = bins.select("window_start").distinct().select(
        "window_start", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    full = (all_bins.join(bins, ["window_start", "bin"], "left").join(F.broadcast(ref_counts), "bin", "left")
                   .fillna(0, subset=["n", "ref_n"]))
    tot = full.groupBy("window_start").agg(F.sum("n").alias("cur_total"), F.sum("ref_n").alias("ref_total"))
    j = full.join(tot, "window_start")
    cp = (F.col("n") + EPSILON) / (F.col("cur_total") + EPSILON * n_bins)
    rp_ = (F.col("ref_n") + EPSILON) / (F.col("ref_total") + EPSILON * n_bins)
    return j.groupBy("window_start", "cur_total").agg(
        rnd(F.sum((cp - rp_) * F.log(cp / rp_)), 5).alias("psi")).select(
        "window_start", "psi", F.col("cur_total").cast("long").alias("n_rows"))


def guard_rates(txn: DataFrame, window: str = "7 days", watermark: str = "30 days") -> DataFrame:
    """(window_start, reports, passing counts per check): weekly pass rates."""
    g = gr.guard_all(rp.build_reports(_once(txn, watermark), keep=["event_time"]))
    agg = g.groupBy(F.window("event_time", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n_reports"),
        F.sum(F.col("all_passed").cast("long")).alias("n_all_passed"),
        F.sum(F.col("schema_passed").cast("long")).alias("n_schema_passed"),
        F.sum(F.col("grounding_passed").cast("long")).alias("n_grounding_passed"),
        F.sum(F.col("pii_passed").cast("long")).alias("n_pii_passed"),
        F.sum(F.col("action_passed").cast("long")).alias("n_action_passed"))
    return agg.select(F.unix_seconds(F.col("w.start")).alias("window_start"), "n_reports", "n_all_passed",
                      "n_schema_passed", "n_grounding_passed", "n_pii_passed", "n_action_passed")


def guard_rates_stream(spark: SparkSession, sf_dir: str, window: str = "7 days") -> DataFrame:
    return _run(guard_rates(txn_stream(spark, sf_dir), window), ["window_start"], "guard-rates")
