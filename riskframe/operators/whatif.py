"""Directional what-if re-scoring over a grid of edits.

Every row is paired with each edit scenario by exploding a literal array of
scenarios (no join), so the work is rows x scenarios, map-only.
Rules: amount up > 20 % adds min(.05, change * .03); down > 20 % subtracts
min(.03, |change| * .02); an edited hour < 6 adds .03, > 18 adds .02, else
subtracts .01; the result is clamped to [0, 1]. Other edits have no effect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.codes import risk_band

# Fixed values of the re-scoring rule.
AMOUNT_UP, AMOUNT_DOWN = 0.2, -0.2            # relative change that counts
UP_CAP, UP_RATE = 0.05, 0.03                  # amount up: + min(cap, change * rate)
DOWN_CAP, DOWN_RATE = 0.03, 0.02              # amount down: - min(cap, |change| * rate)
NIGHT_BEFORE, EVENING_AFTER = 6, 18           # edited hour bands
NIGHT_ADD, EVENING_ADD, DAY_ADD = 0.03, 0.02, -0.01

# The edit grid (our choice): amount factors x edited hours, None = not edited.
AMOUNT_FACTORS = [None, 0.5, 1.5, 3.0]
HOURS = [None, 2, 12, 21]


def scenario_grid() -> list[tuple[int, float | None, int | None]]:
    return [(i * len(HOURS) + j, f, h) for i, f in enumerate(AMOUNT_FACTORS) for j, h in enumerate(HOURS)]


def what_if_grid(details: DataFrame, grid: Sequence[tuple] | None = None, id_col: str = "txn_id",
                 score: str = "fraud_score", amt: str = "amt") -> DataFrame:
    """id, scenario_id, new_score, band_flip for every row and scenario."""
    grid = list(grid or scenario_grid())
    arr = F.array(*[F.struct(F.lit(s).alias("sid"), F.lit(f).cast("double").alias("factor"),
                             F.lit(h).cast("int").alias("hour")) for s, f, h in grid])
    x = details.select(id_col, score, amt, F.explode(arr).alias("sc"))
    orig, a = F.col(score), F.col(amt)
    new_amt = a * F.col("sc.factor")
    pct = F.when(a > 0, (new_amt - a) / a).otherwise(F.lit(0.0))
    d_amt = (F.when(F.col("sc.factor").isNull(), F.lit(0.0))
              .when(pct > AMOUNT_UP, F.least(F.lit(UP_CAP), pct * UP_RATE))
              .when(pct < AMOUNT_DOWN, -F.least(F.lit(DOWN_CAP), F.abs(pct) * DOWN_RATE))
              .otherwise(F.lit(0.0)))
    h = F.col("sc.hour")
    d_hour = (F.when(h.isNull(), F.lit(0.0)).when(h < NIGHT_BEFORE, F.lit(NIGHT_ADD))
               .when(h > EVENING_AFTER, F.lit(EVENING_ADD)).otherwise(F.lit(DAY_ADD)))
    new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), orig + (d_amt + d_hour)))
    return x.select(id_col, F.col("sc.sid").alias("scenario_id"), new.alias("new_score"),
                    (risk_band(new) != risk_band(orig)).alias("band_flip"))
