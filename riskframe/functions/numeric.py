"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(col: Column | str, digits: int = 0) -> Column:
    """Round half away from zero on the binary value: round(x * 10^d) / 10^d.

    ``F.round`` on a double rounds its shortest decimal string, so a ratio such
    as 201/3200 (= 0.0628125 in decimal, slightly less in binary) rounds up
    there and down in most SQL engines. Scaling first keeps both the same.
    """
    c = F.col(col) if isinstance(col, str) else col
    scale = F.lit(float(10 ** digits))
    return F.round(c.cast("double") * scale, 0) / scale



SCALE = 14              # decimals of an input that count
LARGEST = 9e21          # above this a double's own step is far wider than any rounding asked for


def mean_half_up(col: str, digits: int) -> Column:
    """Aggregate: mean of ``col`` rounded half away from zero to ``digits``.

    Inputs are taken to 14 decimals and summed exactly as decimals, so the result
    does not depend on partitioning or on the order of summation (a double sum can
    land on either side of a decimal tie such as 2866.88 / 64 = 44.795). The quotient
    is taken as a decimal without its remainder, so it neither wraps nor rounds twice.
    Where count times the largest magnitude passes LARGEST the plain double mean is
    returned: nothing is left to round there."""
    return _half_up(exact_sum_sql(col), f"count(`{col}`)", f"max(abs(`{col}`))", f"avg(`{col}`)", digits)


def exact_sum_sql(col: str) -> str:
    """Aggregate: exact decimal sum of a double column taken to 14 decimals."""
    return f"try_sum(try_cast(`{col}` as decimal(38,{SCALE})))"


def mean_half_up_of_parts(total: str, count: str, largest: str, plain: str, digits: int) -> Column:
    """``mean_half_up`` from columns of partial results: exact sums, counts, largest magnitudes
    and double sums."""
    return _half_up(f"try_sum(`{total}`)", f"sum(`{count}`)", f"max(`{largest}`)", f"(sum(`{plain}`) / sum(`{count}`))", digits)


def _half_up(total: str, count: str, largest: str, plain: str, digits: int) -> Column:
    s = f"cast({total} as decimal(36,{SCALE}))"
    n = f"cast({count} as decimal(19,0))"
    unit = f"cast({10 ** -digits:.{digits}f} as decimal({digits + 1},{digits}))"
    step = f"cast({n} * {unit} as decimal(36,{SCALE}))"
    twice = f"cast({step} + {step} as decimal(36,{SCALE}))"
    top = f"cast(abs({s}) + abs({s}) as decimal(36,{SCALE})) + {step}"
    whole = f"cast(cast({top} - cast({top} as decimal(37,{SCALE})) % {twice} as decimal(36,{SCALE})) / {twice} as double)"
    return F.expr(
        f"case when {count} = 0 then cast(null as double) "
        f"when {largest} * {count} >= {LARGEST}D then {plain} "
        f"else sign({s}) * {whole} / {float(10 ** digits)}D end")


def nan_to_null(col: Column | str) -> Column:
    """NaN becomes NULL, so that NULL is the only missing marker (Spark orders
    NaN above every number, which would distort ranks and quantiles)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
