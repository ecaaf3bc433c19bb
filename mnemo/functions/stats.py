"""Column expressions for proportions, locations and lattices."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_value(confidence: float = 0.95, tail: str = "two") -> float:
    """The normal quantile of a one- or two-sided confidence."""
    if not 0.0 < confidence < 1.0 or tail not in ("one", "two"):
        raise ValueError("confidence lies between 0 and 1; tail is 'one' or 'two'")
    return NormalDist().inv_cdf(confidence if tail == "one" else 0.5 + confidence / 2)


def wilson(k: Column, n: Column, confidence: float = 0.95, tail: str = "two", continuity: bool = False) -> tuple[Column, Column]:
    """Lower and upper bound of the score interval of k in n; null where n is 0."""
    z = z_value(confidence, tail)
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    if continuity:
        inner_lo = F.greatest(F.lit(0.0), F.lit(z * z) - F.lit(1.0) / n + 4 * n * p * (1 - p) + (4 * p - 2))
        inner_hi = F.greatest(F.lit(0.0), F.lit(z * z) - F.lit(1.0) / n + 4 * n * p * (1 - p) - (4 * p - 2))
        below = (2 * n * p + z * z - (z * F.sqrt(inner_lo) + 1)) / (2 * (n + z * z))
        above = (2 * n * p + z * z + (z * F.sqrt(inner_hi) + 1)) / (2 * (n + z * z))
        below, above = F.when(k == 0, 0.0).otherwise(below), F.when(k == n, 1.0).otherwise(above)
    else:
        centre = p + z * z / (2 * n)
        half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        below, above = (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), below)), F.when(n > 0, F.least(F.lit(1.0), above))


def lower_median(values: Column) -> Column:
    """The middle of an array, of two middles the lower; null for an empty one."""
    return F.when(F.size(values) > 0, F.get(F.sort_array(values), F.floor((F.size(values) - 1) / 2).cast("int")))


def snap(value: Column, grid: str) -> Column:
    """The nearest multiple of a decimal grid, halves away from zero, computed on decimals."""
    places = len(grid.partition(".")[2])
    exact = F.abs(value).cast("decimal(30,12)")
    steps = F.round(exact / F.lit(grid).cast("decimal(18,9)"), 0)
    return (F.signum(value) * F.round((steps * F.lit(grid).cast("decimal(18,9)")).cast("double"), places)) + 0.0


def on_grid(value: Column, grid: str, tolerance: float = 1e-9) -> Column:
    """Whether a value is on the lattice; a value that is no finite number is not."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < 1e300) & (F.abs(value - snap(value, grid)) <= tolerance), F.lit(False))


def brier(p: Column, outcome: Column) -> Column:
    return F.pow(p - outcome, F.lit(2.0))


def log_loss(p: Column, outcome: Column, clip: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1.0 - clip))
    return -F.log(F.when(outcome == 1, q).otherwise(1.0 - q))


def quantiles(value: Column, at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> Column:
    """Linear quantiles of a group, as an array."""
    return F.percentile(value, F.array(*[F.lit(a) for a in at]))
