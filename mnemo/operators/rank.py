"""Rank filters, gates, composite scores and the qualification rule."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def global_rank(rows: DataFrame, order: Sequence[str | Column], out: str = "rank") -> DataFrame:
    """rows with their 1-based place in a total order, without bringing them into one task."""
    return ordered.places(rows, [], order, out).withColumn(out, F.col(out) + 1)


def rank_filter(rows: DataFrame, value: str, position: str, share: float = 0.8, by: Sequence[str] = ()) -> DataFrame:
    """Drop the top floor((1 - share) * n) rows by value, of ties the later positions first; with `by`, in each group.

    Rows without a finite value are left out before. `threshold` is the linear quantile and only reported: it lies between
    two places of the order. No group is brought into one task.
    """
    usable = rows.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < 1e300))
    ranked = ordered.places(usable, by, [value, position], "_place", "_n")
    kept = F.col("_n") - F.floor(F.round((1 - share) * F.col("_n"), 9))
    ranked = ranked.withColumn("_at", share * (F.col("_n") - 1))
    low, part = F.floor("_at"), F.col("_at") - F.floor("_at")
    ends = ranked.filter((F.col("_place") == low) | (F.col("_place") == F.ceil("_at"))).groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.first(part).alias("_within"))
    threshold = ends.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_within")).alias("threshold"))
    return ordered.match(ranked.filter(F.col("_place") < kept), threshold, by).drop("_place", "_n", "_at")


def gates(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """rows with `failed`, the names of the gates that do not hold, in order, and `passes`."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules]))
    return rows.withColumn("failed", failed).withColumn("passes", F.size("failed") == 0)


def composite_top(rows: DataFrame, factors: Sequence[str], key: str, n: int = 3) -> DataFrame:
    """The product of factors where the gates pass, else 0; and the place among those that pass, for the first n."""
    product = reduce(lambda a, b: a * b, [F.col(f) for f in factors])
    scored = rows.withColumn("composite", F.when(F.col("passes"), product).otherwise(0.0))
    best = scored.filter("passes").orderBy(F.col("composite").desc(), key).limit(n).select(key, F.row_number().over(Window.orderBy(F.col("composite").desc(), key)).alias("place"))
    return scored.join(F.broadcast(best), key, "left")


def qualify(rows: DataFrame, checks: Sequence[tuple[str, Column]], tested: Column) -> DataFrame:
    """rows with status and detail of three-valued checks.

    Nothing tested: 'not_tested'. Else the first check that fails: 'not_qualified'; the first unknown: 'not_tested'.
    """
    failing = F.coalesce(*[F.when(~c, F.lit(name)) for name, c in checks])
    unknown = F.coalesce(*[F.when(c.isNull(), F.lit(name)) for name, c in checks])
    status = F.when(~tested, "not_tested").when(failing.isNotNull(), "not_qualified").when(unknown.isNotNull(), "not_tested").otherwise("qualified")
    return rows.withColumns({"status": status, "detail": F.when(~tested, "no quality record").otherwise(F.coalesce(failing, unknown, F.lit("")))})
