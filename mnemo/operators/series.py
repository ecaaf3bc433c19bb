"""Ordered series: directions, month ends, as-of joins, trailing statistics, windows, weights and equity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_index(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day) - 1).cast("long")


def direction_labels(closes: DataFrame, key: Sequence[str], day: str, close: str) -> DataFrame:
    """Each close with the one before it and the sign of the change; a series' first close is left out."""
    before = F.lag(close).over(Window.partitionBy(*key).orderBy(day))
    return closes.withColumn("previous", before).filter("previous IS NOT NULL").withColumn("direction", F.signum(F.col(close) - F.col("previous")).cast("int"))


def month_end(rows: DataFrame, key: Sequence[str], day: str, value: str) -> DataFrame:
    """The last value of each month."""
    return rows.groupBy(*key, month_index(F.col(day)).alias("month")).agg(F.max_by(value, day).alias("value"), F.max(day).alias("day"))


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], left_day: str, right_day: str, value: str, max_days: int | None = None) -> DataFrame:
    """Each row of left with the latest value of right on or before its day, by one sort of both sides together.

    left and right are united and the last value is carried forward, so that no row of a side meets more than one row of
    the other. A value more than max_days old is null.
    """
    names = left.columns
    a = left.select(*names, F.col(left_day).alias("_day"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[right_day].dataType).alias("as_of_day"), F.lit(None).cast(right.schema[value].dataType).alias("as_of_value"))
    filler = [F.col(k) if k in key else F.lit(None).cast(left.schema[k].dataType).alias(k) for k in names]
    b = right.groupBy(*key, right_day).agg(F.max(value).alias("as_of_value")).select(*filler, F.col(right_day).alias("_day"), F.lit(0).alias("_side"), F.col(right_day).alias("as_of_day"), "as_of_value")
    carried = Window.partitionBy(*key).orderBy("_day", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    last = F.last(F.when(F.col("_side") == 0, F.struct("as_of_day", "as_of_value")), ignorenulls=True).over(carried)
    found = both.withColumn("_last", last).filter("_side = 1")
    fresh = F.lit(True) if max_days is None else F.datediff(F.col("_day"), F.col("_last.as_of_day")) <= max_days
    return found.select(*names, F.when(fresh, F.col("_last.as_of_day")).alias("as_of_day"), F.when(fresh, F.col("_last.as_of_value")).alias("as_of_value"))


def bitemporal_as_of(observations: DataFrame, series: Sequence[str], day: str, start: str, end: str, moment: Column) -> DataFrame:
    """The observations as they were known at a moment: start <= moment <= end, and dated on or before it."""
    return observations.filter((F.col(start) <= moment) & (F.coalesce(F.col(end), moment) >= moment) & (F.col(day) <= moment)).withColumn("as_of", moment)


def year_on_year(monthly: DataFrame, key: Sequence[str]) -> DataFrame:
    """Growth over the same month of the year before, by calendar and not by row; a missing base month is a reason."""
    base = monthly.select(*key, (F.col("month") + 12).alias("month"), F.col("value").alias("base"))
    out = monthly.join(base, [*key, "month"], "left")
    usable = F.col("base").isNotNull() & (F.col("base") != 0)
    return out.select(*key, "month", "value", F.when(usable, F.col("value") / F.col("base") - 1).alias("yoy"), F.when(usable, None).otherwise(F.lit("no base month")).alias("missing"))


def trailing_z(monthly: DataFrame, key: Sequence[str], months: int = 60, least: int = 30) -> DataFrame:
    """z of the current value within the trailing calendar months (itself included), sample spread."""
    frame = Window.partitionBy(*key).orderBy("month").rangeBetween(-(months - 1), 0)
    mean, sd, n = F.avg("value").over(frame), F.stddev_samp("value").over(frame), F.count("value").over(frame)
    return monthly.select(*key, "month", "value", n.alias("n"), F.when((n >= least) & (sd > 0), (F.col("value") - mean) / sd).alias("z"))


def trailing_windows(rows: DataFrame, key: Sequence[str], session: str, value: str, length: int = 20) -> DataFrame:
    """Windows of the last `length` observations; one that skips a session is left out."""
    order = Window.partitionBy(*key).orderBy(session)
    frame = order.rowsBetween(-(length - 1), 0)
    out = rows.withColumns({"n": F.count(value).over(frame), "first_session": F.min(session).over(frame), "_ratio": F.log(F.try_divide(F.col(value), F.lag(value).over(order)))})
    inner = order.rowsBetween(-(length - 2), 0)
    out = out.withColumns({"volatility": F.stddev_samp("_ratio").over(inner), "first_value": F.first(value).over(frame)})
    whole = (F.col("n") == length) & (F.col(session) - F.col("first_session") == length - 1)
    return out.filter(whole).select(*key, session, value, "first_session", "volatility", (F.col(value) / F.col("first_value") * 100).alias("rebased"))


def exclusion_reason(rows: DataFrame, rules: Sequence[tuple[str, Column]], out: str = "reason") -> DataFrame:
    """The first rule that excludes a row, in order; null for a row that stays."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(list(rules)):
        reason = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return rows.withColumn(out, reason)


def target_weights(signals: DataFrame, day: str, ticker: str, direction: str, confidence: str, position: str) -> DataFrame:
    """weight = direction * confidence; the last record of a day and ticker wins; a day's weights are scaled to 1 at most."""
    last = signals.groupBy(day, ticker).agg(F.max_by(F.col(direction) * F.col(confidence), F.col(position)).alias("raw"))
    gross = F.sum(F.abs(F.col("raw"))).over(Window.partitionBy(day))
    return last.select(day, ticker, (F.col("raw") / F.greatest(gross, F.lit(1.0))).alias("weight"), F.greatest(F.lit(0.0), 1.0 - gross).alias("cash"))


def equity_curve(returns: DataFrame, key: Sequence[str], day: str, value: str) -> DataFrame:
    """Running product of 1 + return, its running peak and the drawdown."""
    order = Window.partitionBy(*key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("equity", F.exp(F.sum(F.log1p(F.col(value))).over(order)))
    peak = F.greatest(F.lit(1.0), F.max("equity").over(order))
    return out.withColumn("drawdown", F.col("equity") / peak - 1)


def performance(returns: DataFrame, key: Sequence[str], day: str, value: str) -> DataFrame:
    """Sharpe ratio (252 days, sample spread, 0 without one), mean in basis points, drawdown and total return."""
    curve = equity_curve(returns, key, day, value)
    sd = F.stddev_samp(value)
    out = curve.groupBy(*key).agg(F.count("*").alias("n_days"), F.when(sd > 0, F.sqrt(F.lit(252.0)) * F.avg(value) / sd).otherwise(0.0).alias("sharpe"), (F.avg(value) * 1e4).alias("mean_bps"), F.min("drawdown").alias("max_drawdown"), F.max_by("equity", day).alias("_end"))
    return out.withColumn("total_return", F.col("_end") - 1).drop("_end")


def span_coverage(rows: DataFrame, key: Sequence[str], day: str, start: str, end: str, edge_days: int, gap_days: int) -> DataFrame:
    """Whether distinct days cover a span: edges within a tolerance, no gap too long."""
    days = rows.select(*key, F.to_date(day).alias("_d")).distinct().filter(F.col("_d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    gap = F.datediff(F.col("_d"), F.lag("_d").over(Window.partitionBy(*key).orderBy("_d")))
    out = days.withColumn("_gap", gap).groupBy(*key).agg(F.count("*").alias("n_days"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"), F.coalesce(F.max("_gap"), F.lit(0)).cast("long").alias("largest_gap"))
    covered = (F.datediff(F.col("_lo"), F.lit(start).cast("date")) <= edge_days) & (F.datediff(F.lit(end).cast("date"), F.col("_hi")) <= edge_days) & (F.col("largest_gap") <= gap_days)
    return out.select(*key, "n_days", "largest_gap", covered.alias("covered"))


def session_calendar(rows: DataFrame, start: str, end: str, holidays: Sequence[str] = ()) -> DataFrame:
    """Weekdays of a span that are no holidays, with their ordinal."""
    spark = rows.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    days = days.filter(~F.dayofweek("day").isin(1, 7) & ~F.col("day").cast("string").isin(*holidays or ("",)))
    return days.withColumn("session", F.row_number().over(Window.orderBy("day")))
