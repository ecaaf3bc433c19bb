"""Variants of a decision from one set of draws: a single draw or the ensemble, unadjusted or shrunk by an estimate of recall, scored against what came."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import consensus

# fixed values: the bounds of a scored probability, and the places to which a sign is read
CLIP = (0.01, 0.99)
SIGN_PLACES = 9
SINGLE, ENSEMBLE, UNADJUSTED = "single", "ensemble", "none"


def _up(x: Column) -> Column:
    return F.round(x, SIGN_PLACES) > 0


def item_variants(draws: DataFrame, outcomes: DataFrame, item: str, index: str, value: str, estimates: Mapping[str, str], realized: str, min_parsed: int, grid: str) -> DataFrame:
    """A row for each item, mode (single, ensemble) and adjustment (none and those of `estimates`, which names each one's column of draws).

    item, mode, adjustment, status, raw, p_recall, adjusted, correct, from_raw, probability, adjusted_probability and reason.
    The single draw is that of index 0. An ensemble decides by the lower median of its values and needs min_parsed of them; one
    that splits in two is unresolved. The mean estimate of the decided draws shrinks the decision; without one it stands as it
    is (unadjusted). Whether the adjusted decision is above zero is scored against whether the outcome is, by the raw
    one where the adjusted one has shrunk to zero (from_raw). The probability is the share of the draws above zero within CLIP, shrunk to a half alike.
    reason says why `correct` is null: no decision, no outcome, or unresolved, in this order.

    A draw without a value is not parsed, and its estimates do not count. An index that stands twice counts twice, and the single
    draw is then the highest. Items of outcomes without draws have no row; the draws are read once and no row of them is repeated.
    """
    parsed = F.col(value).isNotNull()
    number = F.col(value).cast("double")
    first = parsed & (F.col(index) == 0)
    means = [F.avg(F.when(on, F.col(c).cast("double"))).alias(f"_{mode}_{a}") for a, c in estimates.items() for mode, on in ((SINGLE, first), (ENSEMBLE, parsed))]
    sums = draws.groupBy(item).agg(F.count(value).alias("_n"), F.count_if(_up(number)).alias("_up"), F.max(F.when(first, number)).alias("_first"), *means)
    median = consensus.robust_location(draws, [item], value).select(item, F.col("median").alias("_median"))
    split = consensus.split_search(draws.filter(parsed), [item], value, grid).select(item, F.coalesce("separated", F.lit(False)).alias("_split"))
    came = outcomes.groupBy(item).agg(F.max(F.col(realized).cast("double")).alias("_realized"))
    wide = sums.join(median, item, "left").join(split, item, "left").join(came, item, "left")
    modes = {
        SINGLE: (F.col("_first").isNull(), F.col("_first"), _up(F.col("_first")).cast("double")),
        ENSEMBLE: (F.col("_n") < min_parsed, F.when(~F.coalesce("_split", F.lit(False)), F.col("_median")), F.try_divide(F.col("_up").cast("double"), F.col("_n").cast("double"))),
    }
    cells = [_variant(mode, a, *modes[mode], F.lit(None).cast("double") if a == UNADJUSTED else F.col(f"_{mode}_{a}")) for mode in modes for a in (UNADJUSTED, *estimates)]
    return wide.select(item, F.inline(F.array(*cells)))


def _variant(mode: str, adjustment: str, failed: Column, raw: Column, share: Column, p: Column) -> Column:
    raw, p = F.when(~failed, raw), F.when(~failed, p)
    kept = 1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(p, F.lit(0.0))))
    adjusted = raw * kept
    from_raw = (F.round(adjusted, SIGN_PLACES) == 0) & (F.round(raw, SIGN_PLACES) != 0)
    decided = F.when(from_raw, raw).otherwise(adjusted)
    reason = F.when(failed, "no decision").when(F.col("_realized").isNull(), "no outcome").when(raw.isNull(), "unresolved").otherwise("")
    probability = F.when(~failed & F.col("_realized").isNotNull(), F.greatest(F.lit(CLIP[0]), F.least(F.lit(CLIP[1]), share)))
    status = F.when(failed, "failed").when(raw.isNull(), "unresolved").when(p.isNull(), "unadjusted").otherwise("ok")
    return F.struct(
        F.lit(mode).alias("mode"), F.lit(adjustment).alias("adjustment"), status.alias("status"), raw.alias("raw"), p.alias("p_recall"), adjusted.alias("adjusted"), F.when(reason == "", _up(decided) == _up(F.col("_realized"))).alias("correct"),
        F.when(reason == "", from_raw).alias("from_raw"), probability.alias("probability"), F.when(kept == 1.0, probability).otherwise(0.5 + kept * (probability - 0.5)).alias("adjusted_probability"), F.col("_realized").alias("realized"), reason.alias("reason"),
    )


def variant_summary(rows: DataFrame) -> DataFrame:
    """mode, adjustment and, of item_variants: planned items, those with a decision scored, accuracy over these and over the planned, from_raw, forecasts, and Brier and log loss raw and adjusted.

    Losses are over all items with a probability, an unresolved one included. A ratio over nothing is null.
    """
    y = _up(F.col("realized")).cast("double")
    brier = lambda c: F.avg((F.col(c) - y) * (F.col(c) - y))
    log_loss = lambda c: F.avg(-F.log(F.when(y == 1, F.col(c)).otherwise(1.0 - F.col(c))))
    right = F.count_if("correct")
    return rows.groupBy("mode", "adjustment").agg(
        F.count("*").alias("planned"), F.count("correct").alias("scored"), F.try_divide(right.cast("double"), F.count("correct").cast("double")).alias("accuracy"), (right / F.count("*")).alias("accuracy_planned"), F.count_if("from_raw").alias("from_raw"),
        F.count("probability").alias("forecasts"), brier("probability").alias("brier"), brier("adjusted_probability").alias("adjusted_brier"), log_loss("probability").alias("log_loss"), log_loss("adjusted_probability").alias("adjusted_log_loss"),
    )
