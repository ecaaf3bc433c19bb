"""Accuracy, effect sizes, discrimination, calibration, agreement and multiple tests, as grouped aggregates.

`by` names the grouping columns of an operator; an empty list makes one row of everything. Statistics that cannot be
computed are null, and a column says why where the reason matters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import ordered


def accuracy(records: DataFrame, predicted: str, target: str, usable: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy over usable rows with a Wilson interval; the usable share of no rows is 1."""
    ok = F.coalesce(F.col(usable), F.lit(False))
    out = records.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_usable"), F.count_if(ok & (F.col(predicted) == F.col(target))).alias("n_correct"))
    low, high = stats.wilson(F.col("n_correct"), F.col("n_usable"))
    return out.select(*by, "n", "n_usable", "n_correct", F.when(F.col("n") > 0, F.col("n_usable") / F.col("n")).otherwise(1.0).alias("usable_share"), F.when(F.col("n_usable") > 0, F.col("n_correct") / F.col("n_usable")).alias("accuracy"), low.alias("low"), high.alias("high"))


def majority_baseline(rows: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """The most common target, of equals the smallest, and its share."""
    counts = rows.groupBy(*by, target).agg(F.count("*").alias("_n"))
    best = F.max_by(F.struct(F.col(target).alias("v"), F.col("_n").alias("n")), F.struct(F.col("_n"), -F.col(target))).alias("_best")
    return counts.groupBy(*by).agg(best, F.sum("_n").alias("n")).select(*by, F.col("_best.v").alias("majority"), "n", (F.col("_best.n") / F.col("n")).alias("share"))


def rank_auc(rows: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC as the Mann-Whitney statistic, ties counting half; null without both classes.

    Scores are first counted by value, so a shuffle carries one row for a different score, and ranks come from running
    sums over these, in which no group is brought into one task.
    """
    values = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    values = ordered.sums_before(values, by, [score], {"_below": "_neg"})
    wins = F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)
    sums = values.select(*by, "_pos", "_neg", wins.alias("_wins")).groupBy(*by).agg(F.sum("_pos").alias("n_positive"), F.sum("_neg").alias("n_negative"), F.sum("_wins").alias("_wins"))
    both = F.col("n_positive") * F.col("n_negative")
    return sums.select(*by, "n_positive", "n_negative", F.when(both > 0, F.col("_wins") / both).alias("auc"))


def effect_size(rows: DataFrame, value: str, side: str, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's d of the two sides (true less false) with the pooled sample spread."""
    inside, outside = F.when(F.col(side), F.col(value)), F.when(~F.col(side), F.col(value))
    out = rows.groupBy(*by).agg(
        F.count(inside).alias("n_in"), F.count(outside).alias("n_out"), F.avg(inside).alias("mean_in"), F.avg(outside).alias("mean_out"), F.var_samp(inside).alias("_vi"), F.var_samp(outside).alias("_vo")
    )
    enough = (F.col("n_in") >= 2) & (F.col("n_out") >= 2)
    pooled = F.sqrt(((F.col("n_in") - 1) * F.col("_vi") + (F.col("n_out") - 1) * F.col("_vo")) / (F.col("n_in") + F.col("n_out") - 2))
    out = out.withColumn("pooled", F.when(enough, pooled))
    usable = F.coalesce(F.col("pooled") > 0, F.lit(False))
    d = F.when(usable, (F.col("mean_in") - F.col("mean_out")) / F.col("pooled"))
    return out.select(*by, "n_in", "n_out", "mean_in", "mean_out", "pooled", d.alias("d"), F.when(usable, "").otherwise("insufficient samples").alias("note"))


def cutoff_gap(records: DataFrame, correct: str, inside: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy inside and after the cutoff, their gap, and the rows that belong to neither."""
    c, i = F.col(correct).cast("double"), F.col(inside)
    out = records.groupBy(*by).agg(F.count_if(i).alias("n_in"), F.count_if(~i).alias("n_out"), F.count_if(i.isNull()).alias("n_unmatched"), F.avg(F.when(i, c)).alias("acc_in"), F.avg(F.when(~i, c)).alias("acc_out"))
    return out.withColumn("gap", F.col("acc_in") - F.col("acc_out"))


def difference_in_differences(rows: DataFrame, correct: str, treated: str, before: str, by: Sequence[str] = ()) -> DataFrame:
    """(treated - control) before the cutoff less the same after it; null if a cell is empty."""
    cells = {(t, b): F.avg(F.when((F.col(treated) == t) & (F.col(before) == b), F.col(correct).cast("double"))) for t in (True, False) for b in (True, False)}
    return rows.groupBy(*by).agg(((cells[True, True] - cells[False, True]) - (cells[True, False] - cells[False, False])).alias("did"))


def calibration(rows: DataFrame, p: str, label: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Brier score, the base rate's Brier score, and the expected calibration error over equal-width bins."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    parts = rows.filter(F.col(p).isNotNull() & F.col(label).isNotNull()).groupBy(*by, bin_.alias("_bin")).agg(
        F.count("*").alias("_n"), F.sum(F.col(p)).alias("_p"), F.sum(F.col(label).cast("double")).alias("_y"), F.sum(stats.brier(F.col(p), F.col(label))).alias("_b")
    )
    out = parts.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_b").alias("_b"), F.sum("_y").alias("_y"), F.sum(F.abs(F.col("_p") - F.col("_y"))).alias("_gap"))
    rate = F.col("_y") / F.col("n")
    return out.select(*by, "n", (F.col("_b") / F.col("n")).alias("brier"), (rate * (1 - rate)).alias("base_brier"), (F.col("_gap") / F.col("n")).alias("ece"))


def reliability_curve(rows: DataFrame, p: str, label: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Mean forecast, observed rate and count of every bin that has rows."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return rows.filter(F.col(p).isNotNull() & F.col(label).isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"))


def mid_rank_share(rows: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """The share of a group below a value plus half of those equal to it."""
    ranked = ordered.average_ranks(rows, value, "_rank", by, "_size")
    return ranked.withColumn(out, (F.col("_rank") - 0.5) / F.col("_size")).drop("_rank", "_size")


def agreement(rows: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean difference, limits of agreement, mean absolute difference and Spearman correlation of two measures."""
    rows = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = ordered.average_ranks(ordered.average_ranks(rows, a, "_ra", by), b, "_rb", by)
    diff = F.col(a) - F.col(b)
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.avg(diff).alias("bias"), F.stddev_samp(diff).alias("_sd"), F.avg(F.abs(diff)).alias("mean_abs"), F.corr("_ra", "_rb").alias("spearman"))
    return out.select(*by, "n", "bias", (F.col("bias") - 1.96 * F.col("_sd")).alias("low"), (F.col("bias") + 1.96 * F.col("_sd")).alias("high"), "mean_abs", "spearman")


def holm(tests: DataFrame, p: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """tests with column adjusted: Holm's step-down p-values within each group; null p stay null and do not count."""
    computed = tests.filter(F.col(p).isNotNull())
    order = Window.partitionBy(*by).orderBy(p, key)
    step = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(Window.partitionBy(*by)) - F.row_number().over(order) + 1))
    stepped = computed.withColumn("_step", step).withColumn("adjusted", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_step")
    return stepped.unionByName(tests.filter(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")))


def effective_weights(answers: DataFrame, answer: str, older: str, newer: str, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """Weighted shares of answers with weights (older / newer) ** alpha, effective sample size, largest share of a weight."""
    w = F.pow(F.try_divide(F.col(older), F.col(newer)), F.lit(alpha))
    parts = answers.groupBy(*by, answer).agg(F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"), F.max(w).alias("_top"))
    whole = Window.partitionBy(*by)
    total = F.sum("_w").over(whole)
    return parts.select(*by, answer, (F.col("_w") / total).alias("share"), (total * total / F.sum("_w2").over(whole)).alias("effective_n"), (F.max("_top").over(whole) / total).alias("top_weight"))


def pairing_check(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side alone, with the side."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.exceptAll(right).withColumn("side", F.lit("a")).unionByName(right.exceptAll(left).withColumn("side", F.lit("b")))


def complete_sum(value: Column) -> Column:
    """A sum that exists only if every row has the value."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))
