"""Intervals and tests by resampling whole clusters or blocks, in hash mode (see `resample`).

A cluster keeps one label. Resamples draw clusters of each label with replacement, so both classes stay; permutations deal
the labels anew over clusters. Rows are first counted by cluster and score, so what a replicate carries is one row for
a different score of a cluster, not one for a row. `by` names the groups; each has its own clusters, resamples and result.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import ordered
from .resample import deal, hash_uniform, poisson_count

TIES = 1e-12


def cluster_weights(rows: DataFrame, cluster: str, label: str, n_reps: int, by: Sequence[str] = ()) -> DataFrame:
    """by, cluster, rep and weight: how often a cluster is drawn among those of its label; clusters stand in their order."""
    units = rows.groupBy(*by, cluster).agg(F.max(label).alias("_g"))
    units = ordered.places(units, [*by, "_g"], [cluster], "_place", "_n")
    slots = units.select(*by, "_g", "_n", F.col("_place").alias("_slot")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_reps - 1))))
    drawn = slots.select(*by, "_g", "rep", F.pmod(hash_uniform(*map(F.col, by), F.col("rep"), F.col("_g"), F.col("_slot")), F.col("_n")).alias("_place"))
    counts = drawn.groupBy(*by, "_g", "rep", "_place").agg(F.count("*").alias("weight"))
    return counts.join(units.drop("_n"), [*by, "_g", "_place"]).select(*by, cluster, "rep", "weight")


def weighted_auc(rows: DataFrame, score: str, label: str, weight: str, by: Sequence[str]) -> DataFrame:
    """by and auc of weighted rows: the weighted share of pairs in which the positive scores higher, ties counting half."""
    w = F.col(weight).cast("double")
    values = rows.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("_pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("_neg"))
    values = ordered.sums_before(values, by, [score], {"_below": "_neg"})
    wins = values.withColumn("_wins", F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    both = F.sum("_pos") * F.sum("_neg")
    return wins.groupBy(*by).agg(F.try_divide(F.sum("_wins"), both).alias("auc"))


def _counted(rows: DataFrame, score: str, label: str, cluster: str, by: Sequence[str]) -> DataFrame:
    kept = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return kept.groupBy(*by, F.col(cluster).alias("_cluster"), F.col(label).alias("_label"), F.col(score).alias("_score")).agg(F.count("*").alias("_rows"))


def resampled_auc(rows: DataFrame, score: str, label: str, cluster: str, n_reps: int, by: Sequence[str] = ()) -> DataFrame:
    """by, rep and auc over resamples of clusters."""
    counted = _counted(rows, score, label, cluster, by)
    weights = cluster_weights(counted, "_cluster", "_label", n_reps, by)
    weighed = counted.join(weights, [*by, "_cluster"]).withColumn("_w", F.col("_rows") * F.col("weight"))
    return weighted_auc(weighed, "_score", "_label", "_w", [*by, "rep"])


def _bounds(values: DataFrame, value: str, by: Sequence[str], confidence: float) -> DataFrame:
    a = (1 - confidence) / 2
    ended = F.percentile(value, F.array(F.lit(a), F.lit(1 - a)))
    return values.groupBy(*by).agg(ended.alias("_ends"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("standard_error"), F.count(value).alias("n_reps"), two_sided(F.col(value)).alias("p")).select(*by, F.col("_ends")[0].alias("low"), F.col("_ends")[1].alias("high"), "standard_error", "n_reps", "p")


def two_sided(value: Column) -> Column:
    """The two-sided p-value of resampled differences, as an aggregate."""
    at_or_below, at_or_above = F.count_if(value <= 0) + 1, F.count_if(value >= 0) + 1
    return F.least(F.lit(1.0), 2.0 * F.least(at_or_below, at_or_above) / (F.count(value) + 1))


def detectable_effect(standard_error: Column, power: float = 0.8, alpha: float = 0.05) -> Column:
    """The least effect that a two-sided z test detects with the power."""
    normal = NormalDist()
    return standard_error * (normal.inv_cdf(1 - alpha / 2) + normal.inv_cdf(power))


def clustered_auc_interval(rows: DataFrame, score: str, label: str, cluster: str, n_reps: int, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """by, auc, low, high, standard_error and detectable (the least effect that would be found); groups without both classes have none."""
    point = weighted_auc(_counted(rows, score, label, cluster, by), "_score", "_label", "_rows", by)
    found = _bounds(resampled_auc(rows, score, label, cluster, n_reps, by), "auc", by, confidence).drop("n_reps", "p")
    joined = point.join(found, list(by)) if by else point.crossJoin(found)
    return joined.withColumn("detectable", F.when(F.col("auc").isNotNull(), detectable_effect(F.col("standard_error"))))


def paired_auc_difference(rows: DataFrame, a: str, b: str, label: str, cluster: str, n_reps: int, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """by, auc_a, auc_b, difference, low, high, standard_error, detectable and p; both AUCs are taken on the same resamples."""
    kept = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = kept.select(*by, F.col(label).alias("_l"), F.col(cluster).alias("_c"), F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(c).cast("double").alias("score")) for n, c in (("a", a), ("b", b))))).alias("_s"))
    both = both.select(*by, "_l", "_c", F.col("_s.side").alias("_side"), F.col("_s.score").alias("_v"))
    sided = [*by, "_side"]
    point = weighted_auc(_counted(both, "_v", "_l", "_c", sided), "_score", "_label", "_rows", sided)
    # the draws do not depend on the side, so weights are made of one side's clusters
    counted = _counted(both, "_v", "_l", "_c", sided)
    weights = cluster_weights(counted.filter("_side = 'a'"), "_cluster", "_label", n_reps, by)
    weighed = counted.join(weights, [*by, "_cluster"]).withColumn("_w", F.col("_rows") * F.col("weight"))
    aucs = weighted_auc(weighed, "_score", "_label", "_w", [*sided, "rep"])
    side = lambda s: F.max(F.when(F.col("_side") == s, F.col("auc")))
    found = _bounds(aucs.groupBy(*by, "rep").agg((side("a") - side("b")).alias("_d")), "_d", by, confidence)
    points = point.groupBy(*by).agg(side("a").alias("auc_a"), side("b").alias("auc_b")).withColumn("difference", F.col("auc_a") - F.col("auc_b"))
    joined = points.join(found, list(by)) if by else points.crossJoin(found)
    return joined.withColumn("detectable", detectable_effect(F.col("standard_error"))).drop("n_reps")


def permutation_auc_test(rows: DataFrame, score: str, label: str, cluster: str, n_perms: int, by: Sequence[str] = ()) -> DataFrame:
    """by, auc, hits and p: whether labels dealt anew over clusters give as high an AUC; scores' ranks stay."""
    counted = _counted(rows, score, label, cluster, by)
    values = counted.groupBy(*by, "_score").agg(F.sum("_rows").alias("_n"))
    ranks = ordered.sums_before(values, by, ["_score"], {"_before": "_n"}).select(*by, "_score", (F.col("_before") + (F.col("_n") + 1) / 2.0).alias("_rank"))
    units = counted.join(ranks, [*by, "_score"]).groupBy(*by, "_cluster").agg(F.sum(F.col("_rows") * F.col("_rank")).alias("_ranks"), F.sum("_rows").alias("_n"), F.max("_label").alias("_g"))
    whole = units.groupBy(*by).agg(F.sum("_n").alias("_all"), F.sum("_g").alias("_m"), F.sum(F.when(F.col("_g") == 1, F.col("_ranks"))).alias("_r1"), F.sum(F.when(F.col("_g") == 1, F.col("_n"))).alias("_n1"))
    auc = lambda ranks, n, all_: F.try_divide(ranks - n * (n + 1) / 2.0, (n * (all_ - n)).cast("double"))
    whole = whole.withColumn("auc", auc(F.col("_r1"), F.col("_n1"), F.col("_all")))
    head = whole.select(*by, "_all", "_m", "auc")
    place = lambda rep: hash_uniform(*map(F.col, by), rep, F.col("_cluster"))
    dealt = deal(units, head.select(*by, "_m"), by, "_cluster", place, n_perms, ["_ranks", "_n"], "rep")
    dealt = dealt.join(head, list(by)) if by else dealt.crossJoin(head)
    perms = dealt.select(*by, "rep", auc(F.col("_ranks"), F.col("_n"), F.col("_all")).alias("_auc"), "auc")
    hits = perms.groupBy(*by).agg(F.first("auc").alias("auc"), F.count_if(F.col("_auc") >= F.col("auc") - TIES).alias("hits"), F.count("*").alias("n_perms"))
    return hits.withColumn("p", (F.col("hits") + 1) / (F.col("n_perms") + 1))


def paired_loss_difference(rows: DataFrame, order: str, a: str, b: str, length: int, n_reps: int, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """by, n, difference (mean of a less b), low, high, standard_error and p, by moving blocks of a series' rows.

    Every place of the series but the last begins a block of `length` rows (of the whole series if that is shorter). A
    replicate takes a block as often as a Poisson draw from the hash of (group, replicate, place) says, on average as many as
    fill the series; the mean is over the rows of what it takes. Blocks are summed before replicates are made, in stretches
    of the series, so a row is sent once, and a task gives one row for a group and replicate.
    """
    by = list(by)
    kept = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, order, (F.col(a) - F.col(b)).cast("double").alias("_d"))
    placed = ordered.places(kept, by, [order], "_place", "n")
    block = F.least(F.lit(length).cast("long"), F.col("n"))
    starts = F.col("n") - block + 1
    blocks = ordered.following_sums(placed, by, "_place", "_d", length, "_s").filter(F.col("_place") < starts)
    drawn = blocks.withColumn("_rate", F.ceil(F.col("n") / block) / starts).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_reps - 1))))
    drawn = drawn.withColumn("_w", poisson_count(hash_uniform(*map(F.col, by), F.col("rep"), F.col("_place")), F.col("_rate")))
    means = drawn.groupBy(*by, "rep").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * block).cast("double")).alias("_m"))
    found = _bounds(means, "_m", by, confidence).drop("n_reps")
    head = kept.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_d").alias("difference"))
    return head.join(found, by) if by else head.crossJoin(found)


def random_answerer_null(rows: DataFrame, key: str, answer: str, target: str, answers: int, n_null: int, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """by, observed (share of right answers), low, high and p against answerers that pick one of 0 to answers - 1 at random."""
    kept = rows.filter(F.col(answer).isNotNull() & F.col(target).isNotNull())
    observed = kept.groupBy(*by).agg(F.avg((F.col(answer) == F.col(target)).cast("double")).alias("observed"))
    dealt = kept.select(*by, key, target).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_null - 1))))
    right = (F.pmod(hash_uniform(F.col("rep"), F.col(key)), F.lit(answers)) == F.col(target)).cast("double")
    null = dealt.groupBy(*by, "rep").agg(F.avg(right).alias("_share"))
    null = null.join(observed, list(by)) if by else null.crossJoin(observed)
    a = (1 - confidence) / 2
    return null.groupBy(*by).agg(
        F.first("observed").alias("observed"), F.percentile("_share", F.lit(a)).alias("low"), F.percentile("_share", F.lit(1 - a)).alias("high"), ((F.count_if(F.col("_share") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p")
    )


def smallest_certifiable_n(targets: DataFrame, target: str, confidence: float = 0.95, tail: str = "one", limit: int = 2000) -> DataFrame:
    """targets with n: the fewest unanimous draws whose Wilson lower bound reaches the target; null if none up to limit does."""
    sizes = targets.sparkSession.range(1, limit + 1).select(F.col("id").alias("n"))
    low, _ = stats.wilson(F.col("n"), F.col("n"), confidence, tail)
    bounds = sizes.select("n", low.alias("_low"))
    # one row for a size; the bound grows with it
    met = targets.select(target).distinct().join(F.broadcast(bounds), F.col("_low") >= F.col(target)).groupBy(target).agg(F.min("n").alias("n"))
    return targets.join(met, target, "left")


def smallest_split_n(positions: Column, min_draws: int = 8, min_density: float = 1.5) -> Column:
    """The fewest draws at which a split over so many lattice positions can be found."""
    return F.greatest(F.lit(min_draws), F.ceil(positions * min_density)).cast("long")


def decide(low: Column, high: Column, checked: Column, margin: float) -> Column:
    """improve if an interval lies above 0 and the check holds, match if it lies within the margin, else undecided."""
    within = (low >= -margin) & (high <= margin)
    return F.when((low > 0) & F.coalesce(checked, F.lit(False)), "improve").when(within, "match").otherwise("undecided")
