"""Consensus over repeated draws of an item: modal answers, robust locations, lattices, splits, dependence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def modal_answer(draws: DataFrame, item: Sequence[str], answer: str) -> DataFrame:
    """The most common answer of each item (of equals the smaller), its share, and a Wilson interval of the share."""
    counts = draws.groupBy(*item, answer).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*item).orderBy(F.col("_n").desc(), answer)
    ranked = counts.select(*item, answer, "_n", F.row_number().over(order).alias("_r"), F.sum("_n").over(Window.partitionBy(*item)).alias("n"))
    low, high = stats.wilson(F.col("_n"), F.col("n"))
    return ranked.filter("_r = 1").select(*item, F.col(answer).alias("modal"), F.col("_n").alias("n_modal"), "n", (F.col("_n") / F.col("n")).alias("agreement"), low.alias("low"), high.alias("high"))


def consensus_draw(draws: DataFrame, item: Sequence[str], answer: str, text: str) -> DataFrame:
    """Of the draws with the modal answer, that of the smallest text."""
    modal = modal_answer(draws, item, answer).select(*item, "modal", "agreement")
    return draws.join(modal, list(item)).filter(F.col(answer) == F.col("modal")).groupBy(*item).agg(F.first("modal").alias("modal"), F.first("agreement").alias("agreement"), F.min(text).alias("consensus"))


def canonical_hash(draws: DataFrame, item: Sequence[str], text: str, tag: str = "draws-v1") -> DataFrame:
    """A hash of an item's draws that ignores their order but not their number."""
    return draws.groupBy(*item).agg(F.sha2(F.concat_ws("\x1f", F.lit(tag), F.array_sort(F.collect_list(F.sha2(text, 256)))), 256).alias("draws_hash"))


def robust_location(draws: DataFrame, item: Sequence[str], value: str, trim: float = 0.1) -> DataFrame:
    """Mean, lower median, trimmed mean (all values if nothing would be left) and scale of each item's values."""
    sorted_ = draws.filter(F.col(value).isNotNull()).groupBy(*item).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_v"))
    n = F.size("_v")
    cut = F.floor(n * F.lit(trim)).cast("int")
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda t, x: t + x) / F.size(v)
    inner = F.when(n - 2 * cut > 0, F.slice("_v", cut + 1, n - 2 * cut)).otherwise(F.col("_v"))
    median = stats.lower_median(F.col("_v"))
    out = sorted_.select(*item, n.cast("long").alias("n"), mean(F.col("_v")).alias("mean"), median.alias("median"), mean(inner).alias("trimmed"), "_v")
    deviation = stats.lower_median(F.transform("_v", lambda x: F.abs(x - F.col("median"))))
    return out.select(*item, "n", "mean", "median", "trimmed", (1.4826 * deviation).alias("mad_scale"))


def scale_floor(mad_scale: Column, grid: float) -> Column:
    return F.greatest(mad_scale, F.lit(grid / 12**0.5))


def occupancy(draws: DataFrame, item: Sequence[str], value: str, grid: str) -> DataFrame:
    """Counts of each item's values by their lattice position."""
    return draws.groupBy(*item, stats.snap(F.col(value).cast("double"), grid).alias("position")).agg(F.count("*").alias("n"))


def grid_adherence(draws: DataFrame, item: Sequence[str], value: str, grid: str) -> DataFrame:
    """Share of each item's values that lie on the lattice."""
    return draws.groupBy(*item).agg(F.avg(stats.on_grid(F.col(value).cast("double"), grid).cast("double")).alias("adherence"))


def _highest(values: Column, levels: Column) -> Column:
    """A sparse table of an array: level k holds, for each place, the largest of the 2 ** k values from there on."""
    double = lambda table, k: F.transform(F.element_at(table, -1), lambda x, i: F.greatest(x, F.get(F.element_at(table, -1), i + F.call_function("shiftleft", F.lit(1), k))))
    return F.aggregate(F.sequence(F.lit(0), levels), F.array(values), lambda table, k: F.concat(table, F.array(double(table, k))))


def _leap(start: Column, levels: Column, below: Callable[[Column, Column], Column]) -> Column:
    """The first place from `start` on where a block of one place is not `below`; below(k, place) asks it of 2 ** k places."""
    down = F.sequence(levels, F.lit(0), F.lit(-1))
    return F.aggregate(down, start, lambda at, k: F.when(below(k, at), at + F.call_function("shiftleft", F.lit(1), k)).otherwise(at))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_search(
    draws: DataFrame, item: Sequence[str], value: str, grid: str, min_mass: float = 0.25, min_gap: int = 3, contrast: float = 10.0, min_draws: int = 8, min_density: float = 1.5
) -> DataFrame:
    """Whether each item's draws form two clusters with a sparse gap between them.

    Every pair of occupied positions is a candidate gap: both sides must hold a share of the draws, the gap must be wide
    enough in lattice steps, the clusters dense enough, and the taller cluster's peak must exceed the gap's by `contrast`.
    The sparsest gap wins, then the sharpest, then the lowest. `separated` is null for fewer than `min_draws` draws.

    An item's positions stand in one sorted array with running sums and peaks. For one lower edge the draws inside the gap
    grow with the upper edge, so only the first upper edge that is far enough and dense enough can win; the conditions on mass
    and contrast, once lost, do not come back. That edge is found by leaps over a sparse table of maxima, and the gap's peak
    by two of its entries: m positions take m log m steps, and no pairs are made.
    """
    keys = list(item)
    counts = occupancy(draws, item, value, grid)
    step = float(grid)
    order = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(F.col("position").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.select(*keys, "position", "n", F.sum("n").over(order).alias("upto"), F.max("n").over(order).alias("peak_low"), F.sum("n").over(back).alias("upper"), F.max("n").over(back).alias("peak_high"))
    c = summed.groupBy(*keys).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("position", "n", "upto", "peak_low", "upper", "peak_high"))).alias("_c"))
    c = c.withColumn("_m", F.size("_c")).withColumn("_top", F.floor(F.log2(F.col("_m"))).cast("int"))
    m, top = F.col("_m"), F.col("_top")
    c = c.withColumn("_peaks", _highest(F.transform("_c", lambda x: x["n"]), top))
    c = c.withColumn("_dense", _highest(F.transform("_c", lambda x, j: x["upper"] + min_density * j), top))
    at = lambda name, i: F.get(F.col("_c"), i)[name]
    entry = lambda table, k, i: F.get(F.get(F.col(table), k), i)
    near = lambda a, j: F.round((at("position", j) - a) / step) - 1 < min_gap

    def inside(i: Column, j: Column) -> Column:
        """The peak strictly between two places."""
        return _with(F.floor(F.log2(F.greatest(j - i - 1, F.lit(1)))).cast("int"), lambda k: F.when(j - i > 1, F.greatest(entry("_peaks", k, i + 1), entry("_peaks", k, j - F.call_function("shiftleft", F.lit(1), k)))).otherwise(0))

    def gap(low: Column, i: Column) -> Column:
        far = _leap(i + 1, top, lambda k, p: near(low["position"], F.least(p + F.call_function("shiftleft", F.lit(1), k), m) - 1) & (p < m))
        need = min_density * (i + m + 1) - low["upto"]
        dense = _with(far, lambda start: _leap(start, top, lambda k, p: entry("_dense", k, p) < need))
        return _with(dense, lambda j: _with(inside(i, j), lambda trough: judged(low, i, j, trough)))

    def judged(low: Column, i: Column, j: Column, trough: Column) -> Column:
        upper, peak = at("upper", j), F.greatest(low["peak_low"], at("peak_high", j))
        fits = (j < m) & (upper >= min_mass * F.col("n")) & (peak >= contrast * trough)
        parts = F.struct((F.col("n") - low["upto"] - upper).alias("inner"), (-(peak - contrast * trough)).cast("double").alias("dull"), i.alias("i"), j.alias("j"), low["position"].alias("a"), at("position", j).alias("b"), low["upto"].alias("lower"), upper.alias("upper"))
        return F.when(fits, parts)

    gaps = F.transform("_c", lambda low, i: F.when(low["upto"] >= min_mass * F.col("n"), gap(low, i)))
    best = c.select(*keys, "n", F.array_min(F.array_compact(gaps)).alias("best"))
    share = lambda name: F.col(f"best.{name}") / F.col("n")
    enough = F.col("n") >= min_draws
    return best.select(
        *keys,
        "n",
        F.when(enough, F.col("best").isNotNull()).alias("separated"),
        F.when(enough, share("lower")).alias("lower_mass"),
        F.when(enough, share("upper")).alias("upper_mass"),
        F.when(enough, share("inner")).alias("trough_mass"),
        F.when(enough, F.col("best.a")).alias("gap_low"),
        F.when(enough, F.col("best.b")).alias("gap_high"),
    )


def lag_dependence(draws: DataFrame, item: Sequence[str], label: str, group: str) -> DataFrame:
    """P(same label | same group) less P(same label | other group) over pairs of draws, from counts alone."""
    pairs = lambda n: n * (n - 1) / 2
    cells = draws.groupBy(*item, group, label).agg(F.count("*").alias("c"))
    groups = cells.groupBy(*item, group).agg(F.sum("c").alias("g"), F.sum(pairs(F.col("c"))).alias("same")).groupBy(*item).agg(F.sum(pairs(F.col("g"))).alias("in_pairs"), F.sum("same").alias("in_same"), F.sum("g").alias("n"))
    labels = cells.groupBy(*item, label).agg(F.sum("c").alias("l")).groupBy(*item).agg(F.sum(pairs(F.col("l"))).alias("all_same"))
    both = groups.join(labels, list(item))
    out_pairs, out_same = pairs(F.col("n")) - F.col("in_pairs"), F.col("all_same") - F.col("in_same")
    return both.select(*item, "n", F.when((F.col("in_pairs") > 0) & (out_pairs > 0), F.col("in_same") / F.col("in_pairs") - out_same / out_pairs).alias("dependence"))


def draw_distribution(draws: DataFrame, item: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Quantiles, spread, share with the median's sign, lag-one correlation and mid-rank of the first draw of each item."""
    keys = list(item)
    rows = draws.filter(F.col(value).isNotNull())
    in_order, by_value, ties = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys, value)
    rows = rows.select(*keys, F.col(value).alias("v"), F.lead(value).over(in_order).alias("w"), F.row_number().over(in_order).alias("k"), (F.rank().over(by_value) - 1 + F.count("*").over(ties) / 2.0).alias("r"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), stats.quantiles(F.col("v")).alias("q"), F.stddev_samp("v").alias("sd"), F.count_if(F.col("v") > 0).alias("up"), F.count_if(F.col("v") < 0).alias("down"), F.count_if(F.col("v") == 0).alias("flat"), F.corr("v", "w").alias("lag1"), F.max(F.when(F.col("k") == 1, F.col("r"))).alias("first")
    )
    middle = F.get("q", F.lit(2))
    signed = F.when(middle > 0, F.col("up")).when(middle < 0, F.col("down")).otherwise(F.col("flat"))
    names = ("q05", "q25", "q50", "q75", "q95")
    return out.select(
        *keys, "n", *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(names)], F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd")).alias("sd"), (F.get("q", F.lit(3)) - F.get("q", F.lit(1))).alias("iqr"), (signed / F.col("n")).alias("same_sign"), (F.col("first") / F.col("n")).alias("first_rank"), F.when(F.col("n") >= 3, F.when(~F.isnan("lag1"), F.col("lag1"))).alias("lag1")
    )


def decide(draws: DataFrame, item: Sequence[str], value: str, p_recall: str, grid: str, min_parsed: int) -> DataFrame:
    """A decision of each item: lower median unless split, shrunk by the mean recall estimate, with a status."""
    keys = list(item)
    location = robust_location(draws, item, value).select(*keys, "n", "median")
    verdict = split_search(draws.filter(F.col(value).isNotNull()), item, value, grid).select(*keys, "separated")
    recall = draws.groupBy(*keys).agg(F.avg(p_recall).alias("p_recall"), F.count("*").alias("n_draws"))
    split = F.coalesce(F.col("separated"), F.lit(False))
    status = F.when(F.coalesce(F.col("n"), F.lit(0)) < min_parsed, "failed").when(split, "unavailable").when(F.col("p_recall").isNull(), "weak").otherwise("ok")
    answer = F.when((F.col("n") >= min_parsed) & ~split, F.col("median"))
    kept = 1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p_recall")))
    return recall.join(location, keys, "left").join(verdict, keys, "left").select(*keys, "n_draws", F.coalesce("n", F.lit(0)).alias("n_parsed"), answer.alias("raw"), "p_recall", (answer * kept).alias("adjusted"), status.alias("status"))
