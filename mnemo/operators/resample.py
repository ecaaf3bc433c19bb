"""Resampling and permutation, in two modes.

Hash mode draws with the MD5 of (replicate, unit): it is part of the query plan, runs as aggregates, and any engine
reproduces it. Numpy mode draws with `numpy.random.default_rng` in a grouped map, so that a group's results equal
a numpy program's. The modes give different draws and are never mixed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def hash_uniform(*parts: Column) -> Column:
    """A whole number below 2 ** 32 from the parts: the first eight hexadecimal digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def poisson_thresholds(rate: float, terms: int = 20) -> list[int]:
    """Of a hash below 2 ** 32: from which values on a Poisson count exceeds 0, 1, and so on."""
    term, total, out = math.exp(-rate), 0.0, []
    for k in range(terms):
        total += term
        term *= rate / (k + 1)
        out.append(math.floor(total * 2**32))
    return [t for t in out if t < 2**32]


def poisson_count(u: Column, rate: Column | None = None) -> Column:
    """A Poisson count from a hash below 2 ** 32; of rate 1, or of a rate up to 1 that differs by row."""
    if rate is None:
        return reduce(lambda total, t: total + (u >= t).cast("int"), poisson_thresholds(1.0), F.lit(0))
    # the sum of the terms so far, the next term, how many sums the hash has reached
    start = F.struct(F.lit(0.0).alias("total"), F.exp(-rate).alias("term"), F.lit(0).alias("k"))

    def step(state: Column, i: Column) -> Column:
        total = state["total"] + state["term"]
        return F.struct(total.alias("total"), (state["term"] * rate / (i + 1)).alias("term"), (state["k"] + (u >= total * float(2**32)).cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(11)), start, step, lambda state: state["k"])


@dataclass(frozen=True)
class Statistic:
    """A statistic of weighted rows: named terms of a value that are summed with the weights, and what is made of the sums.

    The sum of the weights is there as `w`.
    """

    terms: Mapping[str, Callable[[Column], Column]]
    value: Callable[[Mapping[str, Column]], Column]


def _spread(s: Mapping[str, Column]) -> Column:
    return F.when(s["w"] > 1, F.sqrt(F.greatest(F.lit(0.0), (s["xx"] - s["x"] * s["x"] / s["w"]) / (s["w"] - 1))))


_MOMENTS = {"x": lambda v: v, "xx": lambda v: v * v}
#: What bootstrap() can take by name; more may be added by name.
WEIGHTED: dict[str, Statistic] = {
    "mean": Statistic({"x": lambda v: v}, lambda s: F.try_divide(s["x"], s["w"])),
    "mean_bps": Statistic({"x": lambda v: v}, lambda s: F.try_divide(s["x"], s["w"]) * 1e4),
    "share_positive": Statistic({"up": lambda v: (v > 0).cast("double")}, lambda s: F.try_divide(s["up"], s["w"])),
    "sd": Statistic(_MOMENTS, _spread),
    "sharpe": Statistic(_MOMENTS, lambda s: F.when(s["w"] > 0, F.coalesce(F.when(_spread(s) > 0, math.sqrt(252) * s["x"] / s["w"] / _spread(s)), F.lit(0.0)))),
}


def register(name: str, statistic: Statistic) -> None:
    """Let bootstrap() take the statistic by name."""
    WEIGHTED[name] = statistic


def bootstrap(rows: DataFrame, key: Sequence[str], unit: str, value: str, n_reps: int, statistic: str = "mean", confidence: float = 0.95) -> DataFrame:
    """key, n, point, low and high: a statistic of each group with a percentile interval over hash replicates.

    A replicate takes each row as often as a Poisson draw of rate 1 from the hash of (key, replicate, unit) says: a bootstrap
    whose size varies about the group's, in which rows are drawn apart from each other. So no row is numbered, sent or
    joined; a task gives one row of sums for a group and replicate. `unit` should differ in all rows of a group: equal units
    are drawn together. A replicate without rows, or whose statistic is null or not finite, is left out; the bounds contain
    the point, and are the point for a group of one row or without replicates. Null values take no part; a group without
    others has n 0 and nulls.
    """
    keys, kind = list(key), WEIGHTED[statistic]
    v = F.col(value).cast("double")
    told = rows.select(*keys, unit, v.alias("_v")).withColumn("_rep", F.explode(F.sequence(F.lit(-1), F.lit(n_reps - 1))))
    weight = F.when(F.col("_rep") < 0, 1).otherwise(poisson_count(hash_uniform(*map(F.col, keys), F.col("_rep"), F.col(unit))))
    told = told.withColumn("_w", F.when(F.col("_v").isNotNull(), weight).otherwise(0))
    sums = told.groupBy(*keys, "_rep").agg(F.sum("_w").alias("w"), *[F.coalesce(F.sum(F.col("_w") * term(F.col("_v"))), F.lit(0.0)).alias(name) for name, term in kind.terms.items()])
    found = sums.select(*keys, "_rep", "w", kind.value({"w": F.col("w"), **{n: F.col(n) for n in kind.terms}}).alias("_s"))
    ok = (F.col("_rep") >= 0) & F.col("_s").isNotNull() & ~F.isnan("_s") & (F.abs("_s") < float("inf"))
    a = (1 - confidence) / 2
    out = found.groupBy(*keys).agg(F.max(F.when(F.col("_rep") < 0, F.col("w"))).alias("n"), F.max(F.when(F.col("_rep") < 0, F.col("_s"))).alias("point"), F.percentile(F.when(ok, F.col("_s")), F.array(F.lit(a), F.lit(1 - a))).alias("_ends"))
    several = (F.col("n") > 1) & F.col("_ends").isNotNull()
    bound = lambda pick, k: F.when(several, pick("point", F.col("_ends")[k])).otherwise(F.col("point"))
    return out.select(*keys, "n", "point", bound(F.least, 0).alias("low"), bound(F.greatest, 1).alias("high"))


def deal(units: DataFrame, sizes: DataFrame, key: Sequence[str], unit: str, place: Callable[[Column], Column], n_reps: int, sums: Sequence[str], rep: str = "_rep", buckets: int = 1024) -> DataFrame:
    """key, rep and the sums of the units that a replicate deals to the first side: its first units in the order of a hash.

    `sizes` has each key's number of these, `_m`; place(replicate) is a hash below 2 ** 32, of equals the smaller unit comes
    first. Units are summed by stretches of the hash, which a task does for its own; whole stretches count as they are, and
    only the one in which the first side ends is put in order. So no key's units are brought into one task.
    """
    keys = list(key)
    dealt = units.withColumn(rep, F.explode(F.sequence(F.lit(0), F.lit(n_reps - 1)))).withColumn("_h", place(F.col(rep))).withColumn("_bucket", F.floor(F.col("_h") * buckets / 2**32).cast("int"))
    cells = dealt.groupBy(*keys, rep, "_bucket").agg(F.count("*").alias("_in"), *[F.sum(c).alias(c) for c in sums])
    cells = cells.withColumn("_before", F.sum("_in").over(Window.partitionBy(*keys, rep).orderBy("_bucket")) - F.col("_in"))
    cells = ordered.match(cells, sizes.select(*keys, "_m"), keys)
    whole = cells.filter(F.col("_before") + F.col("_in") <= F.col("_m")).select(*keys, rep, *sums)
    edge = cells.filter((F.col("_before") < F.col("_m")) & (F.col("_before") + F.col("_in") > F.col("_m"))).select(*keys, rep, "_bucket", (F.col("_m") - F.col("_before")).alias("_need"))
    last = ordered.match(dealt, edge, [*keys, rep, "_bucket"])
    last = last.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, rep).orderBy("_h", unit))).filter("_r <= _need").select(*keys, rep, *sums)
    return whole.unionByName(last).groupBy(*keys, rep).agg(*[F.sum(c).alias(c) for c in sums])


def permutation_test(rows: DataFrame, key: Sequence[str], unit: str, value: str, group: str, n_perms: int) -> DataFrame:
    """One-sided test that the mean of group 1 exceeds that of group 0, by permuting whole units.

    Values are summed by unit first. A permutation orders a key's units by hash and gives the first m of them, m being
    the number of units in group 1, to group 1 (see deal). A key with one group only has no difference.
    """
    keys = list(key)
    units = rows.groupBy(*keys, unit).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"), F.max(group).alias("_g"))
    observed = units.groupBy(*keys).agg(F.sum(F.when(F.col("_g") == 1, F.col("_s"))).alias("_s1"), F.sum(F.when(F.col("_g") == 1, F.col("_c"))).alias("_c1"), F.sum("_s").alias("_sum"), F.sum("_c").alias("_count"), F.sum("_g").alias("_m"))
    difference = lambda s1, c1: F.try_divide(s1, c1) - F.try_divide(F.col("_sum") - s1, F.col("_count") - c1)
    observed = observed.withColumn("difference", difference(F.col("_s1"), F.col("_c1")))
    dealt = deal(units, observed.select(*keys, "_m"), keys, unit, lambda rep: hash_uniform(rep, F.col(unit)), n_perms, ["_s", "_c"])
    perms = ordered.match(dealt, observed.select(*keys, "_sum", "_count", "difference"), keys)
    hits = perms.groupBy(*keys).agg(F.count_if(difference(F.col("_s"), F.col("_c")) >= F.col("difference") - 1e-12).alias("hits"), F.count("*").alias("n_perms"))
    return ordered.match(observed, hits, keys).select(*keys, "difference", "hits", "n_perms", ((F.col("hits") + 1) / (F.col("n_perms") + 1)).alias("p"))


# ---- numpy mode: a group fits in one task by the reference's own contract (a study's items)

STATISTICS: dict[str, Callable[[np.ndarray], float]] = {
    "mean": lambda x: float(x.mean()),
    "median": lambda x: float(np.median(x)),
    "sharpe": lambda x: float(np.sqrt(252) * x.mean() / x.std(ddof=1)) if len(x) > 1 and x.std(ddof=1) > 0 else 0.0,
}


def percentile_bounds(values: np.ndarray, confidence: float) -> tuple[float, float]:
    a = (1 - confidence) / 2 * 100
    low, high = np.percentile(values, [a, 100 - a])
    return float(low), float(high)


def bootstrap_interval(x: np.ndarray, statistic: Callable[[np.ndarray], float], n: int, confidence: float, seed: int) -> tuple[float, float, float]:
    """Point and percentile interval; resamples that fail or are not finite are dropped, bounds contain the point."""
    point = statistic(x)
    if len(x) < 2:
        return point, point, point
    rng, got = np.random.default_rng(seed), []
    for _ in range(n):
        try:
            value = statistic(x[rng.integers(0, len(x), len(x))])
        except (ValueError, ZeroDivisionError):
            continue
        if np.isfinite(value):
            got.append(value)
    if not got:
        return point, point, point
    low, high = percentile_bounds(np.array(got), confidence)
    return point, min(low, point), max(high, point)


def block_interval(x: np.ndarray, statistic: Callable[[np.ndarray], float], length: int, n: int, confidence: float, seed: int) -> tuple[float, float, float]:
    """The same with moving blocks: ceil(n / length) starts, concatenated and cut to the series' length."""
    point, size = statistic(x), len(x)
    rng, got = np.random.default_rng(seed), []
    for _ in range(n):
        starts = rng.integers(0, size - length + 1, -(-size // length))
        value = statistic(x[(starts[:, None] + np.arange(length)).reshape(-1)[:size]])
        if np.isfinite(value):
            got.append(value)
    if not got:
        raise ValueError("no resample gave a finite statistic")
    low, high = percentile_bounds(np.array(got), confidence)
    return point, min(low, point), max(high, point)


def grouped_interval(rows: DataFrame, key: Sequence[str], order: str, value: str, statistic: str = "mean", n: int = 1000, confidence: float = 0.95, seed: int = 42, block: int | None = None) -> DataFrame:
    """A numpy bootstrap interval of each group, its rows in an order; with `block`, over moving blocks."""
    keys = list(key)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys) + ", n long, point double, low double, high double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].dropna().to_numpy(float)
        head = pdf[keys].iloc[:1].reset_index(drop=True)
        if not len(x):
            return head.assign(n=0, point=None, low=None, high=None)
        got = bootstrap_interval(x, STATISTICS[statistic], n, confidence, seed) if block is None else block_interval(x, STATISTICS[statistic], min(block, len(x)), n, confidence, seed)
        return head.assign(n=len(x), point=got[0], low=got[1], high=got[2])

    return rows.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)


def simulated_power(designs: DataFrame, n_sim: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Power of a two-sided one-sample t test for each design (effect, noise_sd, n_items), with a simulated critical value."""

    def run(batches):  # type: ignore[no-untyped-def]
        for pdf in batches:
            out = []
            for effect, sd, n in zip(pdf["effect"], pdf["noise_sd"], pdf["n_items"], strict=True):
                rng = np.random.default_rng(seed)
                noise = rng.normal(0.0, sd, (n_sim, int(n)))
                t = lambda x: x.mean(1) / (x.std(1, ddof=1) / np.sqrt(x.shape[1]))
                critical = np.quantile(np.abs(t(noise)), 1 - alpha)
                out.append(float((np.abs(t(rng.normal(0.0, sd, (n_sim, int(n))) + effect)) > critical).mean()))
            yield pdf.assign(power=out)

    return designs.select("effect", "noise_sd", "n_items").mapInPandas(run, "effect double, noise_sd double, n_items long, power double")


def log_factorial(m: Column) -> Column:
    """ln(m!) of a whole number from 0: the factorial itself up to 20, and Stirling's series beyond, which is exact to a double there."""
    x = m.cast("double")
    stirling = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(m <= 20, F.log(F.factorial(F.least(m, F.lit(20)).cast("int")).cast("double"))).otherwise(stirling)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X >= k) of a binomial, for p between 0 and 1, from terms in closed form.

    Terms fall off at both sides of n p by Hoeffding's bound exp(-2 w^2 / n) at w places away, and no slower beyond a k above
    it. Those with a bound under 1e-20 of the sum cannot move a double and are not added: about 10 sqrt(n) terms are.
    """
    k, n = F.greatest(k.cast("long"), F.lit(0).cast("long")), n.cast("long")
    term = lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) + i * F.log(F.lit(p)) + (n - i) * F.log(F.lit(1 - p)))
    wide = F.ceil(F.sqrt(n * (math.log(1e20) / 2))) + 1
    begin, end = F.greatest(k, F.floor(n * p) - wide), F.least(n, F.greatest(k, F.ceil(n * p)) + wide)
    total = F.aggregate(F.transform(F.sequence(F.least(begin, n), F.greatest(end, F.least(begin, n))), term), F.lit(0.0), lambda t, x: t + x)
    return F.when(k > n, 0.0).otherwise(F.least(F.lit(1.0), total))
