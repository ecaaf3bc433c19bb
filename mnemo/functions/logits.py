"""Array kernels over logits and log-probabilities of one position, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = -30.0
SPREAD_FLOOR = 1e-6


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def log_softmax(logits: Column) -> Column:
    """Stable log-softmax of an array of doubles; null where a logit is not finite."""
    finite = F.forall(logits, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300))
    high = F.array_max(logits)
    shift = high + F.log(_sum(F.transform(logits, lambda x: F.exp(x - high))))
    return F.when(finite & (F.size(logits) > 0), F.transform(logits, lambda x: x - shift))


def entropy(logprobs: Column) -> Column:
    """Entropy in nats of a distribution given as log-probabilities."""
    return -_sum(F.transform(logprobs, lambda lp: F.exp(lp) * lp))


def rank_of(values: Column, index: Column) -> Column:
    """1-based rank of an entry from the top; ties share the best rank."""
    mine = F.get(values, index)
    return F.size(F.filter(values, lambda x: x > mine)) + 1


def top_k(values: Column, k: int) -> Column:
    """The k greatest as (id, value), by falling value, ties by id."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("down"), i.alias("id"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["id"].alias("id"), p["value"].alias("value")))


def top_k_mass(logprobs: Column, k: int) -> Column:
    """Probability that the k likeliest entries hold."""
    return _sum(F.transform(F.slice(F.sort_array(logprobs, asc=False), 1, k), F.exp))


def clipped(logprob: Column, floor: float = CLIP) -> Column:
    return F.greatest(logprob, F.lit(floor))


def position_z(logprob: Column, alternatives: Column) -> Column:
    """z of the clipped log-probability against its alternatives' mean and population spread (floored)."""
    n = F.size(alternatives)
    mean = _sum(alternatives) / n
    variance = _sum(F.transform(alternatives, lambda x: (x - mean) * (x - mean))) / n
    return F.when(n > 0, (clipped(logprob) - mean) / F.greatest(F.sqrt(variance), F.lit(SPREAD_FLOOR)))


def bottom_mean(values: Column, share: float) -> Column:
    """Mean of the smallest max(1, floor(n * share)) entries."""
    n = F.greatest(F.lit(1), F.floor(F.size(values) * F.lit(share)).cast("int"))
    return F.when(F.size(values) > 0, _sum(F.slice(F.sort_array(values), F.lit(1), n)) / n)


def combine(target: Column, strong: Column, weak: Column, weight: float) -> Column:
    """Logits of a target moved along the difference of two reference models."""
    pairs = F.zip_with(strong, weak, lambda a, b: a - b)
    return F.zip_with(target, pairs, lambda t, d: t + F.lit(weight) * d)


def argmax(values: Column) -> Column:
    """Index of the greatest entry, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
