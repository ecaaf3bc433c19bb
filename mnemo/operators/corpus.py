"""Corpus building: labels by cutoff, deduplication, quotas, stratified samples, splits and nearest matches.

Seeded choices are by hash: a row's place in a random order is the MD5 of a salt and its key, so that a choice does not
depend on partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection


def hash_order(key: Column, salt: str) -> Column:
    """A pseudo-random order: hexadecimal digits of the MD5 of salt and key."""
    return F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))


def cutoff_label(day: Column, earliest: Column, latest: Column, boundary: str, today: Column | None = None) -> Column:
    """1 before the earliest cutoff, 0 after the latest (and not after today), null between.

    boundary names what the cutoff day itself is: 'in_sample', 'dropped' or 'post'.
    """
    if boundary not in ("in_sample", "dropped", "post"):
        raise ValueError("boundary is 'in_sample', 'dropped' or 'post'")
    inside = day <= earliest if boundary == "in_sample" else day < earliest
    after = day >= latest if boundary == "post" else day > latest
    if today is not None:
        after = after & (day <= today)
    return F.when(inside, 1).when(after, 0)


def dedup_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, in an order, of each value of the keys, one key after another.

    A row is dropped if an earlier one that survived the keys before has its value. Nulls are values of no key.
    """
    for k in keys:
        # an aggregate, not a window: rows of a hot value meet in partial results
        named = rows.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")
        rows = named.unionByName(rows.filter(F.col(k).isNull()))
    return rows


def dedup_greedy(rows: DataFrame, a: str, b: str, order: Sequence[str]) -> DataFrame:
    """Accept rows in order; a row goes if an accepted one before it has its value of a or of b (see selection.accept)."""
    return selection.accept(rows, [a, b], order).filter("outcome = 'accepted'").select(*rows.columns)


def hash_ranked(rows: DataFrame, stratum: Sequence[str], key: str, salt: str) -> DataFrame:
    """rows with _rank, the place of a row in its stratum's hash order (from 1), and _size, the rows of the stratum.

    A stratum is cut into 4096 ranges of the hash, which are counted first: no window holds more than one range of one
    stratum. Nulls are a stratum of their own.
    """
    spread = rows.withColumn("_hash", hash_order(F.col(key), salt)).withColumn("_range", F.substring("_hash", 1, 3))
    parts = spread.groupBy(*stratum, "_range").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*stratum)
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(stratum)], F.col("_range").alias("_part"), before.alias("_before"), F.sum("_c").over(whole).alias("_size"))
    same = F.col("_range") == F.col("_part")
    for i, c in enumerate(stratum):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    inner = F.row_number().over(Window.partitionBy(*stratum, "_range").orderBy("_hash", key))
    return spread.withColumn("_inner", inner).join(parts, same).select(*rows.columns, (F.col("_before") + F.col("_inner")).alias("_rank"), "_size")


def stratified_sample(rows: DataFrame, stratum: Sequence[str], key: str, size: int, salt: str) -> DataFrame:
    """About `size` rows, in proportion to the strata and one of each at least, in hash order."""
    sizes = rows.groupBy(*stratum).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    quota = sizes.join(F.broadcast(total)).select(*stratum, F.greatest(F.lit(1), F.round(F.col("_n") * size / F.col("_t"))).cast("long").alias("_quota"))
    return hash_ranked(rows, stratum, key, salt).join(quota, list(stratum)).filter("_rank <= _quota").select(*rows.columns)


def largest_remainder(strata: DataFrame, key: Sequence[str], weight: str, total: int) -> DataFrame:
    """Whole quotas that sum to `total`, in proportion to a weight; what is left goes to the largest remainders.

    strata has one row for a stratum, and the window over all of them is as small as that.
    """
    whole = Window.partitionBy(F.lit(0))
    exact = F.col(weight) * total / F.sum(weight).over(whole)
    rows = strata.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("long"))
    order = whole.orderBy((F.col("_exact") - F.col("_floor")).desc(), *key)
    left = F.lit(total) - F.sum("_floor").over(whole)
    return rows.withColumn("quota", F.col("_floor") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).drop("_exact", "_floor")


def round_robin(rows: DataFrame, group: str, key: str, salt: str, cap: int) -> DataFrame:
    """At most `cap` rows of each group in hash order, with `turn`, the round in which a row is taken."""
    return hash_ranked(rows, [group], key, salt).filter(F.col("_rank") <= cap).select(*rows.columns, F.col("_rank").cast("int").alias("turn"))


def hash_split(rows: DataFrame, stratum: Sequence[str], key: str, salt: str, holdout: float) -> DataFrame:
    """rows with column held_out: of each stratum the first share in hash order."""
    return hash_ranked(rows, stratum, key, salt).select(*rows.columns, (F.col("_rank") <= F.round(F.col("_size") * holdout)).alias("held_out"))


def nearest_match(left: DataFrame, right: DataFrame, key: Sequence[str], left_id: str, left_value: str, right_id: str, right_value: str, band: float) -> DataFrame:
    """For each row of left the row of right with the nearest logarithm of its value, of equals the smaller id.

    A match farther than a band away is none. Equal values of a side are one row. The nearest value below and the nearest
    above are the last and the next in order: within a 64th of a band by a window, beyond it by the ends of the 64ths, so no
    row meets a whole band. Distances count to 12 decimals; all values at that distance are then looked up in cells that are
    but little wider than its rounding, and the smallest id of them stays.
    """
    step, cell = band / 64, 4e-12
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e300)
    a = left.select(*key, F.log(left_value).alias("_a")).filter(known("_a")).distinct()
    b = right.select(*key, F.col(right_id).alias("match_id"), F.log(right_value).alias("_b")).filter(known("_b")).groupBy(*key, "_b").agg(F.min("match_id").alias("match_id"))
    both = a.select(*key, F.col("_a").alias("_x"), F.lit(True).alias("_asks")).unionByName(b.select(*key, F.col("_b").alias("_x"), F.lit(False).alias("_asks")))
    both = both.withColumn("_step", F.floor(F.col("_x") / step)).withColumn("_b", F.when(~F.col("_asks"), F.col("_x")))
    inside = Window.partitionBy(*key, "_step").orderBy("_x")
    upto, onward = inside.rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key, "_step").orderBy(F.col("_x").desc()).rangeBetween(Window.unboundedPreceding, 0)
    placed = both.withColumns({"_below": F.max("_b").over(upto), "_above": F.min("_b").over(onward)}).filter("_asks")
    ends = both.groupBy(*key, "_step").agg(F.min("_b").alias("_low"), F.max("_b").alias("_high"))
    steps = Window.partitionBy(*key).orderBy("_step")
    ends = ends.select(*key, "_step", F.max("_high").over(steps.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_low").over(steps.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    placed = placed.join(ends, [*key, "_step"])
    least = F.least(F.col("_x") - F.coalesce("_below", "_before"), F.coalesce("_above", "_after") - F.col("_x"))
    nearest = placed.select(*key, F.col("_x").alias("_a"), least.alias("_least")).filter(F.col("_least") <= band).withColumn("distance", F.round("_least", 12))
    cells = [F.floor(x / cell) + d for x in (F.col("_a") - F.col("distance"), F.col("_a") + F.col("distance")) for d in (-1, 0, 1)]
    met = nearest.withColumn("_cell", F.explode(F.array_distinct(F.array(*cells)))).join(b.withColumn("_cell", F.floor(F.col("_b") / cell)), [*key, "_cell"])
    apart = F.abs(F.col("_a") - F.col("_b"))
    best = met.filter((apart <= band) & (F.round(apart, 12) == F.col("distance"))).groupBy(*key, "_a").agg(F.min("match_id").alias("match_id"), F.first("distance").alias("distance"))
    return left.select(*key, left_id, F.log(left_value).alias("_a")).join(best, [*key, "_a"], "left").select(*key, left_id, "match_id", "distance")


def leaks(texts: DataFrame, probes: DataFrame, text_id: str, text: str, probe_id: str, probe: str, size: int = 8) -> DataFrame:
    """(text, probe) pairs where a probe's run of `size` words stands in a text, and how many of its runs do.

    Both sides are exploded into runs of words and joined on the run's hash, after each side is made distinct.
    """
    runs = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - size, F.lit(0))), lambda i: F.xxhash64(F.slice(c, i + 1, size)))
    tokens = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    a = texts.select(text_id, tokens(F.col(text)).alias("_w")).filter(F.size("_w") >= size).select(text_id, F.explode(F.array_distinct(runs(F.col("_w")))).alias("_h"))
    b = probes.select(probe_id, tokens(F.col(probe)).alias("_w")).filter(F.size("_w") >= size).select(probe_id, F.explode(F.array_distinct(runs(F.col("_w")))).alias("_h"))
    sizes = b.groupBy(probe_id).agg(F.count("*").alias("n_runs"))
    hits = a.join(b, "_h").groupBy(text_id, probe_id).agg(F.count("*").alias("n_hits"))
    return hits.join(sizes, probe_id).select(text_id, probe_id, "n_hits", "n_runs")


def multiset_difference(original: DataFrame, candidate: DataFrame, keys: Sequence[str], token: str) -> DataFrame:
    """Tokens whose number differs between two texts, with both numbers."""
    a = original.groupBy(*keys, token).agg(F.count("*").alias("n_original"))
    b = candidate.groupBy(*keys, token).agg(F.count("*").alias("n_candidate"))
    both = a.join(b, [*keys, token], "full").fillna(0, ["n_original", "n_candidate"])
    return both.filter("n_original <> n_candidate")


def latest_version(log: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in an order, and when the key first appeared."""
    names = [c for c in log.columns if c not in key]
    place = F.struct(*order)
    out = log.groupBy(*key).agg(F.max_by(F.struct(*names), place).alias("_last"), F.min(place).alias("first_seen"))
    return out.select(*key, *[F.col(f"_last.{c}").alias(c) for c in names], "first_seen")
