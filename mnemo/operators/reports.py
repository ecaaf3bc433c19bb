"""Report tables of a study: gaps by block resamples, planned denominators, checks of stored results, matched samples.

Resamples are in hash mode (see `resample`). Rows are summed by unit (month, quarter, item) first, so a replicate draws
units and carries sums; a unit is a row, however many draws it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import consensus, inference, metrics, study
from .corpus import largest_remainder
from .resample import hash_uniform, permutation_test

def block_sums(units: DataFrame, order: str, sums: Sequence[str], length: int | str, n_reps: int, by: Sequence[str] = ()) -> DataFrame:
    """by, rep and sums over as many units as a group has, drawn in moving blocks of length units (a number or a column)."""
    whole = Window.partitionBy(*by)
    wanted = F.lit(length) if isinstance(length, int) else F.col(length)
    placed = units.select(*by, *[F.col(c).cast("double").alias(c) for c in sums], wanted.alias("_wanted"), (F.row_number().over(whole.orderBy(order)) - 1).alias("_place"), F.count("*").over(whole).alias("_n"))
    sizes = placed.groupBy(*by).agg(F.first("_n").alias("_n"), F.least(F.first("_wanted"), F.first("_n")).alias("_length"))
    blocks = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_reps - 1)))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / F.col("_length")).cast("int") - 1)))
    start = F.pmod(hash_uniform(*map(F.col, by), F.col("rep"), F.col("_block")), F.col("_n") - F.col("_length") + 1)
    slots = blocks.withColumn("_start", start).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_length").cast("int") - 1))).filter("_block * _length + _k < _n")
    drawn = slots.select(*by, "rep", (F.col("_start") + F.col("_k")).alias("_place")).join(placed.select(*by, "_place", *sums), [*by, "_place"])
    return drawn.groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in sums])


def _ends(value: Column, confidence: float) -> Column:
    a = (1 - confidence) / 2
    return F.percentile(value, F.array(F.lit(a), F.lit(1 - a)))


def change_outcomes(items: DataFrame, by: Sequence[str], period: str, raw: str, adjusted: str, tolerance: float, length: int, n_reps: int, confidence: float = 0.95) -> DataFrame:
    """by, n, mean_absolute, low, high, signed_mean, signed_low, signed_high, flips, dropped and outcome of what an adjustment changes.

    Periods without a computable item stay among those drawn; a replicate of such periods alone is dropped and counted.
    The outcome is 'unchanged' if the interval lies below the tolerance, 'changed' if above, else 'inconclusive', and
    'missing' without a computable item.
    """
    d = (F.col(adjusted) - F.col(raw)).cast("double")
    flips = d.isNotNull() & (F.signum(F.col(adjusted).cast("double")) != F.signum(F.col(raw).cast("double")))
    units = items.groupBy(*by, period).agg(F.coalesce(F.sum(F.abs(d)), F.lit(0.0)).alias("_abs"), F.coalesce(F.sum(d), F.lit(0.0)).alias("_sum"), F.count(d).alias("_items"), F.count_if(flips).alias("_flips"))
    n = F.sum("_items")
    point = units.groupBy(*by).agg(n.alias("n"), F.try_divide(F.sum("_abs"), n).alias("mean_absolute"), F.try_divide(F.sum("_sum"), n).alias("signed_mean"), F.sum("_flips").alias("flips"))
    again = block_sums(units, period, ["_abs", "_sum", "_items"], length, n_reps, by)
    found = again.groupBy(*by).agg(
        _ends(F.try_divide("_abs", "_items"), confidence).alias("_a"), _ends(F.try_divide("_sum", "_items"), confidence).alias("_s"), F.count_if(F.col("_items") == 0).alias("dropped")
    )
    out = point.join(found, list(by)).select(
        *by, "n", "mean_absolute", F.col("_a")[0].alias("low"), F.col("_a")[1].alias("high"), "signed_mean", F.col("_s")[0].alias("signed_low"), F.col("_s")[1].alias("signed_high"), "flips", "dropped"
    )
    outcome = F.when(F.col("n") == 0, "missing").when(F.col("high") < tolerance, "unchanged").when(F.col("low") > tolerance, "changed").otherwise("inconclusive")
    return out.withColumn("outcome", outcome)


def half_ensemble_interval(items: DataFrame, by: Sequence[str], order: str, a: str, b: str, x: str, y: str, n_reps: int, confidence: float = 0.95) -> DataFrame:
    """by, n, ratio, low, high, p, dropped and unbounded: variance between half ensembles a, b over that between single draws x, y.

    A replicate whose single draws agree everywhere is dropped if the halves do too, else unbounded: it counts as one
    and above, and the interval is null where its upper end would fall on such. Null ratio: single draws never differ.
    """
    complete = items.dropna(subset=[a, b, x, y])
    units = complete.select(*by, order, F.pow(F.col(a) - F.col(b), 2).alias("_h"), F.pow(F.col(x) - F.col(y), 2).alias("_s"))
    point = units.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.sum("_h"), F.sum("_s")).alias("ratio"))
    again = block_sums(units, order, ["_h", "_s"], 1, n_reps, by)
    ratio, free = F.try_divide("_h", "_s"), (F.col("_s") == 0) & (F.col("_h") > 0)
    held = F.when(free, F.lit(float("inf"))).otherwise(ratio)
    found = again.withColumn("_r", held).groupBy(*by).agg(
        _ends(F.when(free, F.lit(1e300)).otherwise(ratio), confidence).alias("_e"), F.count("_r").alias("_kept"), F.count_if(free).alias("unbounded"), F.count_if(F.col("_r").isNull()).alias("dropped"), F.count_if(F.col("_r") >= 1).alias("_high")
    )
    bounded = F.ceil((F.col("_kept") - 1) * (1 - (1 - confidence) / 2)) < F.col("_kept") - F.col("unbounded")
    known = F.col("ratio").isNotNull()
    return point.join(found, list(by)).select(
        *by, "n", "ratio", F.when(known & bounded, F.col("_e")[0]).alias("low"), F.when(known & bounded, F.col("_e")[1]).alias("high"), F.when(known, (1 + F.col("_high")) / (1 + F.col("_kept"))).alias("p"), "dropped", "unbounded"
    )


def period_gap(units: DataFrame, by: Sequence[str], unit: str, inside: str, value: str, length: int, n_reps: int, confidence: float = 0.95) -> DataFrame:
    """by, n_inside, n_after, mean_inside, mean_after, difference, block, low, high, standard_error and p (two-sided).

    units has one row for a unit, inside is 1 or 0. Each side is resampled by blocks on its own; the block is one unit
    long where a side has fewer units than length. A group with one side only has no difference.
    """
    rows = units.filter(F.col(value).isNotNull()).select(*by, unit, F.col(inside).cast("int").alias("_in"), F.col(value).cast("double").alias("_v"), F.lit(1.0).alias("_one"))
    side = lambda k, c: F.avg(F.when(F.col("_in") == k, F.col(c)))
    sizes = rows.groupBy(*by).agg(F.count_if(F.col("_in") == 1).alias("n_inside"), F.count_if(F.col("_in") == 0).alias("n_after"), side(1, "_v").alias("mean_inside"), side(0, "_v").alias("mean_after"))
    sizes = sizes.withColumn("difference", F.col("mean_inside") - F.col("mean_after")).withColumn("block", F.when(F.least("n_inside", "n_after") < length, 1).otherwise(length))
    again = block_sums(rows.join(sizes.select(*by, "block"), list(by)), unit, ["_v", "_one"], "block", n_reps, [*by, "_in"])
    mean = lambda k: F.max(F.when(F.col("_in") == k, F.col("_v") / F.col("_one")))
    gaps = again.groupBy(*by, "rep").agg((mean(1) - mean(0)).alias("_gap"))
    found = gaps.groupBy(*by).agg(_ends(F.col("_gap"), confidence).alias("_e"), F.stddev_samp("_gap").alias("standard_error"), inference.two_sided(F.col("_gap")).alias("_p"))
    known = F.col("difference").isNotNull()
    return sizes.join(found, list(by)).select(
        *by, "n_inside", "n_after", "mean_inside", "mean_after", "difference", "block", F.col("_e")[0].alias("low"), F.col("_e")[1].alias("high"), "standard_error", F.when(known, F.col("_p")).alias("p")
    )


def cutoff_cells(draws: DataFrame, by: Sequence[str], month: str, inside: str, value: str, length: int, n_reps: int, least: int, alpha: float = 0.05) -> DataFrame:
    """by, the gap of months inside and after the cutoff, a one-sided permutation p, passes, and reason.

    A month's estimate is the mean of its draws. With fewer than least months on a side there are counts and a reason alone.
    """
    months = draws.groupBy(*by, month, inside).agg(F.avg(value).alias("_estimate")).filter("_estimate IS NOT NULL")
    gap = period_gap(months, by, month, inside, "_estimate", length, n_reps).drop("p")
    test = permutation_test(months, by, month, "_estimate", inside, n_reps).select(*by, "p")
    few = F.least("n_inside", "n_after") < least
    out = gap.join(test, list(by), "left")
    kept = [F.when(~few, F.col(c)).alias(c) for c in ("mean_inside", "mean_after", "difference", "block", "low", "high", "standard_error", "p")]
    return out.select(*by, "n_inside", "n_after", *kept, F.when(~few, (F.col("difference") > 0) & (F.col("p") < alpha)).alias("passes"), F.when(few, "few months").otherwise("").alias("reason"))


def analysed(units: DataFrame, family: Sequence[str], variant: str, unit: str, inside: str, value: str, length: int, n_reps: int) -> DataFrame:
    """The gap of each variant with Holm's p over the variants of its family that have one."""
    return metrics.holm(period_gap(units, [*family, variant], unit, inside, value, length, n_reps), "p", variant, list(family))


def planned_scores(items: DataFrame, scores: DataFrame, by: Sequence[str], item: str, arm: str, arms: Sequence[str], status: str, error: str) -> DataFrame:
    """by, arm, planned, parsed, abstained, invalid, failed, unperformed and mean_error; every planned item counts in every arm."""
    grid = items.select(*by, item).withColumn(arm, F.explode(F.array(*map(F.lit, arms))))
    rows = grid.join(scores.select(item, arm, status, error), [item, arm], "left").withColumn("_s", F.coalesce(F.col(status), F.lit("unperformed")))
    states = ("parsed", "abstained", "invalid", "failed", "unperformed")
    return rows.groupBy(*by, arm).agg(F.count("*").alias("planned"), *[F.count_if(F.col("_s") == s).alias(s) for s in states], F.avg(F.when(F.col("_s") == "parsed", F.col(error))).alias("mean_error"))


def cutoff_contrast(items: DataFrame, scores: DataFrame, by: Sequence[str], item: str, cohort: str, arm: str, status: str, error: str, identified: str, anonymous: str) -> DataFrame:
    """by, pairs_pre, pairs_post, advantage_pre, advantage_post and contrast (pre less post) over pairs with both arms parsed."""
    pairs = study.paired_advantage(scores, [item], arm, status, error, identified, anonymous)
    rows = items.select(*by, item, cohort).join(pairs, item, "left")
    side = lambda c: F.when(F.col(cohort) == c, F.col("advantage"))
    out = rows.groupBy(*by).agg(F.count(side("pre")).alias("pairs_pre"), F.count(side("post")).alias("pairs_post"), F.avg(side("pre")).alias("advantage_pre"), F.avg(side("post")).alias("advantage_post"))
    return out.withColumn("contrast", F.col("advantage_pre") - F.col("advantage_post"))


def answer_variety(draws: DataFrame, item: Sequence[str], answer: str, planned: int, least: int) -> DataFrame:
    """item, n_answers (different answers) and state: incomplete (fewer or more draws than planned), few (parsed), analysed."""
    counts = draws.groupBy(*item).agg(F.count("*").alias("_n"), F.count(answer).alias("_parsed"), F.countDistinct(answer).alias("n_answers"))
    state = F.when(F.col("_n") != planned, "incomplete").when(F.col("_parsed") < least, "few").otherwise("analysed")
    return counts.select(*item, "n_answers", state.alias("state"))


def matched_size(candidates: DataFrame, stratum: Sequence[str], key: str, tokens: str, target: int, salt: str) -> DataFrame:
    """Rows of candidates whose tokens come near to target, in the candidates' own proportions of strata; with quota.

    Quotas go by largest remainder. Of each stratum the prefix in hash order that is nearest to its quota is taken (the
    shorter of two equally near). Running sums go over ranges of the hash first, so that no stratum is sorted in one task.
    """
    rows = candidates.withColumn("_h", hash_uniform(F.lit(salt), F.col(key))).withColumn("_range", F.shiftright("_h", 20))
    parts = rows.groupBy(*stratum, "_range").agg(F.sum(tokens).alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*stratum).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = largest_remainder(parts.groupBy(*stratum).agg(F.sum("_t").alias("_t")), stratum, "_t", target).select(*stratum, "quota")
    inner = F.sum(tokens).over(Window.partitionBy(*stratum, "_range").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.join(parts.select(*stratum, "_range", before.alias("_before")), [*stratum, "_range"]).withColumn("_upto", F.col("_before") + inner).join(quotas, list(stratum))
    near = placed.groupBy(*stratum).agg(F.least(F.min(F.struct(F.abs(F.col("_upto") - F.col("quota")).alias("d"), F.col("_upto").alias("at"))), F.struct(F.first("quota").cast("long").alias("d"), F.lit(0).cast("long").alias("at"))).alias("_best"))
    return placed.join(near, list(stratum)).filter("_upto <= _best.at").select(*candidates.columns, "quota")


def catalogue_filter(entries: DataFrame, mode: str | None = None, status: str | None = None) -> DataFrame:
    """Entries of a catalogue (entry, grp, mode, available, status), by a mode that is available, a status in any mode, or a status in a mode."""
    rows = entries if mode is None else entries.filter(F.col("mode") == mode)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    elif mode is not None:
        rows = rows.filter("available")
    return rows.select("entry").distinct()


def catalogue_related(entries: DataFrame, asked: DataFrame, block: int = 8192, run: int = 256) -> DataFrame:
    """entry, other: the other entries of the group of each entry asked for.

    The rows grow with the square of a group, so what each costs is kept small. A group is dealt into cells of about `block`
    asked entries and a quarter as many others, which travel as arrays and are paired in their task; tasks grow with the pairs.
    Others come in runs of `run` (a multiple of 8, as a writer packs them), each of which is repeated for one entry after
    another: of so short a period a file keeps little, however many cells a task holds.
    """
    spark = entries.sparkSession
    members = entries.filter("grp IS NOT NULL").select("entry", "grp").distinct()
    marked = members.join(asked.select("entry").distinct().withColumn("_asked", F.lit(True)), "entry", "left")
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = marked.groupBy("grp").agg(F.count("entry").alias("_n"), F.count("_asked").alias("_m")).filter("_m > 0")
    sizes = sizes.withColumns({"_blocks": parts("_m", block), "_cells": parts("_n", max(1, block // 4))})
    cells, pairs = sizes.agg(F.sum(F.col("_blocks").cast("long") * F.col("_cells")), F.sum(F.col("_m") * F.col("_n"))).first()
    tasks = max(1, min(cells or 0, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (pairs or 0) >> 26)))
    dealt = marked.join(sizes.drop("_n", "_m"), "grp")
    place = lambda n: F.pmod(F.xxhash64("entry"), F.col(n)).cast("int")
    key = ["grp", "_block", "_cell"]
    # a number of tasks is asked for, as arrays that are few before they are paired would be joined into few tasks
    others = dealt.groupBy("grp", place("_cells").alias("_cell")).agg(F.collect_list("entry").alias("_others"), F.sequence(F.lit(0), F.first("_blocks") - 1).alias("_at"))
    others = others.select("grp", "_others", "_cell", F.explode("_at").alias("_block")).repartition(tasks, *key)
    sought = dealt.filter("_asked").groupBy("grp", place("_blocks").alias("_block")).agg(F.collect_list("entry").alias("_entries"), F.sequence(F.lit(0), F.first("_cells") - 1).alias("_at"))
    sought = sought.select("grp", "_entries", "_block", F.explode("_at").alias("_cell")).repartition(tasks, *key)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_others") - 1) / run).cast("int")), lambda k: F.slice("_others", k * run + 1, run))
    met = others.join(sought.hint("merge"), key).select("_entries", F.explode(runs).alias("_run"))
    return met.select(F.explode("_entries").alias("entry"), "_run").select("entry", F.explode("_run").alias("other")).filter("entry <> other")


def aligned_estimates(a: DataFrame, b: DataFrame, prompt: str, draw: str, value: str) -> DataFrame:
    """prompt, n, a and b: means over the draws that carry a value on both sides."""
    both = a.select(prompt, draw, F.col(value).alias("_a")).join(b.select(prompt, draw, F.col(value).alias("_b")), [prompt, draw]).dropna(subset=["_a", "_b"])
    return both.groupBy(prompt).agg(F.count("*").alias("n"), F.avg("_a").alias("a"), F.avg("_b").alias("b"))


def admitted(results: DataFrame, planned: DataFrame, pilot: DataFrame, key: str) -> DataFrame:
    """key, n and state of results: pilot (excluded), unplanned, repeated, or kept."""
    counts = results.groupBy(key).agg(F.count("*").alias("n"))
    marked = counts.join(pilot.select(key, F.lit(True).alias("_pilot")).distinct(), key, "left").join(planned.select(key, F.lit(True).alias("_planned")).distinct(), key, "left")
    state = F.when(F.col("_pilot"), "pilot").when(F.col("_planned").isNull(), "unplanned").when(F.col("n") > 1, "repeated").otherwise("kept")
    return marked.select(key, "n", state.alias("state"))


def recomputed(stored: DataFrame, again: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """column, n, missing (on one side alone) and different: whether stored columns equal a recomputation; nulls equal each other."""
    left = stored.select(*keys, F.struct(*columns).alias("_a"))
    both = left.join(again.select(*keys, F.struct(*columns).alias("_b")), list(keys), "full")
    one = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"_a.{c}").cast("double").alias("a"), F.col(f"_b.{c}").cast("double").alias("b"))
    missing = F.col("_a").isNull() | F.col("_b").isNull()
    long = both.select(missing.alias("_m"), F.explode(F.array(*map(one, columns))).alias("_c")).select("_m", "_c.*")
    differs = ~F.col("_m") & ~(F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)))
    return long.groupBy("column").agg(F.count("*").alias("n"), F.count_if("_m").alias("missing"), F.count_if(differs).alias("different"))


def tilts(loadings: Mapping[str, Column]) -> dict[str, Column]:
    """The tilt of each asset class: its exposures times the loadings."""
    total = lambda row: sum((w * loadings[axis] for axis, w in row.items()), F.lit(0.0))
    return {asset: total(row) for asset, row in study.EXPOSURE.items()}


def between(lines: Column, starts: Sequence[str], end: str) -> Column:
    """Lines from the first that begins with one of starts to the first at or after it that begins with end; null if one is not there."""
    begins = lambda x: F.array_max(F.transform(F.array(*map(F.lit, starts)), lambda s: x.startswith(s)))
    first = F.array_position(F.transform(lines, lambda x: F.coalesce(begins(x), F.lit(False))), True)
    tail = F.when(first > 0, F.slice(lines, first.cast("int"), F.greatest(F.size(lines), F.lit(1))))
    last = F.array_position(F.transform(tail, lambda x: F.coalesce(x.startswith(end), F.lit(False))), True)
    return F.when(last > 0, F.slice(tail, F.lit(1), last.cast("int")))


def number_places(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """text_id, place and number of the whole numbers that stand on their own in each text, without leading zeros."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?<![0-9A-Za-z.])([0-9]+)(?![0-9A-Za-z])"), 1)
    return texts.select(text_id, F.posexplode(found).alias("place", "_raw")).select(text_id, "place", F.regexp_replace("_raw", "^0+(?=[0-9])", "").alias("number"))


def ordered_leaks(places: DataFrame, series: DataFrame, text_id: str, series_id: str, longest: int, span: int) -> DataFrame:
    """series_id, text_id of the series (series_id, k from 1, number) whose numbers stand in order in a text, each within span of the one before.

    From every start the next number's nearest later place is taken. States of one last place are one row, and places
    meet within ranges of span places, so a text of many numbers is spread. Series are at most longest numbers long.

    A series is looked for only in the texts that hold the number of it that is rarest in all texts, so a number that many
    texts and series share brings none of them together.
    """
    known = places.groupBy("number").agg(F.count("*").alias("_n"))
    rarest = series.join(known, "number", "left").groupBy(series_id).agg(F.min_by("number", F.struct(F.coalesce("_n", F.lit(0)), "number")).alias("number"))
    pairs = places.select(text_id, "number").distinct().join(rarest, "number").select(text_id, series_id)
    hits = pairs.join(series, series_id).join(places, [text_id, "number"]).select(text_id, series_id, "k", "place", F.floor(F.col("place") / span).alias("_range"))
    sizes = series.groupBy(series_id).agg(F.max("k").alias("_size"))
    state = hits.filter("k = 1").select(text_id, series_id, F.col("place").alias("_last"))
    ended = None
    for k in range(1, longest + 1):
        done = state.join(sizes.filter(F.col("_size") == k), series_id).select(series_id, text_id).distinct()
        ended = done if ended is None else ended.unionByName(done)
        if k < longest:
            here = state.withColumn("_range", F.explode(F.array(F.floor(F.col("_last") / span), F.floor(F.col("_last") / span) + 1)))
            following = here.join(hits.filter(F.col("k") == k + 1).drop("k"), [text_id, series_id, "_range"]).filter((F.col("place") > F.col("_last")) & (F.col("place") - F.col("_last") <= span))
            state = following.groupBy(text_id, series_id, "_last").agg(F.min("place").alias("_next")).select(text_id, series_id, F.col("_next").alias("_last")).distinct()
    return ended


def cost_report(snapshots: DataFrame, key: Sequence[str], at: Sequence[str], amount: str, seconds: str, rate: float) -> DataFrame:
    """key, elapsed_cost (largest elapsed time by rate), billed (the latest snapshot, which replaces those before) and higher of both."""
    out = snapshots.groupBy(*key).agg((F.max(seconds) * rate / 3600.0).alias("elapsed_cost"), F.max_by(amount, F.struct(*at)).alias("billed"))
    return out.withColumn("bound", F.greatest("elapsed_cost", "billed"))


def worst_case(draws: Column, workers: Column, retries: Column, reference: Column, seconds: Column) -> dict[str, Column]:
    """requests and seconds of an ensemble at worst: each draw with all its retries, twice with a reference, in waves of the workers."""
    each = (retries + 1) * F.when(reference, 2).otherwise(1)
    return {"requests": draws * each, "seconds": F.ceil(draws / workers) * each * seconds}


def shortlist(replies: DataFrame, model: str, place: str, order: str, status: str, parsed: Column, size: int = 10) -> DataFrame:
    """model, place, passed, reason and selected of every candidate: the first `size`, by place, whose replies are all good.

    The reason is the status of the first reply, by order, whose status is not 'ok' (null: 'error'), else 'parse_failure'
    if one was not parsed. The first ones are found by a bounded sort, of which at most `size` rows are broadcast.
    """
    state = F.coalesce(F.col(status), F.lit("error"))
    failed = state != "ok"
    outcomes = replies.groupBy(model).agg(F.min(place).alias("place"), F.min_by(F.when(failed, state), F.when(failed, F.col(order))).alias("failure"), F.bool_and(F.coalesce(parsed, F.lit(False))).alias("all_parsed"))
    reason = F.coalesce("failure", F.when(~F.col("all_parsed"), "parse_failure"))
    out = outcomes.select(model, "place", reason.isNull().alias("passed"), reason.alias("reason"))
    first = out.filter("passed").orderBy("place", model).limit(size).select(model, F.lit(True).alias("selected"))
    return out.join(F.broadcast(first), model, "left").fillna(False, ["selected"])


def reduced_components(draws: DataFrame, item: Sequence[str], component: str, value: str, grid: str, **split: float) -> DataFrame:
    """item, component, n, adherence, separated and location (trimmed mean) of each component; none where its draws are split."""
    keys = [*item, component]
    rows = draws.filter(F.col(value).isNotNull())
    located = consensus.robust_location(rows, keys, value).select(*keys, "n", "trimmed")
    verdict = consensus.split_search(rows, keys, value, grid, **split).select(*keys, "separated")
    out = located.join(verdict, keys).join(consensus.grid_adherence(rows, keys, value, grid), keys)
    return out.select(*keys, "n", "adherence", "separated", F.when(~F.coalesce("separated", F.lit(False)), F.col("trimmed")).alias("location"))


def two_sample_power(designs: DataFrame, n_sim: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Power of a two-sided pooled t test for each design (effect, noise_sd, n_a, n_b), with a simulated critical value.

    The noise of the power runs is drawn apart from that of the critical value. Means and the pooled variance are drawn
    from their own distributions, so a design costs n_sim draws whatever its sizes. Null power: a side under two, no noise.
    """

    def power(effect: float, sd: float, n_a: int, n_b: int) -> float | None:
        if n_a < 2 or n_b < 2 or not sd > 0:
            return None
        rng = np.random.default_rng(seed)

        def t(shift: float) -> np.ndarray:
            x, y = rng.normal(shift, sd / n_a**0.5, n_sim), rng.normal(0.0, sd / n_b**0.5, n_sim)
            pooled = sd * sd * rng.chisquare(n_a + n_b - 2, n_sim) / (n_a + n_b - 2)
            return np.abs(x - y) / np.sqrt(pooled * (1 / n_a + 1 / n_b))

        critical = np.quantile(t(0.0), 1 - alpha)
        return float((t(effect) > critical).mean())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(power=[power(float(e), float(s), int(a), int(b)) for e, s, a, b in pdf.itertuples(index=False)])

    return designs.select("effect", "noise_sd", "n_a", "n_b").dropna().mapInPandas(run, "effect double, noise_sd double, n_a long, n_b long, power double")


def power_gate(powers: DataFrame, threshold: float) -> DataFrame:
    """powers with state: passed or refused against the plan's threshold, or unknown."""
    return powers.withColumn("state", F.when(F.col("power").isNull(), "unknown").when(F.col("power") >= threshold, "passed").otherwise("refused"))
