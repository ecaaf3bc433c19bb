"""Study tables: paired arms, condition grids, funnels, calendar windows, bins and answer scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import calibrate, metrics, ordered
from .resample import bootstrap, hash_uniform

# fixed values: exposure of each asset class to each axis
EXPOSURE = {
    "world_equity": {"inflation": -0.3, "growth": 1.0, "credit_stress": -0.8, "policy": -0.3, "risk_appetite": 0.6},
    "tech_sector": {"inflation": -0.6, "growth": 1.0, "credit_stress": -0.7, "policy": -0.5, "risk_appetite": 0.8},
    "gold_commodity": {"inflation": 0.8, "growth": -0.4, "credit_stress": 0.7, "policy": 0.1, "risk_appetite": -0.5},
    "short_treasury_cash": {"inflation": 0.3, "growth": -0.6, "credit_stress": 0.6, "policy": 0.8, "risk_appetite": -0.6},
}
DEFENSIVE, RISK = ("gold_commodity", "short_treasury_cash"), ("world_equity", "tech_sector")
#: Exposure of the defensive classes less that of the others, by axis.
SPREAD = {axis: round(sum(EXPOSURE[c][axis] for c in DEFENSIVE) - sum(EXPOSURE[c][axis] for c in RISK), 9) for axis in EXPOSURE[RISK[0]]}


def pair_arms(rows: DataFrame, keys: Sequence[str], arm: str, value: str, first: object, second: object) -> DataFrame:
    """keys, a, b and reason: the two arms of each key; a key that lacks one is kept with what is missing."""
    side = lambda x: F.max(F.when(F.col(arm) == F.lit(x), F.col(value)))
    pairs = rows.filter(F.col(arm).isin(first, second)).groupBy(*keys).agg(side(first).alias("a"), side(second).alias("b"))
    missing = F.when(F.col("a").isNull() & F.col("b").isNull(), "both missing").when(F.col("a").isNull(), "first missing").when(F.col("b").isNull(), "second missing")
    return pairs.withColumn("reason", F.coalesce(missing, F.lit("")))


def paired_noise(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, n, mean and variance (null under two) of a less b over complete pairs."""
    d = (F.col("a") - F.col("b")).cast("double")
    return pairs.filter("reason = ''").groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.var_samp(d).alias("variance"))


def paired_effect(pairs: DataFrame, by: Sequence[str], order: str, n_reps: int, least: int = 3) -> DataFrame:
    """by, planned, n, point, low, high and status: unavailable (no pair), inadequate (fewer than least), degenerate (no spread), estimated."""
    keys = list(by)
    planned = pairs.groupBy(*keys).agg(F.count("*").alias("planned"))
    rows = pairs.filter("reason = ''").select(*keys, order, (F.col("a") - F.col("b")).cast("double").alias("d"))
    spread = rows.groupBy(*keys).agg(F.var_samp("d").alias("_v"))
    found = planned.join(bootstrap(rows, keys, order, "d", n_reps), keys, "left").join(spread, keys, "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "unavailable").when(n < least, "inadequate").when(F.coalesce(F.col("_v"), F.lit(0.0)) == 0, "degenerate").otherwise("estimated")
    bound = lambda c: F.when(status == "estimated", F.col(c))
    return found.select(*keys, "planned", n.alias("n"), "point", bound("low").alias("low"), bound("high").alias("high"), status.alias("status"))


def condition_rows(items: DataFrame, arms: DataFrame, draws: DataFrame, item: str, arm: str, usable: str, correct: str, confidence: str) -> DataFrame:
    """A row for each item and arm planned: draws, n_usable, n_correct, mean confidence of usable draws, and state.

    An item whose arm has no draw is incomplete, not wrong. arms is a table of a few rows.
    """
    ok = F.coalesce(F.col(usable), F.lit(False))
    done = draws.groupBy(item, arm).agg(F.count("*").alias("draws"), F.count_if(ok).alias("n_usable"), F.count_if(ok & F.col(correct)).alias("n_correct"), F.avg(F.when(ok, F.col(confidence))).alias("confidence"))
    grid = items.select(item).distinct().crossJoin(F.broadcast(arms.select(arm).distinct()))
    state = F.when(F.col("draws").isNull(), "incomplete").when(F.col("n_usable") == 0, "unusable").otherwise("usable")
    return grid.join(done, [item, arm], "left").withColumn("state", state).fillna(0, ["draws", "n_usable", "n_correct"])


def condition_summary(rows: DataFrame, arm: str) -> DataFrame:
    """arm, planned, complete, usable items, coverage, accuracy over usable items and over planned ones, mean confidence."""
    right = F.count_if((F.col("state") == "usable") & (F.col("n_correct") * 2 > F.col("n_usable")))
    usable = F.count_if(F.col("state") == "usable")
    return rows.groupBy(arm).agg(
        F.count("*").alias("planned"), F.count_if(F.col("state") != "incomplete").alias("complete"), usable.alias("usable"), (usable / F.count("*")).alias("coverage"),
        F.try_divide(right.cast("double"), usable.cast("double")).alias("accuracy_usable"), (right / F.count("*")).alias("accuracy_planned"), F.avg("confidence").alias("confidence"),
    )


def funnel(rows: DataFrame, states: Mapping[str, Column], accepted: str, by: Sequence[str] = ()) -> DataFrame:
    """by, state, n and share: each row is in the first state whose condition holds, else accepted."""
    state = F.lit(accepted)
    for name, holds in reversed(list(states.items())):
        state = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(state)
    counts = rows.select(*by, state.alias("state")).groupBy(*by, "state").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def shared_bins(rows: DataFrame, value: str, group: str, bins: int = 20) -> DataFrame:
    """group, bin and n over equal bins between the least and the greatest value of all groups; without spread the range is padded by one half."""
    kept = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ends = kept.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select(F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    bin_ = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    return kept.crossJoin(F.broadcast(ends)).groupBy(group, bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def buy_and_hold(closes: DataFrame, ticker: str, day: str, close: str) -> DataFrame:
    """ticker, day and value: the close over the ticker's first close; 1 where a close is missing."""
    first = closes.groupBy(ticker).agg(F.min_by(close, F.when(F.col(close).isNotNull(), F.col(day))).alias("_first"))
    return closes.join(first, ticker).select(ticker, day, F.coalesce(F.try_divide(F.col(close), F.col("_first")), F.lit(1.0)).alias("value"))


def quarters_between(first: Column, last: Column) -> Column:
    """The first days of the calendar quarters that touch the days from first to last; empty if last is before first."""
    begin, end = F.trunc(first, "quarter"), F.trunc(last, "quarter")
    return F.when(last >= first, F.sequence(begin, end, F.expr("interval 3 months"))).otherwise(F.array().cast("array<date>"))


def filing_windows(cutoffs: DataFrame, cutoff: str, start: str, today: str) -> DataFrame:
    """One row: the days before the earliest cutoff and those after the latest, and the quarters that each touches."""
    ends = cutoffs.agg(F.min(cutoff).alias("earliest"), F.max(cutoff).alias("latest"))
    first, last = F.lit(start).cast("date"), F.lit(today).cast("date")
    ends = ends.select("earliest", "latest", first.alias("exposed_from"), F.date_sub("earliest", 1).alias("exposed_to"), F.date_add("latest", 1).alias("control_from"), last.alias("control_to"))
    count = lambda a, b: F.size(quarters_between(F.col(a), F.col(b)))
    return ends.withColumns({"exposed_quarters": count("exposed_from", "exposed_to"), "control_quarters": count("control_from", "control_to")})


def sub_windows(rows: DataFrame, first: str, last: str, k: int) -> DataFrame:
    """rows with window, from and to: k windows of equal width that do not overlap; the last ends on last, and those beyond it are last alone."""
    width = F.greatest(F.floor(F.datediff(last, first) / k), F.lit(0)).cast("int")
    begin = F.date_add(F.col(first), F.col("window") * (width + 1))
    end = F.date_add(begin, width)
    out = rows.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return out.select(*rows.columns, "window", F.least(begin, F.col(last)).alias("from"), F.when(F.col("window") == k - 1, F.col(last)).otherwise(F.least(end, F.col(last))).alias("to"))


def defensive_spread(loadings: Mapping[str, Column]) -> Column:
    """How far loadings lean to the defensive assets; positive leans defensive."""
    total = F.lit(0.0)
    for axis, weight in SPREAD.items():
        total = total + weight * loadings[axis]
    return total


def leans(value: Column) -> Column:
    """Whether a spread is positive at nine decimals; zero counts as risk."""
    return F.round(value, 9) > 0


def final_span(tokens: Column, opening: Sequence[int], closing: Sequence[int]) -> Column:
    """begin, end and problem of the tokens between the one opening sequence and the closing token after it; places from 0, end exclusive."""
    size = len(opening)
    places = F.when(F.size(tokens) >= size, F.sequence(F.lit(0), F.size(tokens) - size)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        found = F.lit(True)
        for k, t in enumerate(opening):
            found = found & (F.get(tokens, i + k) == t)
        return found

    def span(starts: Column) -> Column:
        begin = F.get(starts, 0) + size
        ends = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: (i >= begin) & F.get(tokens, i).isin(*closing))
        end = F.get(ends, 0)
        problem = F.when(F.size(starts) == 0, "no span").when(F.size(starts) > 1, "several spans").when(end.isNull(), "open span").when(end == begin, "empty span").otherwise("")
        right = problem == ""
        return F.struct(F.when(right, begin).alias("begin"), F.when(right, end).alias("end"), problem.alias("problem"))

    return F.get(F.transform(F.array(F.filter(places, here)), span), 0)


def answer_scores(rows: DataFrame, predicted: str, actual: str, last: str, rebased: str, scale: str) -> DataFrame:
    """rows with the errors of a recalled close (relative, exact at two decimals) and of a forecast (log return by volatility)."""
    error = F.abs(F.col(predicted) / F.col(actual) - 1)
    observed = F.log(F.col(actual) / F.col(last))
    signed = F.log(F.col(predicted)) - F.log(F.col(rebased)) - observed
    cents = lambda c: F.round(F.col(c).cast("decimal(30,9)"), 2)
    return rows.withColumns(
        {"relative_error": error, "within_0_1_percent": error <= 0.001, "within_1_percent": error <= 0.01, "exact": cents(predicted) == cents(actual), "observed_return": observed, "signed_error": signed, "normalized_error": F.abs(signed) / F.col(scale), "unchanged_error": F.abs(observed) / F.col(scale)}
    )


def paired_advantage(rows: DataFrame, keys: Sequence[str], arm: str, status: str, error: str, identified: str, anonymous: str) -> DataFrame:
    """keys and advantage: the anonymous arm's error less the identified one's, null unless both are parsed."""
    parsed = rows.withColumn("_e", F.when(F.col(status) == "parsed", F.col(error)))
    pairs = pair_arms(parsed, keys, arm, "_e", identified, anonymous)
    return pairs.select(*keys, (F.col("b") - F.col("a")).alias("advantage"))


def rounded_means(rows: DataFrame, by: Sequence[str], value: str, order: str | None = None) -> DataFrame:
    """by and value, the mean of each group rounded to a whole number, the same however the rows are dealt.

    A sum of doubles depends on the order of its terms, which tells only where the mean is about halfway between two whole
    numbers. Such groups alone are summed again: as decimals, whose sum is exact, so that a half is a half; or, with an
    order, one row after another by a window that may spill. Values that no decimal holds keep the mean of doubles.
    """
    by = list(by)
    means = rows.groupBy(*by).agg(F.avg(value).alias("_mean"), F.avg(F.abs(value)).alias("_size"), F.count(value).alias("_n"))
    # the error of a sum grows with the size of its terms
    close = F.abs(F.col("_mean") - F.floor("_mean") - 0.5) < 1e-9 * F.greatest(F.lit(1.0), "_size")
    halves = means.filter(close).select(*by, F.col("_n").alias("_of"))
    met = ordered.match(rows.filter(F.col(value).isNotNull()), halves, by)
    if order is None:
        held = F.col(value).try_cast("decimal(38,18)")
        sums = met.groupBy(*by).agg(F.try_sum(held).alias("_sum"), F.count(held).alias("_held"), F.first("_of").alias("_of"))
        again = sums.filter("_held = _of").select(*by, F.round(F.col("_sum") / F.col("_of"), 0).cast("double").alias("_again"))
    else:
        running = F.sum(value).over(Window.partitionBy(*by).orderBy(order))
        again = met.select(*by, order, "_of", running.alias("_sum")).groupBy(*by).agg((F.max_by("_sum", order) / F.first("_of")).alias("_again"))
    return ordered.match(means, again, by, "left").select(*by, F.round(F.coalesce("_again", "_mean"), 0).alias(value))


def mid_rank_counts(rows: DataFrame, value: str, group: str, item: str) -> DataFrame:
    """group, rank and n: how often each mid-rank of a group's value among its item's values occurs."""
    ranked = ordered.average_ranks(rows, value, "rank", [item])
    return ranked.groupBy(group, "rank").agg(F.count("*").alias("n"))


def fold(key: Column, k: int, salt: str = "fold") -> Column:
    """The fold of a row, 0 to k - 1, by the hash of its key."""
    return F.pmod(hash_uniform(F.lit(salt), key), F.lit(k)).cast("int")


def feature_aucs(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, auc and sign (+1 if larger values mean label 1, an AUC of one half included, else -1)."""
    long = rows.select(label, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))).alias("_f")).select(label, "_f.*")
    return metrics.rank_auc(long, "value", label, ["feature"]).select("feature", "auc", F.when(F.col("auc") >= 0.5, 1).otherwise(-1).alias("sign"))


def signed_auc(frozen: DataFrame, held_out: DataFrame) -> DataFrame:
    """feature, sign, and the held-out AUC in the direction that the frozen split gave."""
    return held_out.select("feature", F.col("auc").alias("_auc")).join(frozen.select("feature", "sign"), "feature").select("feature", "sign", F.when(F.col("sign") == 1, F.col("_auc")).otherwise(1 - F.col("_auc")).alias("auc"))


def standardised(train: DataFrame, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """rows with their features standardised by the mean and population spread of train (a spread of 0 counts as 1)."""
    row = train.agg(*[x for f in features for x in (F.avg(f), F.stddev_pop(f))]).first()
    return rows.withColumns({f: (F.col(f) - float(row[2 * k] or 0.0)) / float(row[2 * k + 1] or 1.0) for k, f in enumerate(features)})


def fitted(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """rows with p of a standardised, balanced logistic calibrator fitted on train."""
    weights = calibrate.fit_logistic(standardised(train, train, features), features, label)
    return standardised(train, rows, features).withColumn("p_fitted", calibrate.predict(weights, features))


def cross_validated_auc(rows: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 5) -> DataFrame:
    """fold and auc of the calibrator on rows that it was not fitted on; fold null pools all of them."""
    told = rows.withColumn("_fold", fold(F.col(key), folds))
    parts = [fitted(told.filter(F.col("_fold") != k), told.filter(F.col("_fold") == k), features, label).select("_fold", label, "p_fitted") for k in range(folds)]
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.union(part)
    each = metrics.rank_auc(scored, "p_fitted", label, ["_fold"]).select(F.col("_fold").alias("fold"), "auc")
    return each.union(metrics.rank_auc(scored, "p_fitted", label).select(F.lit(None).cast("int").alias("fold"), "auc"))


def scored_replies(rows: DataFrame, status: str, direction: Column, confidence: Column, p_recall: Column) -> DataFrame:
    """rows with fail_reason, predicted, confidence, p_recall and penalised; a failed row has none of the rest.

    status is '' for a reply, or the failure that the call ended with; a reply without a direction or confidence is a parse failure.
    """
    parsed = rows.withColumns({"_d": direction, "_c": confidence, "_p": p_recall})
    reason = F.when(F.col(status) != "", F.col(status)).when(F.col("_d").isNull() | F.col("_c").isNull(), "parse").when(F.col("_p").isNull(), "error")
    out = parsed.withColumn("fail_reason", reason)
    kept = lambda c: F.when(F.col("fail_reason").isNull(), c)
    return out.withColumns({"predicted": kept(F.col("_d")), "confidence": kept(F.col("_c")), "p_recall": kept(F.col("_p")), "penalised": kept(calibrate.penalised(F.col("_c"), F.col("_p")))}).drop("_d", "_c", "_p")
