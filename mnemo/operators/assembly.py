"""Items of decision months from several sources as they were known then, with a ledger of every month and what it lacks.

An observation meets the decisions of its trailing window alone, by the number of the month; all series are expanded, grouped
and measured together. Nothing is filled in: a month that lacks something keeps its row and says what.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import month_index


def as_known(observations: DataFrame, decisions: DataFrame, months: int = 60, late: int = 12, least: int = 30) -> DataFrame:
    """series, decision, latest (month), current, n, z and reason of each series at each decision.

    observations: series, day, value, known_from and known_to (null: still so); decisions: decision, a day. Known are the
    observations of a day up to the decision whose time of validity holds it. A month's value is its last known one, the
    current value that of the latest month (at most `late` months before the decision), and z its place among the `months`
    calendar months that end there, with the sample spread. The reason is the first that holds: no value is known, fewer than
    `least` months are, or they do not vary; a series that has nothing at a decision has no row.
    """
    at = decisions.select("decision", month_index(F.col("decision")).alias("_at")).distinct()
    seen = observations.withColumn("_month", month_index(F.col("day"))).withColumn("_at", F.explode(F.sequence(F.col("_month"), F.col("_month") + months + late - 1)))
    known = seen.join(at, "_at").filter((F.col("day") <= F.col("decision")) & (F.col("known_from") <= F.col("decision")) & (F.coalesce("known_to", "decision") >= F.col("decision")) & F.col("value").isNotNull())
    monthly = known.groupBy("series", "decision", "_at", "_month").agg(F.max_by("value", F.struct("day", "known_from", "value")).cast("double").alias("_v"))
    latest = monthly.groupBy("series", "decision").agg(F.max("_month").alias("latest"))
    inside = monthly.join(latest, ["series", "decision"]).filter((F.col("_month") > F.col("latest") - months) & (F.col("latest") > F.col("_at") - late))
    out = inside.groupBy("series", "decision", "latest").agg(F.count("*").alias("n"), F.max_by("_v", "_month").alias("current"), F.avg("_v").alias("_mean"), F.stddev_samp("_v").alias("_sd"))
    reason = F.when(F.col("n") < least, F.concat("series", F.lit(" has "), F.col("n").cast("string"), F.lit(" monthly values"))).when(~F.coalesce(F.col("_sd") > 0, F.lit(False)), F.concat("series", F.lit(" does not vary"))).otherwise("")
    return out.select("series", "decision", "latest", "current", "n", F.when(reason == "", (F.col("current") - F.col("_mean")) / F.col("_sd")).alias("z"), reason.alias("reason"))


def next_month_returns(closes: DataFrame, decisions: DataFrame, complete_through: Column, tolerance: int = 7) -> DataFrame:
    """decision, ticker, ret and reason: the change from the last close of a decision's month to that of the next.

    closes: ticker, day, close. A close counts for its month if it is at most `tolerance` days before the month's end. Without
    one, or if the next month ends after `complete_through`, there is no return but a reason.
    """
    last = closes.filter(F.col("close") > 0).groupBy("ticker", month_index(F.col("day")).alias("_m")).agg(F.max_by("close", "day").alias("_c"), F.max("day").alias("_d"))
    fresh = last.filter(F.datediff(F.last_day("_d"), "_d") <= tolerance).select("ticker", "_m", "_c")
    plan = decisions.select("decision", month_index(F.col("decision")).alias("_m")).distinct().crossJoin(F.broadcast(closes.select("ticker").distinct()))  # a universe of tickers
    now = plan.join(fresh.withColumnRenamed("_c", "_now"), ["ticker", "_m"], "left")
    both = now.join(fresh.select("ticker", (F.col("_m") - 1).alias("_m"), F.col("_c").alias("_then")), ["ticker", "_m"], "left")
    open_ = F.last_day(F.add_months("decision", 1)) > complete_through
    reason = F.when(open_, "the next month is not complete").when(F.col("_now").isNull(), F.concat("ticker", F.lit(" has no close at the end of the month"))).when(F.col("_then").isNull(), F.concat("ticker", F.lit(" has no close at the end of the next month"))).otherwise("")
    return both.select("decision", "ticker", F.when(reason == "", F.col("_then") / F.col("_now") - 1).alias("ret"), reason.alias("reason"))


def assembled(decisions: DataFrame, known: DataFrame, returns: DataFrame, series: Sequence[str]) -> DataFrame:
    """decision, item_id, state, reason, z (series -> z), outcome_reason and returns (ticker -> return) of every decision.

    A decision that lacks one of `series` is excluded, with the first reason in their order; else it is an item, complete or
    without an outcome, whose reason is the first by ticker.
    """
    each = known.groupBy("decision").agg(F.map_from_entries(F.collect_list(F.struct("series", F.struct("z", "reason")))).alias("_k"))
    out = returns.groupBy("decision").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ticker", "ret")))).alias("_r"), F.min_by("reason", F.when(F.col("reason") != "", F.col("ticker"))).alias("outcome_reason"), F.count_if(F.col("reason") != "").alias("_bad"))
    all_ = decisions.select("decision").distinct().join(each, "decision", "left").join(out, "decision", "left")
    lacks = F.coalesce(*[F.when(F.try_element_at("_k", F.lit(s)).isNull(), F.lit(f"{s} has no value")).otherwise(F.nullif(F.try_element_at("_k", F.lit(s))["reason"], F.lit(""))) for s in series], F.lit(""))
    bad = F.coalesce(F.col("_bad") > 0, F.lit(True))
    state = F.when(lacks != "", "excluded").when(bad, "no outcome").otherwise("complete")
    z = F.map_from_arrays(F.array(*map(F.lit, series)), F.array(*[F.try_element_at("_k", F.lit(s))["z"] for s in series]))
    item = F.concat(F.lit("macro-"), F.date_format("decision", "yyyy-MM"))
    return all_.select("decision", F.when(lacks == "", item).alias("item_id"), state.alias("state"), lacks.alias("reason"), F.when(lacks == "", z).alias("z"), F.when(bad, F.coalesce("outcome_reason", F.lit("no closes"))).otherwise("").alias("outcome_reason"), F.when(~bad, F.col("_r")).alias("returns"))
