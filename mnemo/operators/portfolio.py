"""Aligned prices, and a portfolio that is rebalanced to target weights for a fee.

A variant's days are folded in their order, with cash and holdings by ticker as the state. The days of a variant stand in one
row, so its size is that of a price calendar and not of the signals; variants are folded side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import match


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def aligned_prices(prices: DataFrame, day: str, ticker: str, price: str, position: str, least_days: int = 30) -> DataFrame:
    """day, ticker, price of the days on which every ticker has a finite positive price, and `reason`: why nothing else is there.

    Of several prices of a day and ticker the last by `position` counts. With fewer than `least_days` aligned days there is
    one row without day, ticker and price, whose reason says so.
    """
    last = prices.groupBy(F.col(day).alias("day"), F.col(ticker).alias("ticker")).agg(F.max_by(price, position).cast("double").alias("price"))
    tickers = last.agg(F.count_distinct("ticker").alias("_tickers"))
    good = last.filter((F.col("price") > 0) & ~F.isnan("price") & (F.col("price") < float("inf")))
    full = good.groupBy("day").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(tickers)).filter(F.col("_n") == F.col("_tickers")).select("day")
    days = full.agg(F.count("*").alias("_days"))
    enough = good.join(full, "day").crossJoin(F.broadcast(days.filter(F.col("_days") >= least_days).drop("_days"))).select("day", "ticker", "price", F.lit("").alias("reason"))
    kinds = {f.name: f.dataType for f in enough.schema}
    short = days.filter(F.col("_days") < least_days).select(*[F.lit(None).cast(kinds[c]).alias(c) for c in ("day", "ticker", "price")], F.concat(F.lit("aligned days: "), F.col("_days").cast("string")).alias("reason"))
    return enough.unionByName(short)


def _traded(state: Column, day: Column, fee: float) -> Column:
    """The state after a day's trades: sells first, then buys, all in one proportion if the cash does not suffice."""
    product = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
    before = state["cash"] + total(product(state["held"], day["prices"]))

    def deals(worth: Column) -> Column:
        wanted = F.transform(day["weights"], lambda w: w * worth)
        return F.zip_with(wanted, product(state["held"], day["prices"]), lambda a, b: a - b)

    def settled(deal: Column) -> Column:
        sold, bought = total(F.transform(deal, lambda d: F.greatest(-d, F.lit(0.0)))), total(F.transform(deal, lambda d: F.greatest(d, F.lit(0.0))))
        return with_value(F.struct(deal.alias("deal"), sold.alias("sold"), bought.alias("bought")), paid)

    def paid(x: Column) -> Column:
        room = state["cash"] + x["sold"] * (1 - fee)
        part = F.when(x["bought"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), room / (x["bought"] * (1 + fee))))).otherwise(1.0)
        return with_value(F.struct(room.alias("room"), part.alias("part"), x.alias("x")), after)

    def after(y: Column) -> Column:
        x = y["x"]
        done = F.transform(x["deal"], lambda d: F.when(d > 0, d * y["part"]).otherwise(d))
        held = F.zip_with(state["held"], F.zip_with(done, day["prices"], lambda d, p: d / p), lambda h, s: h + s)
        cash = y["room"] - x["bought"] * y["part"] * (1 + fee)
        fees = (x["sold"] + x["bought"] * y["part"]) * fee
        return with_value(held, lambda h: F.struct(cash.alias("cash"), h.alias("held"), (cash + total(product(h, day["prices"]))).alias("value"), (state["fees"] + fees).alias("fees")))

    closed = F.struct(F.lit(0.0).alias("cash"), F.transform(state["held"], lambda h: F.lit(0.0)).alias("held"), F.lit(0.0).alias("value"), state["fees"].alias("fees"))
    return with_value(before, lambda worth: F.when(worth > 0, with_value(deals(worth), settled)).otherwise(closed))


def rebalanced(weights: DataFrame, prices: DataFrame, key: Sequence[str], fee: float, cash: float) -> DataFrame:
    """key, day, value, cash and fees (all so far) after each day of `prices` (day, ticker, price; aligned), for each key of `weights` (key, day, ticker, weight).

    On every day holdings are brought to the weights of that day, 0 for a ticker without one; a weight below 0 is a short
    position. A fee is a share of what is bought or sold. Weights of days or tickers without a price are left out. A portfolio
    that is worth nothing or less is closed out: its value is 0 from then on.
    """
    keys = list(key)
    per_day = prices.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("ticker", "price"))).alias("_p"))
    given = weights.groupBy(*keys, "day").agg(F.map_from_entries(F.collect_list(F.struct("ticker", F.col("weight").cast("double")))).alias("_w"))
    planned = weights.select(*keys).distinct().crossJoin(F.broadcast(per_day))  # a calendar's days for each key
    both = match(planned, given, [*keys, "day"], "left")
    weight = F.transform("_p", lambda x: F.coalesce(F.try_element_at("_w", x["ticker"]), F.lit(0.0)))
    days = both.select(*keys, F.struct("day", F.transform("_p", lambda x: x["price"]).alias("prices"), weight.alias("weights")).alias("_d"))
    folded = days.groupBy(*keys).agg(F.array_sort(F.collect_list("_d")).alias("_days"))
    nothing = F.transform(F.get("_days", F.lit(0))["prices"], lambda p: F.lit(0.0))
    state = F.struct(F.lit(float(cash)).alias("cash"), nothing.alias("held"), F.lit(float(cash)).alias("value"), F.lit(0.0).alias("fees"))
    kind = "array<struct<day:{0},value:double,cash:double,fees:double>>".format(dict(prices.dtypes)["day"])
    start = F.struct(state.alias("now"), F.array().cast(kind).alias("seen"))

    def step(acc: Column, day: Column) -> Column:
        row = lambda s: F.struct(day["day"].alias("day"), s["value"].alias("value"), s["cash"].alias("cash"), s["fees"].alias("fees"))
        return with_value(_traded(acc["now"], day, fee), lambda s: F.struct(s.alias("now"), F.concat(acc["seen"], F.array(row(s))).alias("seen")))

    seen = folded.select(*keys, F.explode(F.aggregate("_days", start, step, lambda acc: acc["seen"])).alias("_s"))
    return seen.select(*keys, "_s.*")


def daily_returns(curve: DataFrame, key: Sequence[str], cash: float) -> DataFrame:
    """curve with `ret`, the change of value against the day before; the first day against the cash that was there."""
    earlier = F.coalesce(F.lag("value").over(Window.partitionBy(*key).orderBy("day")), F.lit(float(cash)))
    return curve.withColumn("ret", F.try_divide(F.col("value"), earlier) - 1)
