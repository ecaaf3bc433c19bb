"""Ordered series over orders, lineitem and customers: directions, as-of joins, trailing statistics, backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corpus, metrics, rank, series
from .tables import CLOSES, closes, r, table


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.direction_labels(closes(spark, sf_dir), ["ticker"], "day", "close")
    return out.select("ticker", F.col("day").cast("string").alias("day"), r("close", 4).alias("close"), r("previous", 4).alias("previous"), F.col("direction").cast("long").alias("direction"))


DIRECTIONS = f"""WITH {CLOSES}, l AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS previous FROM closes)
SELECT ticker, day::VARCHAR AS day, round(close, 4) AS close, round(previous, 4) AS previous, sign(close - previous)::BIGINT AS direction FROM l WHERE previous IS NOT NULL"""


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.month_end(closes(spark, sf_dir), ["ticker"], "day", "close").select("ticker", "month", "day", "value")


MONTHS = f"{CLOSES}, months AS (SELECT ticker, year(day) * 12 + month(day) - 1 AS month, max(day) AS day, arg_max(close, day) AS value FROM closes GROUP BY ALL)"


def month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _months(spark, sf_dir).select("ticker", "month", F.col("day").cast("string").alias("day"), r("value", 4).alias("value"))


MONTH_ENDS = f"WITH {MONTHS} SELECT ticker, month, day::VARCHAR AS day, round(value, 4) AS value FROM months"


def year_on_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.year_on_year(_months(spark, sf_dir), ["ticker"]).select("ticker", "month", r("yoy").alias("yoy"), "missing")


YEAR_ON_YEAR = f"""WITH {MONTHS} SELECT a.ticker, a.month, round(a.value / b.value - 1, 6) + 0.0 AS yoy, CASE WHEN b.value IS NULL THEN 'no base month' END AS missing
FROM months a LEFT JOIN months b ON a.ticker = b.ticker AND a.month = b.month + 12"""


def trailing_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trailing_z(_months(spark, sf_dir), ["ticker"], 60, 30).select("ticker", "month", "n", r("z").alias("z"))


TRAILING_Z = f"""WITH {MONTHS}, z AS (SELECT ticker, month, value, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM months WINDOW w AS (PARTITION BY ticker ORDER BY month RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT ticker, month, n, CASE WHEN n >= 30 AND s > 0 THEN round((value - m) / s, 6) + 0.0 END AS z FROM z"""


def as_of_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order price of a customer before each of its shipments, at most 30 days old."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    ships = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "cust"), "l_orderkey").select("l_orderkey", "l_linenumber", "cust", F.to_date("l_shipdate").alias("ship_day"))
    out = series.as_of(ships, orders, ["cust"], "ship_day", "day", "o_totalprice", 30)
    return out.groupBy("cust").agg(F.count("*").alias("n"), F.count("as_of_day").alias("n_found"), r(F.sum("as_of_value"), 2).alias("total"), F.max("as_of_day").cast("string").alias("last_day"))


AS_OF_PRICES = """WITH s AS (SELECT l_orderkey, l_linenumber, o_custkey AS cust, l_shipdate::DATE AS ship_day FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT o_custkey AS cust, o_orderdate::DATE AS day, max(o_totalprice) AS v FROM orders GROUP BY ALL),
j AS (SELECT s.cust, CASE WHEN s.ship_day - p.day <= 30 THEN p.day END AS d, CASE WHEN s.ship_day - p.day <= 30 THEN p.v END AS v FROM s ASOF LEFT JOIN p ON s.cust = p.cust AND s.ship_day >= p.day)
SELECT cust, count(*) AS n, count(d) AS n_found, round(sum(v), 2) AS total, max(d)::VARCHAR AS last_day FROM j GROUP BY 1"""


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as they were known at a day: known from the order day to 90 days later, priorities as series."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderkey")
    known = orders.withColumns({"known_from": F.date_add("day", 5), "known_to": F.when(F.col("o_orderkey") % 3 == 0, F.date_add("day", 90))})
    out = series.bitemporal_as_of(known, ["series"], "day", "known_from", "known_to", F.lit("1997-06-30").cast("date"))
    return out.groupBy("series").agg(F.count("*").alias("n"), F.max("day").cast("string").alias("last_day"), r(F.sum("o_totalprice"), 2).alias("total"))


VINTAGES = """WITH k AS (SELECT o_orderpriority AS series, o_orderdate::DATE AS day, o_totalprice, o_orderdate::DATE + 5 AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE + 90 END AS b FROM orders)
SELECT series, count(*) AS n, max(day)::VARCHAR AS last_day, round(sum(o_totalprice), 2) AS total FROM k WHERE a <= DATE '1997-06-30' AND coalesce(b, DATE '1997-06-30') >= DATE '1997-06-30' AND day <= DATE '1997-06-30' GROUP BY 1"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-observation windows of consecutive days with volatility and a value rebased to 100."""
    rows = closes(spark, sf_dir).withColumn("session", F.datediff("day", F.lit("1990-01-01")).cast("long"))
    out = series.trailing_windows(rows, ["ticker"], "session", "close", 20)
    return out.select("ticker", "session", "first_session", r("volatility").alias("volatility"), r("rebased").alias("rebased"))


WINDOWS = f"""WITH {CLOSES}, s AS (SELECT ticker, (day - DATE '1990-01-01')::BIGINT AS session, close, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY day)) AS lr FROM closes),
w AS (SELECT ticker, session, close, count(*) OVER f AS n, min(session) OVER f AS first_session, first_value(close) OVER f AS fv, stddev_samp(lr) OVER g AS volatility FROM s
  WINDOW f AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 18 PRECEDING AND CURRENT ROW))
SELECT ticker, session, first_session, round(volatility, 6) AS volatility, round(close / fv * 100, 6) AS rebased FROM w WHERE n = 20 AND session - first_session = 19"""


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exclusive reason for each close, in a fixed order."""
    order = Window.partitionBy("ticker").orderBy("day")
    rows = closes(spark, sf_dir).withColumns({"before": F.lag("close", 5).over(order), "previous": F.lag("close").over(order), "gap": F.datediff("day", F.lag("day").over(order))})
    rules = [("boundary", F.col("before").isNull()), ("missing", F.col("gap") > 3), ("jump", F.abs(F.col("close") / F.col("previous") - 1) > 0.5), ("flat", F.abs(F.col("close") / F.col("previous") - 1) < 0.01)]
    return series.exclusion_reason(rows, rules).groupBy("ticker", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


EXCLUSIONS = f"""WITH {CLOSES}, l AS (SELECT *, lag(close, 5) OVER w AS b, lag(close) OVER w AS p, day - lag(day) OVER w AS gap FROM closes WINDOW w AS (PARTITION BY ticker ORDER BY day))
SELECT ticker, CASE WHEN b IS NULL THEN 'boundary' WHEN gap > 3 THEN 'missing' WHEN abs(close / p - 1) > 0.5 THEN 'jump' WHEN abs(close / p - 1) < 0.01 THEN 'flat' ELSE 'kept' END AS reason, count(*) AS n FROM l GROUP BY ALL"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.to_date("l_shipdate").alias("day"), (F.col("l_suppkey") % 20).alias("ticker"), F.signum(F.col("l_quantity") - 25).alias("direction"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))


SIGNALS = "signals AS (SELECT l_shipdate::DATE AS day, l_suppkey % 20 AS ticker, sign(l_quantity - 25) AS direction, l_discount * 10 AS confidence, l_orderkey * 10 + l_linenumber AS position FROM lineitem)"
WEIGHTS = f"""{SIGNALS}, raws AS (SELECT day, ticker, arg_max(direction * confidence, position) AS raw FROM signals GROUP BY ALL),
weights AS (SELECT day, ticker, raw / greatest(sum(abs(raw)) OVER (PARTITION BY day), 1.0) AS weight, greatest(0.0, 1 - sum(abs(raw)) OVER (PARTITION BY day)) AS cash FROM raws)"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.target_weights(_signals(spark, sf_dir), "day", "ticker", "direction", "confidence", "position")
    return out.select(F.col("day").cast("string").alias("day"), "ticker", r("weight").alias("weight"), r("cash").alias("cash"))


WEIGHTS_SQL = f"WITH {WEIGHTS} SELECT day::VARCHAR AS day, ticker, round(weight, 6) + 0.0 AS weight, round(cash, 6) AS cash FROM weights"


def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance of the weights against hashed returns, for all signals and for those that a rank filter keeps."""
    signals = _signals(spark, sf_dir)
    kept = rank.rank_filter(signals, "confidence", "position", 0.8, ["ticker"]).drop("threshold")
    both = signals.withColumn("variant", F.lit("all")).unionByName(kept.withColumn("variant", F.lit("filtered")))
    day = F.col("day").cast("string")
    out = None
    for variant in ("all", "filtered"):
        w = series.target_weights(both.filter(F.col("variant") == variant), "day", "ticker", "direction", "confidence", "position")
        change = (F.conv(F.substring(F.md5(F.concat_ws("-", day, F.col("ticker").cast("string"))), 1, 6), 16, 10).cast("double") / 16777216.0 - 0.5) * 0.04
        daily = w.groupBy("day").agg(F.sum(F.round(F.col("weight"), 9) * change).alias("ret")).withColumn("variant", F.lit(variant))
        part = series.performance(daily, ["variant"], "day", "ret")
        out = part if out is None else out.unionByName(part)
    return out.select("variant", "n_days", *[r(c, 5).alias(c) for c in ("sharpe", "mean_bps", "max_drawdown", "total_return")])


_PERF = """d_{v} AS (SELECT day, sum(round(weight, 9) * ((('0x' || substr(md5(day::VARCHAR || '-' || ticker::VARCHAR), 1, 6))::BIGINT / 16777216.0::DOUBLE) - 0.5) * 0.04) AS ret
  FROM (SELECT day, ticker, raw / greatest(sum(abs(raw)) OVER (PARTITION BY day), 1.0) AS weight FROM (SELECT day, ticker, arg_max(direction * confidence, position) AS raw FROM {v}_s GROUP BY ALL)) GROUP BY 1),
e_{v} AS (SELECT day, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) AS equity FROM d_{v}), p_{v} AS (SELECT *, equity / greatest(1.0, max(equity) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM e_{v}),
r_{v} AS (SELECT '{v}' AS variant, count(*) AS n_days, round(sqrt(252) * avg(ret) / stddev_samp(ret), 5) AS sharpe, round(avg(ret) * 10000, 5) AS mean_bps, round(min(dd), 5) + 0.0 AS max_drawdown, round(arg_max(equity, day) - 1, 5) AS total_return FROM p_{v})"""
BACKTEST = f"""WITH {SIGNALS}, all_s AS (SELECT * FROM signals),
filtered_s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY confidence, position) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM all_s) WHERE rn <= n - floor(round(0.2::DOUBLE * n, 9))),
{_PERF.format(v='all')}, {_PERF.format(v='filtered')} SELECT * FROM r_all UNION ALL SELECT * FROM r_filtered"""


def cutoff_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy inside and after each segment's cutoff; segments without a cutoff are counted, not dropped."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cutoffs = spark.createDataFrame([("AUTOMOBILE", "1997-01-01"), ("BUILDING", "1998-01-01"), ("FURNITURE", "1996-06-30"), ("MACHINERY", "1999-03-31")], "segment string, cutoff string")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).select(F.col("c_mktsegment").alias("segment"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") > 100000).alias("correct"))
    rows = rows.join(F.broadcast(cutoffs), "segment", "left").withColumn("inside", F.col("day") <= F.col("cutoff").cast("date"))
    out = metrics.cutoff_gap(rows, "correct", "inside", ["segment"])
    return out.select("segment", "n_in", "n_out", "n_unmatched", r("acc_in").alias("acc_in"), r("acc_out").alias("acc_out"), r("gap").alias("gap"))


CUTOFF_GAPS = """WITH c(segment, cutoff) AS (VALUES ('AUTOMOBILE', DATE '1997-01-01'), ('BUILDING', DATE '1998-01-01'), ('FURNITURE', DATE '1996-06-30'), ('MACHINERY', DATE '1999-03-31')),
r AS (SELECT c_mktsegment AS segment, (o_totalprice > 100000)::INT AS ok, o_orderdate::DATE <= cutoff AS inside FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN c ON c.segment = c_mktsegment)
SELECT segment, count(*) FILTER (inside) AS n_in, count(*) FILTER (NOT inside) AS n_out, count(*) FILTER (inside IS NULL) AS n_unmatched, round(avg(ok) FILTER (inside), 6) AS acc_in, round(avg(ok) FILTER (NOT inside), 6) AS acc_out,
  round(avg(ok) FILTER (inside) - avg(ok) FILTER (NOT inside), 6) + 0.0 AS gap FROM r GROUP BY 1"""


def did(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference in differences of two segments around a day, by order priority."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).filter(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"))
    rows = rows.select(F.col("o_orderpriority").alias("priority"), (F.col("c_mktsegment") == "AUTOMOBILE").alias("treated"), (F.to_date("o_orderdate") < F.lit("1998-01-01")).alias("before"), (F.col("o_totalprice") > 100000).alias("correct"))
    return metrics.difference_in_differences(rows, "correct", "treated", "before", ["priority"]).select("priority", r("did").alias("did"))


DID = """WITH r AS (SELECT o_orderpriority AS priority, c_mktsegment = 'AUTOMOBILE' AS t, o_orderdate::DATE < DATE '1998-01-01' AS b, (o_totalprice > 100000)::INT AS ok FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING'))
SELECT priority, round((avg(ok) FILTER (t AND b) - avg(ok) FILTER (NOT t AND b)) - (avg(ok) FILTER (t AND NOT b) - avg(ok) FILTER (NOT t AND NOT b)), 6) + 0.0 AS did FROM r GROUP BY 1"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.span_coverage(closes(spark, sf_dir), ["ticker"], "day", "1995-01-01", "1998-12-31", 5, 7)


COVERAGE = f"""WITH {CLOSES}, d AS (SELECT ticker, day, day - lag(day) OVER (PARTITION BY ticker ORDER BY day) AS gap FROM closes WHERE day BETWEEN DATE '1995-01-01' AND DATE '1998-12-31')
SELECT ticker, count(*) AS n_days, coalesce(max(gap), 0)::BIGINT AS largest_gap, min(day) - DATE '1995-01-01' <= 5 AND DATE '1998-12-31' - max(day) <= 5 AND coalesce(max(gap), 0) <= 7 AS covered FROM d GROUP BY 1"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a year without two holidays, and the sessions that a ticker has no close for."""
    sessions = series.session_calendar(table(spark, sf_dir, "orders"), "1997-01-01", "1997-12-31", ["1997-01-01", "1997-12-25"])
    tickers = closes(spark, sf_dir).select("ticker").distinct()
    planned = tickers.join(F.broadcast(sessions))  # a year's sessions for each ticker
    return planned.join(closes(spark, sf_dir), ["ticker", "day"], "left_anti").select("ticker", F.col("day").cast("string").alias("day"), F.col("session").cast("long").alias("session"))


CALENDAR = f"""WITH {CLOSES}, s AS (SELECT day, row_number() OVER (ORDER BY day) AS session FROM (SELECT unnest(generate_series(DATE '1997-01-01', DATE '1997-12-31', INTERVAL 1 DAY))::DATE AS day) WHERE isodow(day) < 6 AND day NOT IN (DATE '1997-01-01', DATE '1997-12-25'))
SELECT t.ticker, s.day::VARCHAR AS day, session FROM (SELECT DISTINCT ticker FROM closes) t CROSS JOIN s WHERE NOT EXISTS (SELECT 1 FROM closes c WHERE c.ticker = t.ticker AND c.day = s.day)"""


def matched_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier the customer of its nation with the nearest balance by ratio."""
    a = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    b = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    out = corpus.nearest_match(a, b, ["nation"], "s_suppkey", "s_acctbal", "c_custkey", "c_acctbal", 0.5)
    return out.select("nation", "s_suppkey", "match_id", r("distance", 8).alias("distance"))


MATCHED_SUPPLIERS = """WITH p AS (SELECT s_nationkey AS nation, s_suppkey, c_custkey, round(abs(ln(s_acctbal) - ln(c_acctbal)), 12) AS d FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal > 0 AND c_acctbal > 0 AND abs(ln(s_acctbal) - ln(c_acctbal)) <= 0.5),
k AS (SELECT *, row_number() OVER (PARTITION BY nation, s_suppkey ORDER BY d, c_custkey) AS rn FROM p)
SELECT s_nationkey AS nation, s.s_suppkey, c_custkey AS match_id, round(d, 8) AS distance FROM supplier s LEFT JOIN k ON k.s_suppkey = s.s_suppkey AND k.rn = 1 WHERE s_acctbal > 0"""

QUERIES = {
    "directions": directions,
    "month_ends": month_ends,
    "year_on_year": year_on_year,
    "trailing_z": trailing_z,
    "as_of_prices": as_of_prices,
    "vintages": vintages,
    "price_windows": windows,
    "exclusions": exclusions,
    "weights": weights,
    "backtest": backtest,
    "cutoff_gaps": cutoff_gaps,
    "difference_in_differences": did,
    "span_coverage": coverage,
    "missing_sessions": calendar,
    "matched_suppliers": matched_suppliers,
}
ORACLE_SQL = {
    "directions": DIRECTIONS,
    "month_ends": MONTH_ENDS,
    "year_on_year": YEAR_ON_YEAR,
    "trailing_z": TRAILING_Z,
    "as_of_prices": AS_OF_PRICES,
    "vintages": VINTAGES,
    "price_windows": WINDOWS,
    "exclusions": EXCLUSIONS,
    "weights": WEIGHTS_SQL,
    "backtest": BACKTEST,
    "cutoff_gaps": CUTOFF_GAPS,
    "difference_in_differences": DID,
    "span_coverage": COVERAGE,
    "missing_sessions": CALENDAR,
    "matched_suppliers": MATCHED_SUPPLIERS,
}
