"""Selections in an order, aligned prices and a rebalanced portfolio over the driver's tables. Their SQL is a loop by recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import assembly, portfolio, selection, series
from .tables import CLOSES, closes, hash_sql, r, table

TARGETS = {"before": 150, "after": 220}


def intake_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken in as articles of two sides of a cutoff: one of an address, one of a title, up to a target of each side."""
    side = F.when(F.col("n_chars") % 3 == 0, "before").when(F.col("n_chars") % 3 == 1, "after")
    docs = table(spark, sf_dir, "documents").withColumn("side", side).filter("side IS NOT NULL")
    rows = docs.select("doc_id", "side", F.concat_ws("-", "source", (F.col("doc_id") * 7 % 300).cast("string")).alias("url"), F.md5(F.lower(F.trim(F.substring_index("text", "\n", 1)))).alias("title"))
    return selection.accept(rows, ["url", "title"], ["doc_id"], "side", TARGETS).select("doc_id", "side", "outcome")


INTAKE_PAGES = f"""WITH RECURSIVE a AS (SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN 'before' WHEN 1 THEN 'after' END AS side, source || '-' || (doc_id * 7 % 300) AS url, md5(lower(trim(string_split(text, chr(10))[1], ' '))) AS title FROM documents),
k AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM a WHERE side IS NOT NULL),
w AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, NULL::VARCHAR AS side, NULL::VARCHAR AS outcome, []::VARCHAR[] AS urls, []::VARCHAR[] AS titles, 0 AS n_before, 0 AS n_after
  UNION ALL SELECT i, doc_id, side, outcome, CASE WHEN outcome = 'accepted' THEN list_append(urls, url) ELSE urls END, CASE WHEN outcome = 'accepted' THEN list_append(titles, title) ELSE titles END,
    n_before + (outcome = 'accepted' AND side = 'before')::INT, n_after + (outcome = 'accepted' AND side = 'after')::INT
  FROM (SELECT k.i, k.doc_id, k.side, k.url, k.title, urls, titles, n_before, n_after,
    CASE WHEN list_contains(urls, k.url) OR list_contains(titles, k.title) THEN 'duplicate' WHEN k.side = 'before' AND n_before >= {TARGETS["before"]} OR k.side = 'after' AND n_after >= {TARGETS["after"]} THEN 'full' ELSE 'accepted' END AS outcome
    FROM w JOIN k ON k.i = w.i + 1))
SELECT doc_id, side, outcome FROM w WHERE i > 0"""


WINDOW, QUOTA, SALT = 6, 12, "windows-1"


def balanced_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six sessions of a ticker before and after a year, as many that rise as fall, that do not overlap."""
    order = Window.partitionBy("ticker").orderBy("day")
    days = closes(spark, sf_dir).select("ticker", "day", (F.row_number().over(order) - 1).alias("spot"), F.signum(F.col("close") - F.lag("close").over(order)).cast("int").alias("direction"))
    rows = days.filter("direction <> 0").select(F.when(F.year("day") < 1996, "pre").otherwise("post").alias("cohort"), "ticker", "direction", F.col("spot").cast("long").alias("spot"), F.concat_ws("|", "ticker", F.col("day").cast("string")).alias("item"))
    out = selection.disjoint_windows(rows, ["cohort", "ticker"], ["direction"], "spot", WINDOW, "item", QUOTA, SALT)
    return out.select("cohort", "ticker", "direction", "spot", "item", "outcome")


BALANCED_WINDOWS = f"""WITH RECURSIVE {CLOSES}, d AS (SELECT ticker, day, row_number() OVER o - 1 AS spot, sign(close - lag(close) OVER o)::INTEGER AS direction FROM closes WINDOW o AS (PARTITION BY ticker ORDER BY day)),
k AS (SELECT CASE WHEN year(day) < 1996 THEN 'pre' ELSE 'post' END AS cohort, ticker, direction, spot, ticker || '|' || day AS item FROM d WHERE direction <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY cohort, ticker ORDER BY {hash_sql(f"'{SALT}'", 'item')}, item) AS i FROM k),
w AS (SELECT DISTINCT cohort, ticker, 0::BIGINT AS i, NULL::INTEGER AS direction, NULL::BIGINT AS spot, NULL::VARCHAR AS item, NULL::VARCHAR AS outcome, []::BIGINT[] AS used, 0 AS up, 0 AS down FROM n
  UNION ALL SELECT cohort, ticker, i, direction, spot, item, outcome, CASE WHEN outcome = 'selected' THEN list_append(used, spot) ELSE used END, up + (outcome = 'selected' AND direction = 1)::INT, down + (outcome = 'selected' AND direction = -1)::INT
  FROM (SELECT n.cohort, n.ticker, n.i, n.direction, n.spot, n.item, used, up, down, CASE WHEN CASE WHEN n.direction = 1 THEN up ELSE down END >= {QUOTA} THEN 'quota_full'
    WHEN len(list_filter(used, lambda u: abs(u - n.spot) < {WINDOW})) > 0 THEN 'overlap' ELSE 'selected' END AS outcome
    FROM w JOIN n ON n.cohort = w.cohort AND n.ticker = w.ticker AND n.i = w.i + 1))
SELECT cohort, ticker, direction, spot, item, outcome FROM w WHERE i > 0"""


CASH = 10_000.0
FEES = {"free": 0.0, "charged": 0.002}


def _wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a day: a ticker that rose is held, with a confidence by the day of the month."""
    order = Window.partitionBy("ticker").orderBy("day")
    rows = closes(spark, sf_dir).select("day", "ticker", F.greatest(F.lit(0.0), F.signum(F.col("close") - F.lag("close").over(order))).alias("direction"), (F.dayofmonth("day") % 7 / 20.0 + 0.1).alias("confidence"), F.lag("close").over(order).alias("prev"))
    return rows.filter("prev IS NOT NULL").withColumn("position", F.col("day"))


def rebalanced_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance of a portfolio that follows the weights on all days on which every ticker has a price, without and with fees."""
    prices = portfolio.aligned_prices(closes(spark, sf_dir).withColumn("at", F.col("day")), "day", "ticker", "close", "at").filter("day IS NOT NULL").drop("reason")
    wishes = series.target_weights(_wishes(spark, sf_dir), "day", "ticker", "direction", "confidence", "position")
    parts = [portfolio.daily_returns(portfolio.rebalanced(wishes.withColumn("variant", F.lit(v)), prices, ["variant"], fee, CASH), ["variant"], CASH) for v, fee in FEES.items()]
    curve = parts[0].unionByName(parts[1])
    last = curve.groupBy("variant").agg(F.max_by("value", "day").alias("value"), F.max("fees").alias("fees"))
    out = series.performance(curve, ["variant"], "day", "ret").join(last, "variant")
    return out.select("variant", "n_days", *[r(c, 5).alias(c) for c in ("sharpe", "mean_bps", "max_drawdown", "total_return")], r("value", 3).alias("value"), r("fees", 3).alias("fees"))


REBALANCED_PORTFOLIO = f"""WITH RECURSIVE {CLOSES}, l AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS prev FROM closes),
g AS (SELECT day, ticker, greatest(0, sign(close - prev)) * (day(day) % 7 / 20.0::DOUBLE + 0.1::DOUBLE) AS raw FROM l WHERE prev IS NOT NULL), h AS (SELECT day, ticker, raw / greatest(sum(abs(raw)) OVER (PARTITION BY day), 1.0) AS weight FROM g),
f_all AS (SELECT day FROM closes WHERE close > 0 GROUP BY day HAVING count(*) = (SELECT count(DISTINCT ticker) FROM closes)), f AS (SELECT day FROM f_all WHERE (SELECT count(*) FROM f_all) >= 30),
d AS (SELECT c.day, list(c.close ORDER BY c.ticker) AS p, list(coalesce(h.weight, 0) ORDER BY c.ticker) AS w, row_number() OVER (ORDER BY c.day) AS i FROM closes c JOIN f USING (day) LEFT JOIN h ON h.day = c.day AND h.ticker = c.ticker GROUP BY c.day),
v(variant, fee) AS (VALUES ('free', 0.0::DOUBLE), ('charged', 0.002::DOUBLE)),
s AS (SELECT variant, fee, 0::BIGINT AS i, NULL::DATE AS day, {CASH}::DOUBLE AS cash, list_transform((SELECT p FROM d WHERE i = 1), lambda x: 0::DOUBLE) AS held, {CASH}::DOUBLE AS value, 0::DOUBLE AS fees FROM v
  UNION ALL SELECT variant, fee, i, day, room - bought * part * (1 + fee), hold, room - bought * part * (1 + fee) + list_sum(list_transform(range(1, len(p) + 1), lambda k: hold[k] * p[k])), fees + (sold + bought * part) * fee
  FROM (SELECT *, list_transform(range(1, len(p) + 1), lambda k: held[k] + CASE WHEN deal[k] > 0 THEN deal[k] * part ELSE deal[k] END / p[k]) AS hold
    FROM (SELECT *, CASE WHEN bought > 0 THEN greatest(0, least(1, room / (bought * (1 + fee)))) ELSE 1 END AS part
      FROM (SELECT *, cash + sold * (1 - fee) AS room
        FROM (SELECT *, list_sum(list_transform(deal, lambda x: greatest(-x, 0))) AS sold, list_sum(list_transform(deal, lambda x: greatest(x, 0))) AS bought
          FROM (SELECT *, list_transform(range(1, len(p) + 1), lambda k: w[k] * worth - held[k] * p[k]) AS deal
            FROM (SELECT s.variant, s.fee, d.i, d.day, d.p, d.w, s.cash, s.held, s.fees, s.cash + list_sum(list_transform(range(1, len(d.p) + 1), lambda k: s.held[k] * d.p[k])) AS worth FROM s JOIN d ON d.i = s.i + 1)))))) ),
e AS (SELECT variant, day, value, fees, value / lag(value) OVER (PARTITION BY variant ORDER BY i) - 1 AS ret FROM s), x AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY variant ORDER BY day ROWS UNBOUNDED PRECEDING)) AS equity FROM e WHERE day IS NOT NULL),
y AS (SELECT *, equity / greatest(1.0, max(equity) OVER (PARTITION BY variant ORDER BY day ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM x)
SELECT variant, count(*) AS n_days, round(sqrt(252) * avg(ret) / stddev_samp(ret), 5) AS sharpe, round(avg(ret) * 10000, 5) AS mean_bps, round(min(dd), 5) + 0.0 AS max_drawdown, round(arg_max(equity, day) - 1, 5) AS total_return, round(arg_max(value, day), 3) AS value, round(max(fees), 3) AS fees FROM y GROUP BY 1"""


ASSEMBLED = ("1-URGENT", "3-MEDIUM", "5-LOW")
THROUGH = "1998-06-30"


def assembled_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the month ends of four years from three series of order prices, as known then, and the next month's returns of all; with what each month lacks."""
    daily = closes(spark, sf_dir)
    after = F.when(F.dayofmonth("day") % 3 == 0, F.date_add("day", 400))
    told = daily.filter(F.col("ticker").isin(*ASSEMBLED) & ((F.col("ticker") != ASSEMBLED[1]) | (F.month("day") != 4)))
    observations = told.select(F.col("ticker").alias("series"), "day", F.col("close").alias("value"), F.date_add("day", 20).alias("known_from"), after.alias("known_to"))
    decisions = spark.range(48).select(F.last_day(F.add_months(F.lit("1995-01-01").cast("date"), F.col("id").cast("int"))).alias("decision"))
    known = assembly.as_known(observations, decisions, 24, 6, 12)
    returns = assembly.next_month_returns(daily.filter("month(day) <> 9 OR ticker <> '2-HIGH'"), decisions, F.lit(THROUGH).cast("date"))
    out = assembly.assembled(decisions, known, returns, ASSEMBLED)
    return out.select(F.col("decision").cast("string").alias("decision"), "item_id", "state", "reason", *[r(F.try_element_at("z", F.lit(s))).alias(f"z{k}") for k, s in enumerate(ASSEMBLED)], "outcome_reason", r(F.aggregate(F.map_values("returns"), F.lit(0.0), lambda t, x: t + x)).alias("total_return"))


_SERIES = ", ".join(f"'{s}'" for s in ASSEMBLED)
ASSEMBLED_MONTHS = f"""WITH {CLOSES}, d AS (SELECT last_day(DATE '1995-01-01' + to_months(i::INT)) AS decision FROM range(48) t(i)),
o AS (SELECT ticker AS series, day, close, day + 20 AS a, CASE WHEN day(day) % 3 = 0 THEN day + 400 END AS b, year(day) * 12 + month(day) - 1 AS m FROM closes WHERE ticker IN ({_SERIES}) AND (ticker <> '{ASSEMBLED[1]}' OR month(day) <> 4)),
k AS (SELECT series, decision, year(decision) * 12 + month(decision) - 1 AS dm, m, arg_max(close, day) AS v FROM o JOIN d ON day <= decision AND a <= decision AND coalesce(b, decision) >= decision GROUP BY ALL),
l AS (SELECT *, max(m) OVER (PARTITION BY series, decision) AS latest FROM k),
s AS (SELECT series, decision, count(*) AS n, arg_max(v, m) AS cur, avg(v) AS mean, stddev_samp(v) AS sd FROM l WHERE m > latest - 24 AND latest > dm - 6 GROUP BY series, decision),
z AS (SELECT d.decision, x.series, x.i, CASE WHEN s.series IS NULL THEN x.series || ' has no value' WHEN n < 12 THEN x.series || ' has ' || n || ' monthly values' WHEN NOT coalesce(sd > 0, false) THEN x.series || ' does not vary' END AS reason, (cur - mean) / sd AS z
  FROM d CROSS JOIN (SELECT unnest([{_SERIES}]) AS series, unnest([1, 2, 3]) AS i) x LEFT JOIN s ON s.series = x.series AND s.decision = d.decision),
w AS (SELECT decision, coalesce(arg_min(reason, i) FILTER (reason IS NOT NULL), '') AS reason, {", ".join(f"max(z) FILTER (i = {k + 1}) AS z{k}" for k in range(3))} FROM z GROUP BY 1),
c AS (SELECT ticker, year(day) * 12 + month(day) - 1 AS m, arg_max(close, day) AS c FROM closes WHERE month(day) <> 9 OR ticker <> '2-HIGH' GROUP BY ALL HAVING last_day(max(day)) - max(day) <= 7),
p AS (SELECT decision, t.ticker, x.c AS now, y.c AS later, last_day(decision + to_months(1)) > DATE '{THROUGH}' AS open FROM d CROSS JOIN (SELECT DISTINCT ticker FROM closes) t
  LEFT JOIN c x ON x.ticker = t.ticker AND x.m = year(decision) * 12 + month(decision) - 1 LEFT JOIN c y ON y.ticker = t.ticker AND y.m = year(decision) * 12 + month(decision)),
q AS (SELECT decision, ticker, CASE WHEN open THEN 'the next month is not complete' WHEN now IS NULL THEN ticker || ' has no close at the end of the month' WHEN later IS NULL THEN ticker || ' has no close at the end of the next month' END AS reason, later / now - 1 AS ret FROM p),
r AS (SELECT decision, coalesce(arg_min(reason, ticker) FILTER (reason IS NOT NULL), '') AS outcome_reason, sum(ret) AS total FROM q GROUP BY 1)
SELECT decision::VARCHAR AS decision, CASE WHEN reason = '' THEN 'macro-' || strftime(decision, '%Y-%m') END AS item_id, CASE WHEN reason <> '' THEN 'excluded' WHEN outcome_reason <> '' THEN 'no outcome' ELSE 'complete' END AS state, reason,
  {", ".join(f"CASE WHEN reason = '' THEN round(z{k}, 6) END AS z{k}" for k in range(3))}, outcome_reason, CASE WHEN outcome_reason = '' THEN round(total, 6) END AS total_return FROM w JOIN r USING (decision)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (intake_pages, balanced_windows, rebalanced_portfolio, assembled_months)}
ORACLE_SQL: dict[str, str] = {name: globals()[name.upper()] for name in QUERIES}
