"""Repeated draws: consensus, lattices, splits, dependence, distributions and decisions over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import consensus, metrics
from .membership import _wilson
from .tables import DRAWS, draws, r


def modal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = consensus.modal_answer(draws(spark, sf_dir), ["item"], "answer")
    return out.select("item", "modal", "n_modal", "n", *[r(c).alias(c) for c in ("agreement", "low", "high")])


MODAL_ANSWERS = f"""WITH {DRAWS}, g AS (SELECT item, answer, count(*) AS n_modal FROM draws GROUP BY ALL), k AS (SELECT *, sum(n_modal) OVER (PARTITION BY item)::BIGINT AS n, row_number() OVER (PARTITION BY item ORDER BY n_modal DESC, answer) AS rn FROM g)
SELECT item, answer AS modal, n_modal, n, round(n_modal / n::DOUBLE, 6) AS agreement, round({_wilson('n_modal', 'n', '-')}, 6) AS low, round({_wilson('n_modal', 'n', '+')}, 6) AS high FROM k WHERE rn = 1"""


def consensus_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative draw of each item: the smallest text among those with the modal answer."""
    rows = draws(spark, sf_dir).withColumn("text", F.sha2(F.col("event_id").cast("string"), 256))
    return consensus.consensus_draw(rows, ["item"], "answer", "text").select("item", "modal", "consensus")


CONSENSUS_DRAWS = f"""WITH {DRAWS}, g AS (SELECT item, answer, count(*) AS c, min(sha256(event_id::VARCHAR)) AS consensus FROM draws GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY c DESC, answer) AS rn FROM g)
SELECT item, answer AS modal, consensus FROM k WHERE rn = 1"""


def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.canonical_hash(draws(spark, sf_dir), ["item"], "answer")


CANONICAL_HASHES = f"""WITH {DRAWS} SELECT item, sha256('draws-v1' || chr(31) || string_agg(sha256(answer), chr(31) ORDER BY sha256(answer))) AS draws_hash FROM draws GROUP BY 1"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = consensus.robust_location(draws(spark, sf_dir), ["item"], "value")
    return out.select("item", "n", *[r(c).alias(c) for c in ("mean", "median", "trimmed", "mad_scale")], r(consensus.scale_floor(F.col("mad_scale"), 0.5)).alias("scale"))


LOCATIONS = f"""WITH {DRAWS}, a AS (SELECT item, list_sort(list(value)) AS v FROM draws WHERE value IS NOT NULL GROUP BY 1),
b AS (SELECT item, v, len(v) AS n, v[((len(v) - 1) // 2) + 1] AS median, floor(len(v) * 0.1::DOUBLE)::INT AS c FROM a),
d AS (SELECT *, list_sort(list_transform(v, lambda x: abs(x - median))) AS dev, CASE WHEN n - 2 * c > 0 THEN v[c + 1:n - c] ELSE v END AS inner_v FROM b)
SELECT item, n, round(list_avg(v), 6) AS mean, round(median, 6) AS median, round(list_avg(inner_v), 6) AS trimmed, round(1.4826 * dev[((n - 1) // 2) + 1], 6) AS mad_scale, round(greatest(1.4826 * dev[((n - 1) // 2) + 1], 0.5 / sqrt(12)), 6) AS scale FROM d"""


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied positions of each item on a lattice of 5, and how many values stand on one of 0.25."""
    rows = draws(spark, sf_dir)
    counts = consensus.occupancy(rows, ["item"], "value", "5").groupBy("item").agg(F.count("*").alias("positions"), F.max("n").alias("busiest"), r(F.sum(F.col("position") * F.col("n")), 4).alias("mass"))
    return counts.join(consensus.grid_adherence(rows, ["item"], "value", "0.25"), "item").select("item", "positions", "busiest", "mass", r("adherence").alias("adherence"))


LATTICE = f"""WITH {DRAWS}, p AS (SELECT item, sign(value) * round(abs(value)::DECIMAL(30,12) / 5, 0) * 5 AS position, count(*) AS n FROM draws GROUP BY ALL),
q AS (SELECT item, round(avg((abs(value - sign(value) * (round(abs(value)::DECIMAL(30,12) / 0.25, 0) * 0.25)::DOUBLE) <= 1e-9)::INT), 6) AS adherence FROM draws GROUP BY 1)
SELECT item, count(*) AS positions, max(n) AS busiest, round(sum(position * n)::DOUBLE, 4) AS mass, any_value(adherence) AS adherence FROM p JOIN q USING (item) GROUP BY 1"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose answers fall into two separated clusters, on draws widened by their type so that some do."""
    rows = draws(spark, sf_dir).withColumn("v", F.floor(F.col("value") / 40) + F.when(F.col("answer") < "d", 0).otherwise(20))
    out = consensus.split_search(rows, ["item"], "v", "1", min_gap=3, contrast=2.0)
    return out.select("item", "n", "separated", *[r(c).alias(c) for c in ("lower_mass", "upper_mass", "trough_mass", "gap_low", "gap_high")])


SPLITS = f"""WITH {DRAWS}, w AS (SELECT item, floor(value / 40) + CASE WHEN answer < 'd' THEN 0 ELSE 20 END AS v FROM draws), c AS (SELECT item, v, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT item, v, n, row_number() OVER o AS i, count(*) OVER (PARTITION BY item) AS m, sum(n) OVER (PARTITION BY item) AS total, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS upto, max(n) OVER (o ROWS UNBOUNDED PRECEDING) AS pl,
  max(n) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ph FROM c WINDOW o AS (PARTITION BY item ORDER BY v)),
g AS (SELECT a.item, a.i, b.i AS j, a.v AS lo, b.v AS hi, a.upto AS lower, b.total - b.upto + b.n AS upper, greatest(a.pl, b.ph) AS peak, a.m, a.total, coalesce((SELECT max(t.n) FROM k t WHERE t.item = a.item AND t.i > a.i AND t.i < b.i), 0) AS trough
  FROM k a JOIN k b ON a.item = b.item AND b.i > a.i AND round(b.v - a.v) - 1 >= 3 WHERE a.upto >= 0.25 * a.total AND b.total - b.upto + b.n >= 0.25 * b.total),
f AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY total - lower - upper, -(peak - 2 * trough), i, j) AS rn FROM g WHERE (lower + upper) / (i + m - j + 1)::DOUBLE >= 1.5 AND peak >= 2 * trough)
SELECT n.item, n.n, CASE WHEN n.n >= 8 THEN f.item IS NOT NULL END AS separated, CASE WHEN n.n >= 8 THEN round(f.lower / f.total::DOUBLE, 6) END AS lower_mass, CASE WHEN n.n >= 8 THEN round(f.upper / f.total::DOUBLE, 6) END AS upper_mass,
  CASE WHEN n.n >= 8 THEN round((f.total - f.lower - f.upper) / f.total::DOUBLE, 6) END AS trough_mass, CASE WHEN n.n >= 8 THEN f.lo::DOUBLE END AS gap_low, CASE WHEN n.n >= 8 THEN f.hi::DOUBLE END AS gap_high
FROM (SELECT item, count(*) AS n FROM w GROUP BY 1) n LEFT JOIN f ON n.item = f.item AND f.rn = 1"""


def dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether draws of one wave (day) agree more often than draws of different waves."""
    rows = draws(spark, sf_dir).withColumn("wave", F.to_date("ts"))
    return consensus.lag_dependence(rows, ["item"], "answer", "wave").select("item", "n", r("dependence").alias("dependence"))


DEPENDENCE = f"""WITH {DRAWS}, p AS (SELECT a.item, (a.ts::DATE = b.ts::DATE) AS same_wave, (a.answer = b.answer)::INT AS same FROM draws a JOIN draws b ON a.item = b.item AND a.event_id < b.event_id)
SELECT n.item, n.n, round(avg(same) FILTER (same_wave) - avg(same) FILTER (NOT same_wave), 6) AS dependence FROM (SELECT item, count(*) AS n FROM draws GROUP BY 1) n LEFT JOIN p ON n.item = p.item GROUP BY ALL"""


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = draws(spark, sf_dir).withColumn("value", F.col("value") - 10)
    out = consensus.draw_distribution(rows, ["item"], ["ts", "event_id"], "value")
    return out.select("item", "n", *[r(c).alias(c) for c in ("q05", "q25", "q50", "q75", "q95", "sd", "iqr", "same_sign", "first_rank", "lag1")])


DISTRIBUTIONS = f"""WITH {DRAWS}, a AS (SELECT item, ts, event_id, value - 10 AS v, row_number() OVER (PARTITION BY item ORDER BY ts, event_id) AS k, lead(value - 10) OVER (PARTITION BY item ORDER BY ts, event_id) AS w,
  rank() OVER (PARTITION BY item ORDER BY value - 10) - 1 + count(*) OVER (PARTITION BY item, value - 10) / 2.0::DOUBLE AS rk FROM draws WHERE value IS NOT NULL),
s AS (SELECT item, count(*) AS n, quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q, stddev_samp(v) AS sd, count(*) FILTER (v > 0) AS up, count(*) FILTER (v < 0) AS down, count(*) FILTER (v = 0) AS flat,
  CASE WHEN count(*) >= 3 THEN corr(v, w) END AS lag1, max(rk) FILTER (k = 1) AS f FROM a GROUP BY 1)
SELECT item, n, round(q[1], 6) AS q05, round(q[2], 6) AS q25, round(q[3], 6) AS q50, round(q[4], 6) AS q75, round(q[5], 6) AS q95, round(CASE WHEN n = 1 THEN 0 ELSE sd END, 6) AS sd, round(q[4] - q[2], 6) AS iqr,
  round(CASE WHEN q[3] > 0 THEN up WHEN q[3] < 0 THEN down ELSE flat END / n::DOUBLE, 6) AS same_sign, round(f / n, 6) AS first_rank, round(lag1, 6) AS lag1 FROM s"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions from draws whose recall estimates are missing for some."""
    rows = draws(spark, sf_dir).select("item", F.when(F.col("answer") != "signup", F.floor(F.col("value") / 40)).alias("v"), F.when(F.col("answer") == "purchase", F.col("value") / 400.0).alias("p"))
    out = consensus.decide(rows, ["item"], "v", "p", "1", 8)
    return out.select("item", "n_draws", F.col("n_parsed").cast("long").alias("n_parsed"), r("raw").alias("raw"), r("p_recall").alias("p_recall"), r("adjusted").alias("adjusted"), "status")


DECISIONS = f"""WITH {DRAWS}, w AS (SELECT item, CASE WHEN answer <> 'signup' THEN floor(value / 40) END AS v, CASE WHEN answer = 'purchase' THEN value / 400.0::DOUBLE END AS p FROM draws), c AS (SELECT item, v, count(*) AS n FROM w WHERE v IS NOT NULL GROUP BY ALL),
k AS (SELECT item, v, n, row_number() OVER o AS i, count(*) OVER (PARTITION BY item) AS m, sum(n) OVER (PARTITION BY item) AS total, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS upto, max(n) OVER (o ROWS UNBOUNDED PRECEDING) AS pl,
  max(n) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ph FROM c WINDOW o AS (PARTITION BY item ORDER BY v)),
f AS (SELECT DISTINCT a.item FROM k a JOIN k b ON a.item = b.item AND b.i > a.i AND round(b.v - a.v) - 1 >= 3 WHERE a.upto >= 0.25 * a.total AND b.total - b.upto + b.n >= 0.25 * b.total
  AND (a.upto + b.total - b.upto + b.n) / (a.i + a.m - b.i + 1)::DOUBLE >= 1.5 AND greatest(a.pl, b.ph) >= 10 * coalesce((SELECT max(t.n) FROM k t WHERE t.item = a.item AND t.i > a.i AND t.i < b.i), 0)),
g AS (SELECT item, count(*) AS n_draws, count(v) AS n_parsed, list_sort(list(v) FILTER (v IS NOT NULL)) AS vs, avg(p) AS p_recall FROM w GROUP BY 1),
h AS (SELECT g.*, n_parsed >= 8 AND f.item IS NOT NULL AS split, CASE WHEN n_parsed >= 8 AND f.item IS NULL THEN vs[((n_parsed - 1) // 2) + 1] END AS answer FROM g LEFT JOIN f ON g.item = f.item)
SELECT item, n_draws, n_parsed, round(answer, 6) AS raw, round(p_recall, 6) AS p_recall, round(answer * (1 - greatest(0, least(1, p_recall))), 6) AS adjusted,
  CASE WHEN n_parsed < 8 THEN 'failed' WHEN split THEN 'unavailable' WHEN p_recall IS NULL THEN 'weak' ELSE 'ok' END AS status FROM h"""


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total exists only where every row reports; else only a known part."""
    rows = draws(spark, sf_dir).withColumn("reported", F.when(F.col("value") < 100, F.col("value")))
    return rows.groupBy("item", "answer").agg(r(metrics.complete_sum(F.col("reported")), 4).alias("total"), r(F.sum("reported"), 4).alias("known"), F.count("*").alias("requests"))


USAGE_TOTALS = f"""WITH {DRAWS}, u AS (SELECT *, CASE WHEN value < 100 THEN value END AS reported FROM draws)
SELECT item, answer, CASE WHEN count(reported) = count(*) THEN round(sum(reported), 4) END AS total, round(sum(reported), 4) AS known, count(*) AS requests FROM u GROUP BY ALL"""


def first_draw_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an item's first draw differs from its modal answer, by the modal answer, with a Wilson interval."""
    rows = draws(spark, sf_dir)
    first = rows.groupBy("item").agg(F.min_by("answer", F.struct("ts", "event_id")).alias("first"))
    both = first.join(consensus.modal_answer(rows, ["item"], "answer"), "item").groupBy("modal").agg(F.count("*").alias("n"), F.count_if(F.col("first") != F.col("modal")).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return both.select("modal", "n", "k", r(F.col("k") / F.col("n")).alias("rate"), r(low).alias("low"), r(high).alias("high"))


FIRST_DRAW_RATES = f"""WITH {DRAWS}, g AS (SELECT item, answer, count(*) AS c FROM draws GROUP BY ALL), m AS (SELECT item, answer AS modal, row_number() OVER (PARTITION BY item ORDER BY c DESC, answer) AS rn FROM g),
f AS (SELECT item, answer, row_number() OVER (PARTITION BY item ORDER BY ts, event_id) AS rn FROM draws), b AS (SELECT modal, count(*) AS n, count(*) FILTER (f.answer <> modal) AS k FROM m JOIN f USING (item) WHERE m.rn = 1 AND f.rn = 1 GROUP BY 1)
SELECT modal, n, k, round(k / n::DOUBLE, 6) AS rate, round({_wilson('k', 'n', '-')}, 6) AS low, round({_wilson('k', 'n', '+')}, 6) AS high FROM b"""


def half_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance between the means of two halves of an item's draws against that of two single draws, by answer."""
    from pyspark.sql import Window

    order = Window.partitionBy("item", "answer").orderBy("ts", "event_id")
    rows = draws(spark, sf_dir).withColumn("k", F.row_number().over(order))
    halves = rows.groupBy("item", "answer").agg(F.avg(F.when(F.col("k") % 2 == 1, F.col("value"))).alias("a"), F.avg(F.when(F.col("k") % 2 == 0, F.col("value"))).alias("b"), F.max(F.when(F.col("k") == 1, F.col("value"))).alias("x"), F.max(F.when(F.col("k") == 2, F.col("value"))).alias("y"))
    out = halves.filter("b IS NOT NULL").groupBy("answer").agg(F.count("*").alias("items"), F.avg(F.pow(F.col("a") - F.col("b"), 2) / 2).alias("h"), F.avg(F.pow(F.col("x") - F.col("y"), 2) / 2).alias("s"))
    return out.select("answer", "items", r("h").alias("half_variance"), r("s").alias("single_variance"), r(F.when(F.col("s") > 0, F.col("h") / F.col("s"))).alias("ratio"))


HALF_VARIANCE = f"""WITH {DRAWS}, k AS (SELECT *, row_number() OVER (PARTITION BY item, answer ORDER BY ts, event_id) AS k FROM draws),
h AS (SELECT item, answer, avg(value) FILTER (k % 2 = 1) AS a, avg(value) FILTER (k % 2 = 0) AS b, max(value) FILTER (k = 1) AS x, max(value) FILTER (k = 2) AS y FROM k GROUP BY ALL)
SELECT answer, count(*) AS items, round(avg((a - b) ** 2 / 2), 6) AS half_variance, round(avg((x - y) ** 2 / 2), 6) AS single_variance, round(avg((a - b) ** 2 / 2) / avg((x - y) ** 2 / 2), 6) AS ratio FROM h WHERE b IS NOT NULL GROUP BY 1"""

QUERIES = {
    "modal_answers": modal_answers,
    "consensus_draws": consensus_draws,
    "canonical_hashes": canonical_hashes,
    "locations": locations,
    "lattice": lattice,
    "splits": splits,
    "dependence": dependence,
    "distributions": distributions,
    "decisions": decisions,
    "usage_totals": usage_totals,
    "first_draw_rates": first_draw_rates,
    "half_variance": half_variance,
}
ORACLE_SQL = {
    "modal_answers": MODAL_ANSWERS,
    "consensus_draws": CONSENSUS_DRAWS,
    "canonical_hashes": CANONICAL_HASHES,
    "locations": LOCATIONS,
    "lattice": LATTICE,
    "splits": SPLITS,
    "dependence": DEPENDENCE,
    "distributions": DISTRIBUTIONS,
    "decisions": DECISIONS,
    "usage_totals": USAGE_TOTALS,
    "first_draw_rates": FIRST_DRAW_RATES,
    "half_variance": HALF_VARIANCE,
}
