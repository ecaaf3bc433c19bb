"""Cluster and block tests, paired arms, condition grids, calendar windows and answer scores over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions import parsing, stats
from ..operators import inference, study
from .tables import CLOSES, DRAWS, SCORED, bootstrap_sql, closes, draws, poisson_sql, r, scored, table
from .tables import hash_sql as _hash

REPS = 20


def _dated(df: DataFrame) -> DataFrame:
    """Dates as text, for comparison across engines."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents whose clusters are the good and the bad ones of a source, with two scores."""
    rows = scored(spark, sf_dir)
    return rows.select("lang", "doc_id", "label", F.concat_ws("-", "source", F.col("label").cast("string")).alias("cluster"), "p", ((F.col("doc_id") * 37 % 101) / 101.0).alias("q"))


CLUSTERS = f"{SCORED}, clusters AS (SELECT lang, doc_id, label, source || '-' || label AS cluster, p, (doc_id * 37 % 101) / 101.0::DOUBLE AS q FROM scored)"
#: Places, and weights by replicate, of the clusters of each language.
WEIGHTS = f"""u AS (SELECT lang, cluster, label, row_number() OVER (PARTITION BY lang, label ORDER BY cluster) - 1 AS place, count(*) OVER (PARTITION BY lang, label) AS m FROM (SELECT DISTINCT lang, cluster, label FROM clusters)),
d AS (SELECT lang, label, rep, {_hash('lang', 'rep', 'label', 'place')} % m AS place FROM u, range({REPS}) t(rep)),
w AS (SELECT lang, cluster, rep, count(*) AS w FROM d JOIN u USING (lang, label, place) GROUP BY ALL)"""


def _auc_sql(name: str, source: str, by: str) -> str:
    """A table of by and auc from rows of by, s (score), g (label) and n (weight)."""
    return f"""{name}_v AS (SELECT {by}, s, coalesce(sum(n) FILTER (g = 1), 0)::DOUBLE AS pos, coalesce(sum(n) FILTER (g = 0), 0)::DOUBLE AS neg FROM {source} GROUP BY ALL),
{name}_x AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}_v),
{name} AS (SELECT {by}, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM {name}_x GROUP BY ALL)"""


DETECT = stats.NormalDist().inv_cdf(0.975) + stats.NormalDist().inv_cdf(0.8)


def clustered_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.clustered_auc_interval(_clusters(spark, sf_dir), "p", "label", "cluster", REPS, by=["lang"])
    return out.select("lang", *[r(c).alias(c) for c in ("auc", "low", "high", "standard_error", "detectable")])


CLUSTERED_AUC = f"""WITH {CLUSTERS}, {WEIGHTS},
o AS (SELECT lang, p AS s, label AS g, 1 AS n FROM clusters), b AS (SELECT c.lang, rep, p AS s, label AS g, w AS n FROM clusters c JOIN w ON c.lang = w.lang AND c.cluster = w.cluster),
{_auc_sql('point', 'o', 'lang')}, {_auc_sql('again', 'b', 'lang, rep')},
e AS (SELECT lang, quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high, coalesce(stddev_samp(auc), 0) AS se FROM again GROUP BY 1)
SELECT lang, round(auc, 6) AS auc, round(low, 6) AS low, round(high, 6) AS high, round(se, 6) AS standard_error, CASE WHEN auc IS NOT NULL THEN round(se * {DETECT}::DOUBLE, 6) END AS detectable FROM point JOIN e USING (lang)"""


def auc_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score against a second one on the same resamples, and what follows for the second's use."""
    out = inference.paired_auc_difference(_clusters(spark, sf_dir), "p", "q", "label", "cluster", REPS, by=["lang"])
    answer = inference.decide(F.col("low"), F.col("high"), F.col("lang") == "en", 0.1)
    return out.select("lang", *[r(c).alias(c) for c in ("auc_a", "auc_b", "difference", "low", "high", "standard_error", "detectable", "p")], answer.alias("answer"))


AUC_DIFFERENCE = f"""WITH {CLUSTERS}, {WEIGHTS},
o AS (SELECT lang, 'a' AS side, p AS s, label AS g, 1 AS n, cluster FROM clusters UNION ALL SELECT lang, 'b', q, label, 1, cluster FROM clusters),
b AS (SELECT o.lang, side, rep, s, g, w AS n FROM o JOIN w ON o.lang = w.lang AND o.cluster = w.cluster),
{_auc_sql('point', 'o', 'lang, side')}, {_auc_sql('again', 'b', 'lang, rep, side')},
pd AS (SELECT lang, max(auc) FILTER (side = 'a') AS a, max(auc) FILTER (side = 'b') AS b FROM point GROUP BY 1),
rd AS (SELECT lang, rep, max(auc) FILTER (side = 'a') - max(auc) FILTER (side = 'b') AS d FROM again GROUP BY ALL),
e AS (SELECT lang, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, coalesce(stddev_samp(d), 0) AS se, least(1.0, 2.0 * least(count(*) FILTER (d <= 0) + 1, count(*) FILTER (d >= 0) + 1) / (count(d) + 1)::DOUBLE) AS p FROM rd GROUP BY 1)
SELECT lang, round(a, 6) AS auc_a, round(b, 6) AS auc_b, round(a - b, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, round(se, 6) AS standard_error, round(se * {DETECT}::DOUBLE, 6) AS detectable, round(p, 6) AS p,
  CASE WHEN low > 0 AND lang = 'en' THEN 'improve' WHEN low >= -0.1 AND high <= 0.1 THEN 'match' ELSE 'undecided' END AS answer FROM pd JOIN e USING (lang)"""


def auc_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.permutation_auc_test(_clusters(spark, sf_dir), "p", "label", "cluster", REPS, by=["lang"])
    return out.select("lang", r("auc").alias("auc"), "hits", "n_perms", r("p").alias("p"))


AUC_PERMUTATION = f"""WITH {CLUSTERS}, k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0::DOUBLE AS rk FROM clusters),
u AS (SELECT lang, cluster, any_value(label) AS g, sum(rk) AS rs, count(*) AS n FROM k GROUP BY ALL),
h AS (SELECT lang, sum(n) AS n_all, sum(g) AS m, sum(rs) FILTER (g = 1) AS r1, sum(n) FILTER (g = 1) AS n1 FROM u GROUP BY 1), o AS (SELECT *, (r1 - n1 * (n1 + 1) / 2.0::DOUBLE) / nullif(n1 * (n_all - n1), 0) AS auc FROM h),
q AS (SELECT u.*, rep, row_number() OVER (PARTITION BY lang, rep ORDER BY {_hash('lang', 'rep', 'cluster')}, cluster) AS k FROM u, range({REPS}) t(rep)),
a AS (SELECT q.lang, rep, any_value(auc) AS auc, (sum(rs) - sum(n) * (sum(n) + 1) / 2.0::DOUBLE) / nullif(sum(n) * (any_value(n_all) - sum(n)), 0) AS again FROM q JOIN o ON q.lang = o.lang AND k <= m GROUP BY ALL)
SELECT lang, round(any_value(auc), 6) AS auc, count(*) FILTER (again >= auc - 1e-12) AS hits, count(*) AS n_perms, round((count(*) FILTER (again >= auc - 1e-12) + 1) / (count(*) + 1)::DOUBLE, 6) AS p FROM a GROUP BY lang"""


def loss_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier loss of the score less that of one half, by moving blocks of five documents of each language."""
    rows = scored(spark, sf_dir).select("lang", "doc_id", stats.brier(F.col("p"), F.col("label")).alias("a"), stats.brier(F.lit(0.5), F.col("label")).alias("b"))
    out = inference.paired_loss_difference(rows, "doc_id", "a", "b", 5, REPS, by=["lang"])
    return out.select("lang", "n", *[r(c).alias(c) for c in ("difference", "low", "high", "standard_error", "p")])


LOSS_DIFFERENCE = f"""WITH {SCORED}, k AS (SELECT lang, (p - label) ** 2 - 0.25 AS d, row_number() OVER o - 1 AS place, count(*) OVER (PARTITION BY lang) AS n, sum((p - label) ** 2 - 0.25) OVER (o ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM scored WINDOW o AS (PARTITION BY lang ORDER BY doc_id)),
z AS (SELECT lang, count(*) AS n, avg(d) AS difference FROM k GROUP BY 1),
b AS (SELECT lang, rep, s, least(5, n) AS l, {poisson_sql(_hash('lang', 'rep', 'place'), 'ceil(n / least(5, n)::DOUBLE) / (n - least(5, n) + 1)')} AS w FROM k, range({REPS}) t(rep) WHERE place < n - least(5, n) + 1),
m AS (SELECT lang, rep, sum(w * s) / nullif(sum(w * l), 0) AS m FROM b GROUP BY ALL),
e AS (SELECT lang, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, coalesce(stddev_samp(m), 0) AS se, least(1.0, 2.0 * least(count(*) FILTER (m <= 0) + 1, count(*) FILTER (m >= 0) + 1) / (count(m) + 1)::DOUBLE) AS p FROM m GROUP BY 1)
SELECT lang, n, round(difference, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, round(se, 6) AS standard_error, round(p, 6) AS p FROM z JOIN e USING (lang)"""


def random_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a threshold on the score is right more often than answers at random."""
    rows = scored(spark, sf_dir).select("lang", "doc_id", "label", F.expr("cast(p > 0.4D as int)").alias("answer"))
    out = inference.random_answerer_null(rows, "doc_id", "answer", "label", 2, REPS, by=["lang"])
    return out.select("lang", *[r(c).alias(c) for c in ("observed", "low", "high", "p")])


RANDOM_ANSWERS = f"""WITH {SCORED}, o AS (SELECT lang, avg(((p > 0.4::DOUBLE)::INT = label)::INT) AS observed FROM scored GROUP BY 1),
m AS (SELECT lang, rep, avg(({_hash('rep', 'doc_id')} % 2 = label)::INT) AS share FROM scored, range({REPS}) t(rep) GROUP BY ALL)
SELECT lang, round(any_value(observed), 6) AS observed, round(quantile_cont(share, 0.025), 6) AS low, round(quantile_cont(share, 0.975), 6) AS high, round((count(*) FILTER (share >= observed) + 1) / (count(*) + 1)::DOUBLE, 6) AS p FROM m JOIN o USING (lang) GROUP BY lang"""


def sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the majority share of each source as target: the fewest unanimous draws that certify it, and draws for a split over as many positions as labels."""
    targets = scored(spark, sf_dir).groupBy("source").agg(F.round(F.avg("label") * 0.98, 6).alias("target"), F.countDistinct("n_chars").alias("positions")).filter("target > 0 AND target < 1")
    out = inference.smallest_certifiable_n(targets, "target")
    return out.select("source", "target", "n", inference.smallest_split_n(F.col("positions")).alias("split_n"))


_Z1 = stats.z_value(0.95, "one")
SAMPLE_SIZES = f"""WITH {SCORED}, t AS (SELECT source, round(avg(label) * 0.98::DOUBLE, 6) AS target, count(DISTINCT n_chars) AS positions FROM scored GROUP BY 1),
b AS (SELECT n, (1 + {_Z1 * _Z1}::DOUBLE / (2 * n) - {_Z1}::DOUBLE * sqrt({_Z1 * _Z1}::DOUBLE / (4.0::DOUBLE * n * n))) / (1 + {_Z1 * _Z1}::DOUBLE / n) AS low FROM range(1, 2001) x(n))
SELECT source, target, (SELECT min(n) FROM b WHERE low >= target) AS n, greatest(8, ceil(positions * 1.5))::BIGINT AS split_n FROM t WHERE target > 0 AND target < 1"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean value of each user's day by the parity of the event, as two arms of an item."""
    rows = draws(spark, sf_dir)
    return rows.groupBy("item", F.to_date("ts").alias("day"), (F.col("event_id") % 2).alias("arm")).agg(F.round(F.avg("value"), 6).alias("value"))


ARMS = f"{DRAWS}, arms AS (SELECT item, ts::DATE AS day, event_id % 2 AS arm, round(avg(value), 6) AS value FROM draws GROUP BY ALL), pairs AS (SELECT item, day, max(value) FILTER (arm = 0) AS a, max(value) FILTER (arm = 1) AS b FROM arms GROUP BY ALL)"


def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(study.pair_arms(_arms(spark, sf_dir), ["item", "day"], "arm", "value", 0, 1))


PAIRED_ARMS = f"""WITH {ARMS} SELECT item, day::VARCHAR AS day, a, b, CASE WHEN a IS NULL AND b IS NULL THEN 'both missing' WHEN a IS NULL THEN 'first missing' WHEN b IS NULL THEN 'second missing' ELSE '' END AS reason FROM pairs"""


def arm_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = study.paired_noise(study.pair_arms(_arms(spark, sf_dir), ["item", "day"], "arm", "value", 0, 1), ["item"])
    return out.select("item", "n", r("mean").alias("mean"), r("variance", 4).alias("variance"))


ARM_NOISE = f"""WITH {ARMS} SELECT item, count(*) AS n, round(avg(a - b), 6) AS mean, round(var_samp(a - b), 4) AS variance FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1"""


def arm_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired effect of each user with a bootstrap interval over days, and whether there is enough to say so."""
    pairs = study.pair_arms(_arms(spark, sf_dir), ["item", "day"], "arm", "value", 0, 1)
    out = study.paired_effect(pairs, ["item"], "day", REPS, 8)
    return out.select("item", "planned", "n", *[r(c).alias(c) for c in ("point", "low", "high")], "status")


ARM_EFFECTS = f"""WITH {ARMS}, k AS (SELECT item, day, a - b AS d FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL), {bootstrap_sql('e', 'k', 'item', 'day', 'd', REPS)},
v AS (SELECT item, var_samp(d) AS v FROM k GROUP BY 1), c AS (SELECT item, count(*) AS planned FROM pairs GROUP BY 1),
s AS (SELECT item, planned, coalesce(n, 0) AS n, point, least(point, lo) AS lo, greatest(point, hi) AS hi, CASE WHEN coalesce(n, 0) = 0 THEN 'unavailable' WHEN n < 8 THEN 'inadequate' WHEN coalesce(v, 0) = 0 THEN 'degenerate' ELSE 'estimated' END AS status FROM c LEFT JOIN e USING (item) LEFT JOIN v USING (item))
SELECT item, planned, n, round(point, 6) AS point, CASE WHEN status = 'estimated' THEN round(lo, 6) END AS low, CASE WHEN status = 'estimated' THEN round(hi, 6) END AS high, status FROM s"""


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = draws(spark, sf_dir).select("item", F.concat(F.lit("arm "), F.col("event_id") % 3).alias("arm"), (F.col("answer") != "error").alias("usable"), (F.col("value") > 30).alias("correct"), (F.col("event_id") % 10 / 10.0).alias("confidence"))
    arms = spark.range(4).select(F.concat(F.lit("arm "), F.col("id")).alias("arm"))
    return study.condition_rows(rows, arms, rows, "item", "arm", "usable", "correct", "confidence")


CONDITIONS = f"""{DRAWS}, rows AS (SELECT item, 'arm ' || event_id % 3 AS arm, answer <> 'error' AS usable, value > 30 AS correct, (event_id % 10) / 10.0::DOUBLE AS confidence FROM draws),
done AS (SELECT item, arm, count(*) AS draws, count(*) FILTER (usable) AS n_usable, count(*) FILTER (usable AND correct) AS n_correct, avg(confidence) FILTER (usable) AS confidence FROM rows GROUP BY ALL),
grid AS (SELECT item, arm, coalesce(draws, 0) AS draws, coalesce(n_usable, 0) AS n_usable, coalesce(n_correct, 0) AS n_correct, confidence, CASE WHEN draws IS NULL THEN 'incomplete' WHEN n_usable = 0 THEN 'unusable' ELSE 'usable' END AS state
  FROM (SELECT DISTINCT item FROM rows) CROSS JOIN (SELECT 'arm ' || i AS arm FROM range(4) t(i)) LEFT JOIN done USING (item, arm))"""


def condition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user in every one of four arms, of which the last was never run."""
    return _conditions(spark, sf_dir).select("item", "arm", "draws", "n_usable", "n_correct", r("confidence").alias("confidence"), "state")


CONDITION_ROWS = f"WITH {CONDITIONS} SELECT item, arm, draws, n_usable, n_correct, round(confidence, 6) AS confidence, state FROM grid"


def condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = study.condition_summary(_conditions(spark, sf_dir), "arm")
    return out.select("arm", "planned", "complete", "usable", *[r(c).alias(c) for c in ("coverage", "accuracy_usable", "accuracy_planned", "confidence")])


CONDITION_SUMMARY = f"""WITH {CONDITIONS}, s AS (SELECT *, state = 'usable' AS u, state = 'usable' AND n_correct * 2 > n_usable AS ok FROM grid)
SELECT arm, count(*) AS planned, count(*) FILTER (state <> 'incomplete') AS complete, count(*) FILTER (u) AS usable, round(count(*) FILTER (u) / count(*)::DOUBLE, 6) AS coverage,
  CASE WHEN count(*) FILTER (u) > 0 THEN round(count(*) FILTER (ok) / (count(*) FILTER (u))::DOUBLE, 6) END AS accuracy_usable, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS accuracy_planned, round(avg(confidence), 6) AS confidence FROM s GROUP BY 1"""


def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which state the documents of each source end, the first that holds."""
    text = F.coalesce("text", F.lit(""))
    states = {"empty": text == "", "short": F.length(text) < 300, "other language": F.col("lang") != "en", "numbers": text.rlike("[0-9]{4}")}
    out = study.funnel(table(spark, sf_dir, "documents"), states, "accepted", ["source"])
    return out.select("source", "state", "n", r("share").alias("share"))


ACCEPTANCE = """WITH s AS (SELECT source, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN length(text) < 300 THEN 'short' WHEN lang <> 'en' THEN 'other language' WHEN regexp_matches(text, '[0-9]{4}') THEN 'numbers' ELSE 'accepted' END AS state FROM documents),
g AS (SELECT source, state, count(*) AS n FROM s GROUP BY ALL) SELECT source, state, n, round(n / (sum(n) OVER (PARTITION BY source))::DOUBLE, 6) AS share FROM g"""


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.shared_bins(draws(spark, sf_dir), "value", "answer")


HISTOGRAM = f"""WITH {DRAWS}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM draws)
SELECT answer, least(floor((value - lo) / (hi - lo) * 20), 19)::BIGINT AS bin, count(*) AS n FROM draws, e GROUP BY ALL"""


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(study.buy_and_hold(closes(spark, sf_dir), "ticker", "day", "close").select("ticker", "day", r("value").alias("value")))


HOLDINGS = f"WITH {CLOSES} SELECT ticker, day::VARCHAR AS day, round(close / first_value(close) OVER (PARTITION BY ticker ORDER BY day), 6) AS value FROM closes"


def windows_of_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar windows about the last order days of the nations."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cutoffs = orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy("c_nationkey").agg(F.max(F.to_date("o_orderdate")).alias("cutoff"))
    return _dated(study.filing_windows(cutoffs, "cutoff", "1994-01-15", "2030-03-31"))


WINDOWS_OF_CUTOFFS = """WITH c AS (SELECT c_nationkey, max(o_orderdate::DATE) AS cutoff FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), e AS (SELECT min(cutoff) AS earliest, max(cutoff) AS latest FROM c)
SELECT earliest::VARCHAR AS earliest, latest::VARCHAR AS latest, '1994-01-15' AS exposed_from, (earliest - 1)::VARCHAR AS exposed_to, (latest + 1)::VARCHAR AS control_from, '2030-03-31' AS control_to,
  (date_diff('quarter', DATE '1994-01-15', earliest - 1) + 1)::INT AS exposed_quarters, (date_diff('quarter', latest + 1, DATE '2030-03-31') + 1)::INT AS control_quarters FROM e"""


def sub_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four windows between the first and the last order day of each customer."""
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("first"), F.max(F.to_date("o_orderdate")).alias("last"))
    return _dated(study.sub_windows(spans, "first", "last", 4))


SUB_WINDOWS = """WITH s AS (SELECT o_custkey, min(o_orderdate::DATE) AS first, max(o_orderdate::DATE) AS last FROM orders GROUP BY 1), w AS (SELECT *, i::INT AS window_, ((last - first) // 4)::INT AS width FROM s, range(4) t(i))
SELECT o_custkey, first::VARCHAR AS first, last::VARCHAR AS last, window_ AS "window", least(first + window_ * (width + 1), last)::VARCHAR AS "from", (CASE WHEN window_ = 3 THEN last ELSE least(first + window_ * (width + 1) + width, last) END)::VARCHAR AS "to" FROM w"""


def tilt_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five loadings of each day's types of events, their defensive spread, and whether its lean is that of the mean value."""
    kinds = dict(zip(study.SPREAD, ("click", "view", "error", "signup", "purchase"), strict=True))
    by_day = draws(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(*[(F.count_if(F.col("answer") == k) / F.count("*") - 0.2).alias(axis) for axis, k in kinds.items()], (F.avg("value") - 50).alias("realized"))
    spread = study.defensive_spread({axis: F.col(axis) for axis in kinds})
    out = by_day.withColumn("spread", spread)
    return out.select(F.col("day").cast("string").alias("day"), r("spread").alias("spread"), study.leans(F.col("spread")).alias("defensive"), (study.leans(F.col("spread")) == study.leans(F.col("realized"))).alias("correct"))


TILT_DECISIONS = f"""WITH {DRAWS}, d AS (SELECT ts::DATE AS day, 2.0::DOUBLE * (count(*) FILTER (answer = 'click') / count(*)::DOUBLE - 0.2::DOUBLE) - 3.0::DOUBLE * (count(*) FILTER (answer = 'view') / count(*)::DOUBLE - 0.2::DOUBLE) + 2.8::DOUBLE * (count(*) FILTER (answer = 'error') / count(*)::DOUBLE - 0.2::DOUBLE)
  + 1.7::DOUBLE * (count(*) FILTER (answer = 'signup') / count(*)::DOUBLE - 0.2::DOUBLE) - 2.5::DOUBLE * (count(*) FILTER (answer = 'purchase') / count(*)::DOUBLE - 0.2::DOUBLE) AS spread, avg(value) - 50 AS realized FROM draws GROUP BY 1)
SELECT day::VARCHAR AS day, round(spread, 6) AS spread, round(spread, 9) > 0 AS defensive, (round(spread, 9) > 0) = (round(realized, 9) > 0) AS correct FROM d"""


def answer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final span of each conversation's roles taken as tokens (1 user, 2 assistant, else 3), opened by 1, 2 and closed by 1."""
    code = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", code.alias("code")))), lambda x: x["code"]).alias("tokens"))
    return turns.select("conv_id", study.final_span(F.col("tokens"), [1, 2], [1]).alias("s")).select("conv_id", "s.begin", "s.end", "s.problem")


ANSWER_SPANS = """WITH t AS (SELECT conv_id, list(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END ORDER BY turn, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END) AS k FROM conversations GROUP BY 1),
s AS (SELECT *, list_filter(range(len(k) - 1), lambda i: k[i + 1] = 1 AND k[i + 2] = 2) AS o FROM t), b AS (SELECT *, o[1] + 2 AS lo FROM s), e AS (SELECT *, list_filter(range(len(k)), lambda i: i >= lo AND k[i + 1] = 1)[1] AS hi FROM b),
p AS (SELECT *, CASE WHEN len(o) = 0 THEN 'no span' WHEN len(o) > 1 THEN 'several spans' WHEN hi IS NULL THEN 'open span' WHEN hi = lo THEN 'empty span' ELSE '' END AS problem FROM e)
SELECT conv_id, CASE WHEN problem = '' THEN lo::INT END AS "begin", CASE WHEN problem = '' THEN hi::INT END AS "end", problem FROM p"""


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast errors of a line's price per unit against the part's price of the order's lines, and identity advantages of two arms."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("predicted"), (F.col("l_extendedprice") / F.col("l_quantity") * (1 + F.col("l_tax"))).alias("actual"), F.col("l_extendedprice").alias("last"), (F.col("l_quantity") + 1).alias("rebased"), (F.col("l_discount") + 0.01).alias("scale"))
    out = study.answer_scores(lines, "predicted", "actual", "last", "rebased", "scale")
    return out.select("l_orderkey", "l_linenumber", *[r(c).alias(c) for c in ("relative_error", "observed_return", "signed_error", "normalized_error", "unchanged_error")], "within_1_percent")


ANSWER_SCORES = """WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS p, l_extendedprice / l_quantity * (1 + l_tax) AS a, l_extendedprice AS l, l_quantity + 1 AS b, l_discount + 0.01::DOUBLE AS v FROM lineitem),
e AS (SELECT *, abs(p / a - 1) AS re, ln(a / l) AS obs, ln(p) - ln(b) - ln(a / l) AS se FROM s)
SELECT l_orderkey, l_linenumber, round(re, 6) AS relative_error, round(obs, 6) AS observed_return, round(se, 6) AS signed_error, round(abs(se) / v, 6) AS normalized_error, round(abs(obs) / v, 6) AS unchanged_error, re <= 0.01::DOUBLE AS within_1_percent FROM e"""


def identity_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user and day, the error of odd events less that of even ones, where both have a mean above one."""
    rows = _arms(spark, sf_dir).withColumn("status", F.when(F.col("value") > 1, "parsed").otherwise("invalid"))
    return study.paired_advantage(rows, ["item", "day"], "arm", "status", "value", 0, 1).select("item", F.col("day").cast("string").alias("day"), r("advantage").alias("advantage"))


IDENTITY_ADVANTAGE = f"""WITH {ARMS} SELECT item, day::VARCHAR AS day, round(max(value) FILTER (arm = 1 AND value > 1) - max(value) FILTER (arm = 0 AND value > 1), 6) AS advantage FROM arms GROUP BY ALL"""


def mid_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-ranks of the rounded mean values of each user's types of events."""
    rows = study.rounded_means(draws(spark, sf_dir), ["item", "answer"], "value")
    return study.mid_rank_counts(rows, "value", "answer", "item")


MID_RANKS = f"""WITH {DRAWS}, a AS (SELECT item, answer, round(avg(value), 0) AS value FROM draws GROUP BY ALL), k AS (SELECT answer, rank() OVER (PARTITION BY item ORDER BY value) + (count(*) OVER (PARTITION BY item, value) - 1) / 2.0::DOUBLE AS "rank" FROM a)
SELECT answer, "rank", count(*) AS n FROM k GROUP BY ALL"""

FEATURES = ("p", "q", "toxic", "size")


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("doc_id", "label", "p", ((F.col("doc_id") * 37 % 101) / 101.0).alias("q"), F.col("toxic").cast("double").alias("toxic"), F.log(F.col("n_chars") + 1.0).alias("size"))
    return rows.withColumn("held_out", study.fold(F.col("doc_id"), 3, "split") == 0)


FEATURED = f"""{SCORED}, f AS (SELECT doc_id, label, p, (doc_id * 37 % 101) / 101.0::DOUBLE AS q, toxic::DOUBLE AS toxic, ln(n_chars + 1.0::DOUBLE) AS size, {_hash("'split'", 'doc_id')} % 3 = 0 AS held_out FROM scored),
l AS (SELECT label AS g, held_out, 1 AS n, 'p' AS feature, p AS s FROM f UNION ALL SELECT label, held_out, 1, 'q', q FROM f UNION ALL SELECT label, held_out, 1, 'toxic', toxic FROM f UNION ALL SELECT label, held_out, 1, 'size', size FROM f), {_auc_sql('aucs', 'l', 'held_out, feature')}"""


def feature_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of the features on the calibration split."""
    out = study.feature_aucs(_featured(spark, sf_dir).filter("NOT held_out"), FEATURES, "label")
    return out.select("feature", r("auc").alias("auc"), "sign")


FEATURE_SIGNS = f"WITH {FEATURED} SELECT feature, round(auc, 6) AS auc, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS sign FROM aucs WHERE NOT held_out"


def held_out_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions frozen on the calibration split, applied once to the held-out one."""
    rows = cut(_featured(spark, sf_dir))
    out = study.signed_auc(study.feature_aucs(rows.filter("NOT held_out"), FEATURES, "label"), study.feature_aucs(rows.filter("held_out"), FEATURES, "label"))
    return out.select("feature", "sign", r("auc").alias("auc"))


HELD_OUT_FEATURES = f"""WITH {FEATURED}, z AS (SELECT feature, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS sign FROM aucs WHERE NOT held_out)
SELECT feature, sign, round(CASE WHEN sign = 1 THEN auc ELSE 1 - auc END, 6) AS auc FROM aucs JOIN z USING (feature) WHERE held_out"""


def cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the calibrator in five folds and pooled. Fits are iterative: no SQL."""
    return study.cross_validated_auc(cut(_featured(spark, sf_dir)), FEATURES, "label", "doc_id")


def frozen_calibrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrator of the calibration split on the held-out one: rows, mean probability and Brier score of each class. No SQL."""
    rows = cut(_featured(spark, sf_dir))
    out = study.fitted(rows.filter("NOT held_out"), rows.filter("held_out"), FEATURES, "label")
    return out.groupBy("label").agg(F.count("*").alias("n"), F.avg("p_fitted").alias("mean_p"), F.avg(stats.brier(F.col("p_fitted"), F.col("label"))).alias("brier"))


def scored_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of events (JSON, loose lines, prose, failures), parsed and scored row by row."""
    e = table(spark, sf_dir, "events")
    up, share = F.when(F.col("value") > 50, F.lit("1")).otherwise("-1"), F.format_string("0.%02d", (F.col("event_id") % 100).cast("int"))
    kind = F.col("event_id") % 7
    content = F.when(kind < 3, F.concat(F.lit('{"direction": '), up, F.lit(', "confidence": '), share, F.lit("}"))).when(kind < 5, F.concat(F.lit("DIRECTION: "), up, F.lit("\nCONFIDENCE: "), share)).otherwise("none of it")
    rows = e.select("event_id", F.when(F.col("event_type") == "error", "timeout").otherwise("").alias("status"), content.alias("content"), "value")
    recall = F.when(F.col("value") < 200, F.col("value") / 200)
    out = study.scored_replies(rows, "status", parsing.direction(F.col("content")), parsing.confidence(F.col("content")), recall)
    return out.select("event_id", "fail_reason", F.col("predicted").cast("int").alias("predicted"), *[r(c, 9).alias(c) for c in ("confidence", "p_recall", "penalised")])


SCORED_REPLIES = r"""WITH c AS (SELECT event_id, event_type = 'error' AS late, value, CASE WHEN event_id % 7 < 3 THEN '{"direction": ' || CASE WHEN value > 50 THEN '1' ELSE '-1' END || ', "confidence": 0.' || lpad((event_id % 100)::VARCHAR, 2, '0') || '}'
  WHEN event_id % 7 < 5 THEN 'DIRECTION: ' || CASE WHEN value > 50 THEN '1' ELSE '-1' END || chr(10) || 'CONFIDENCE: 0.' || lpad((event_id % 100)::VARCHAR, 2, '0') ELSE 'none of it' END AS t FROM events),
p AS (SELECT *, nullif(regexp_extract(t, '(?i)"?direction"?: (-?[01])', 1), '')::INT AS d, nullif(regexp_extract(t, '(?i)"?confidence"?: ([0-9.]+)', 1), '')::DOUBLE AS k, CASE WHEN value < 200 THEN value / 200 END AS m FROM c),
f AS (SELECT *, CASE WHEN late THEN 'timeout' WHEN d IS NULL OR k IS NULL THEN 'parse' WHEN m IS NULL THEN 'error' END AS fail_reason FROM p)
SELECT event_id, fail_reason, CASE WHEN fail_reason IS NULL THEN d END AS predicted, CASE WHEN fail_reason IS NULL THEN round(k, 9) END AS confidence, CASE WHEN fail_reason IS NULL THEN round(m, 9) END AS p_recall, CASE WHEN fail_reason IS NULL THEN round(k * (1 - m), 9) END AS penalised FROM f"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        clustered_auc, auc_difference, auc_permutation, loss_difference, random_answers, sample_sizes, paired_arms, arm_noise, arm_effects, condition_rows, condition_summary, acceptance, histogram, holdings,
        windows_of_cutoffs, sub_windows, tilt_decisions, answer_spans, answer_scores, identity_advantage, mid_ranks, feature_signs, held_out_features, cross_validated, frozen_calibrator, scored_replies,
    )
}
ORACLE_SQL: dict[str, str] = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
