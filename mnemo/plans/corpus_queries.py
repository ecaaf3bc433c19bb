"""Corpus building and resampling over documents, orders and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corpus, resample
from .tables import CLOSES, SCORED, bootstrap_sql, closes, hash_sql, poisson_sql, r, scored, table

_EARLY, _LATE, _TODAY = "1996-12-31", "1998-06-30", "2001-01-01"


def cutoff_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders labelled by two cutoffs, under each meaning of the cutoff day."""
    day = F.to_date("o_orderdate")
    orders = table(spark, sf_dir, "orders")
    parts = [orders.select(F.lit(b).alias("boundary"), corpus.cutoff_label(day, F.lit(_EARLY).cast("date"), F.lit(_LATE).cast("date"), b, F.lit(_TODAY).cast("date")).alias("label")) for b in ("in_sample", "dropped", "post")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("boundary", "label").agg(F.count("*").alias("n")).select("boundary", F.col("label").cast("long").alias("label"), "n")


CUTOFF_LABELS = f"""WITH o AS (SELECT b AS boundary, o_orderdate::DATE AS d FROM orders, (VALUES ('in_sample'), ('dropped'), ('post')) t(b)),
l AS (SELECT boundary, CASE WHEN d < DATE '{_EARLY}' OR (boundary = 'in_sample' AND d = DATE '{_EARLY}') THEN 1 WHEN (d > DATE '{_LATE}' OR (boundary = 'post' AND d = DATE '{_LATE}')) AND d <= DATE '{_TODAY}' THEN 0 END AS label FROM o)
SELECT boundary, label, count(*) AS n FROM l GROUP BY ALL"""


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents deduplicated by their exact text and then by their first line, the first in order staying."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("text_hash"), F.sha2(F.lower(F.trim(F.substring_index("text", "\n", 1))), 256).alias("title_hash"))
    return corpus.dedup_first(docs, ["text_hash", "title_hash"], ["doc_id"]).select("doc_id", "lang")


DEDUPLICATED = """WITH d AS (SELECT doc_id, lang, sha256(text) AS h, sha256(lower(trim(split_part(text, chr(10), 1), ' '))) AS t FROM documents), a AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS rn FROM d),
b AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS rm FROM a WHERE rn = 1) SELECT doc_id, lang FROM b WHERE rm = 1"""


def greedy_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders accepted in order, a later one going if an accepted one has its customer's month or its clerk's day."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", F.concat_ws("-", "o_custkey", F.date_format("o_orderdate", "yyyy")).alias("a"), F.concat_ws("-", F.to_date("o_orderdate").cast("string"), "o_orderpriority").alias("b"))
    return corpus.dedup_greedy(rows, "a", "b", ["o_orderkey"]).select("o_orderkey")


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proportional sample of labelled documents, one of each (language, label) at least."""
    return corpus.stratified_sample(scored(spark, sf_dir), ["lang", "label"], "doc_id", 60, "sample").select("doc_id", "lang", "label")


STRATIFIED = f"""WITH {SCORED}, k AS (SELECT doc_id, lang, label, row_number() OVER (PARTITION BY lang, label ORDER BY md5('sample:' || doc_id::VARCHAR), doc_id) AS rn, count(*) OVER (PARTITION BY lang, label) AS n, count(*) OVER () AS t FROM scored)
SELECT doc_id, lang, label FROM k WHERE rn <= greatest(1, round(n * 60 / t::DOUBLE))"""


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole quotas of 500 by source in proportion to characters, by largest remainder."""
    strata = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"))
    return corpus.largest_remainder(strata, ["source"], "chars", 500)


QUOTAS = """WITH s AS (SELECT source, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1), e AS (SELECT *, chars * 500 / sum(chars) OVER ()::DOUBLE AS x FROM s),
k AS (SELECT *, floor(x)::BIGINT AS f, 500 - sum(floor(x)::BIGINT) OVER () AS l, row_number() OVER (ORDER BY x - floor(x) DESC, source) AS rn FROM e)
SELECT source, chars, (f + CASE WHEN rn <= l THEN 1 ELSE 0 END)::BIGINT AS quota FROM k"""


def capped_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most seven documents of a source in hash order, with the round in which each is taken."""
    out = corpus.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", "pool", 7)
    return out.select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


CAPPED_POOLS = """WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('pool:' || doc_id::VARCHAR), doc_id) AS turn FROM documents) SELECT * FROM k WHERE turn <= 7"""


def held_out_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.hash_split(scored(spark, sf_dir), ["label"], "doc_id", "split", 0.25).select("doc_id", "label", "held_out")


HELD_OUT_SPLIT = f"""WITH {SCORED} SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('split:' || doc_id::VARCHAR), doc_id) <= round(count(*) OVER (PARTITION BY label) * 0.25::DOUBLE) AS held_out FROM scored"""


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each (user, type) of an append-only log."""
    out = corpus.latest_version(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", r("value").alias("value"), F.col("first_seen.event_id").alias("first_id"))


LATEST_EVENTS = """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value, arg_min(event_id, (ts, event_id)) AS first_id FROM events GROUP BY ALL"""


def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each language with a bootstrap interval over 50 hash replicates."""
    out = resample.bootstrap(scored(spark, sf_dir), ["lang"], "doc_id", "p", 50)
    return out.select("lang", "n", *[r(c).alias(c) for c in ("point", "low", "high")])


BOOTSTRAP_MEANS = f"""WITH {SCORED}, {bootstrap_sql('b', 'scored', 'lang', 'doc_id', 'p', 50)}
SELECT lang, n, round(point, 6) AS point, round(CASE WHEN n > 1 THEN least(point, lo) ELSE point END, 6) AS low, round(CASE WHEN n > 1 THEN greatest(point, hi) ELSE point END, 6) AS high FROM b"""


def bootstrap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several statistics of the daily changes of each ticker's close by name, each with a bootstrap interval."""
    daily = closes(spark, sf_dir)
    change = daily.withColumn("change", F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("day")) - 1).filter("change IS NOT NULL").withColumn("unit", F.col("day").cast("string"))
    parts = [resample.bootstrap(change, ["ticker"], "unit", "change", 20, name).withColumn("statistic", F.lit(name)) for name in ("sharpe", "mean_bps", "share_positive", "sd")]
    return reduce(DataFrame.unionByName, parts).select("ticker", "statistic", "n", *[r(c).alias(c) for c in ("point", "low", "high")])


BOOTSTRAP_STATISTICS = f"""WITH {CLOSES}, c AS (SELECT ticker, day::VARCHAR AS unit, close / lag(close) OVER (PARTITION BY ticker ORDER BY day) - 1 AS x FROM closes QUALIFY x IS NOT NULL),
d AS (SELECT ticker, rep, x, CASE WHEN rep < 0 THEN 1 ELSE {poisson_sql(hash_sql('ticker', 'rep', 'unit'))} END AS w FROM c, range(-1, 20) t(rep)),
m AS (SELECT ticker, rep, sum(w)::DOUBLE AS w, sum(w * x) AS s, sum(w * x * x) AS ss, sum(w * (x > 0)::INT) AS up FROM d GROUP BY ALL),
v AS (SELECT *, CASE WHEN w > 1 THEN sqrt(greatest(0, (ss - s * s / w) / (w - 1))) END AS sd FROM m),
l AS (SELECT ticker, rep, w, 'sharpe' AS statistic, CASE WHEN w > 0 THEN coalesce(CASE WHEN sd > 0 THEN sqrt(252) * s / w / sd END, 0) END AS x FROM v UNION ALL SELECT ticker, rep, w, 'mean_bps', s / nullif(w, 0) * 1e4 FROM v
  UNION ALL SELECT ticker, rep, w, 'share_positive', up / nullif(w, 0) FROM v UNION ALL SELECT ticker, rep, w, 'sd', sd FROM v),
g AS (SELECT ticker, statistic, max(w) FILTER (rep < 0) AS n, max(x) FILTER (rep < 0) AS point, quantile_cont(x, 0.025) FILTER (rep >= 0) AS lo, quantile_cont(x, 0.975) FILTER (rep >= 0) AS hi FROM l GROUP BY ALL)
SELECT ticker, statistic, n::BIGINT AS n, round(point, 6) AS point, round(CASE WHEN n > 1 THEN least(point, lo) ELSE point END, 6) AS low, round(CASE WHEN n > 1 THEN greatest(point, hi) ELSE point END, 6) AS high FROM g"""


def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether good documents score higher, permuting documents within each language 40 times."""
    rows = scored(spark, sf_dir).select("lang", "doc_id", "p", "label")
    out = resample.permutation_test(rows, ["lang"], "doc_id", "p", "label", 40)
    return out.select("lang", r("difference").alias("difference"), "hits", "n_perms", r("p").alias("p_value"))


PERMUTATION = f"""WITH {SCORED}, o AS (SELECT lang, sum(p) FILTER (label = 1) AS s1, count(*) FILTER (label = 1) AS c1, sum(p) AS s, count(*) AS c FROM scored GROUP BY 1),
k AS (SELECT lang, rep, p, row_number() OVER (PARTITION BY lang, rep ORDER BY ('0x' || substr(md5(rep || '-' || doc_id), 1, 8))::BIGINT, doc_id) AS rn FROM scored, range(40) t(rep)),
m AS (SELECT k.lang, rep, sum(p) AS p1, any_value(o.c1) AS q1, any_value(o.s) AS s, any_value(o.c) AS c, any_value(o.s1 / o.c1 - (o.s - o.s1) / nullif(o.c - o.c1, 0)) AS difference FROM k JOIN o ON k.lang = o.lang AND rn <= c1 GROUP BY ALL)
SELECT lang, round(any_value(difference), 6) + 0.0 AS difference, count(*) FILTER (p1 / q1 - (s - p1) / nullif(c - q1, 0) >= difference - 1e-12) AS hits, count(*) AS n_perms,
  round((count(*) FILTER (p1 / q1 - (s - p1) / nullif(c - q1, 0) >= difference - 1e-12) + 1) / (count(*) + 1)::DOUBLE, 6) AS p_value FROM m GROUP BY lang"""


def numpy_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numpy bootstrap intervals of the mean score of each language, over rows and over blocks of ten."""
    rows = scored(spark, sf_dir).select("lang", "doc_id", "p")
    plain = resample.grouped_interval(rows, ["lang"], "doc_id", "p", n=200).withColumn("mode", F.lit("rows"))
    blocks = resample.grouped_interval(rows, ["lang"], "doc_id", "p", n=200, block=10).withColumn("mode", F.lit("blocks"))
    return plain.unionByName(blocks)


def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated power of designs whose noise is the spread of each event type's values."""
    designs = table(spark, sf_dir, "events").groupBy("event_type").agg(F.stddev_samp("value").alias("noise_sd")).select((F.col("noise_sd") / 5).alias("effect"), "noise_sd", F.lit(40).cast("long").alias("n_items"))
    return resample.simulated_power(designs, 500)


def binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact chance of as many good documents as each source has, at a rate of 0.8."""
    rows = scored(spark, sf_dir).groupBy("source").agg(F.sum("label").alias("k"), F.count("*").alias("n"))
    return rows.select("source", "k", "n", r(resample.binomial_tail(F.col("k"), F.col("n"), 0.8)).alias("p"))


BINOMIAL = f"""WITH {SCORED}, a AS (SELECT source, sum(label)::BIGINT AS k, count(*) AS n FROM scored GROUP BY 1)
SELECT source, k, n, round(least(1.0, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.8) + (n - i) * ln(0.2))))), 6) AS p FROM a"""


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by source and window of 100 ids, and whether a text stands in another window too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.floor(F.col("doc_id") / 100).alias("window"), F.sha2("text", 256).alias("h"))
    cross = docs.groupBy("h").agg(F.countDistinct("window").alias("windows"))
    return docs.join(cross, "h").groupBy("source", "window").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("windows") > 1).alias("n_crossing"))


CORPUS_COUNTS = """WITH d AS (SELECT doc_id, source, n_chars, doc_id // 100 AS w, text FROM documents), c AS (SELECT text, count(DISTINCT w) AS k FROM d GROUP BY 1)
SELECT source, w AS "window", count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (k > 1) AS n_crossing FROM d JOIN c USING (text) GROUP BY ALL"""

QUERIES = {
    "cutoff_labels": cutoff_labels,
    "deduplicated": deduplicated,
    "greedy_deduplicated": greedy_deduplicated,
    "stratified": stratified,
    "quotas": quotas,
    "capped_pools": capped_pools,
    "held_out_split": held_out_split,
    "latest_events": latest_events,
    "bootstrap_means": bootstrap_means,
    "bootstrap_statistics": bootstrap_statistics,
    "permutation": permutation,
    "numpy_intervals": numpy_intervals,
    "power": power,
    "binomial": binomial,
    "corpus_counts": corpus_counts,
}
ORACLE_SQL = {
    "cutoff_labels": CUTOFF_LABELS,
    "deduplicated": DEDUPLICATED,
    "stratified": STRATIFIED,
    "quotas": QUOTAS,
    "capped_pools": CAPPED_POOLS,
    "held_out_split": HELD_OUT_SPLIT,
    "latest_events": LATEST_EVENTS,
    "bootstrap_means": BOOTSTRAP_MEANS,
    "bootstrap_statistics": BOOTSTRAP_STATISTICS,
    "permutation": PERMUTATION,
    "binomial": BINOMIAL,
    "corpus_counts": CORPUS_COUNTS,
}
