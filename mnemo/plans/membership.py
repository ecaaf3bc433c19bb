"""Labels, scores, effect sizes, calibration and rank filters over documents and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import calibrate, metrics, rank
from .tables import SCORED, r, scored, table

Z = stats.z_value()


def effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect size of each (source, feature) between good and bad documents; a source without rows on a side stays."""
    rows = scored(spark, sf_dir).select("source", F.expr("label = 1").alias("inside"), F.expr("stack(2, 'n_chars', cast(n_chars as double), 'p', p) as (feature, value)"))
    out = metrics.effect_size(rows, "value", "inside", ["source", "feature"])
    return out.select("source", "feature", "n_in", "n_out", r("mean_in"), r("mean_out"), r("pooled"), r("d"), "note").toDF("source", "feature", "n_in", "n_out", "mean_in", "mean_out", "pooled", "d", "note")


EFFECT_SIZES = f"""WITH {SCORED},
l AS (SELECT source, 'n_chars' AS feature, n_chars::DOUBLE AS v, label FROM scored UNION ALL SELECT source, 'p', p, label FROM scored),
a AS (SELECT source, feature, count(v) FILTER (label = 1) AS n_in, count(v) FILTER (label <> 1) AS n_out, avg(v) FILTER (label = 1) AS mean_in, avg(v) FILTER (label <> 1) AS mean_out,
  var_samp(v) FILTER (label = 1) AS vi, var_samp(v) FILTER (label <> 1) AS vo FROM l GROUP BY ALL),
b AS (SELECT *, CASE WHEN n_in >= 2 AND n_out >= 2 THEN sqrt(((n_in - 1) * vi + (n_out - 1) * vo) / (n_in + n_out - 2)) END AS pooled FROM a)
SELECT source, feature, n_in, n_out, round(mean_in, 6) AS mean_in, round(mean_out, 6) AS mean_out, round(pooled, 6) AS pooled,
  CASE WHEN pooled > 0 THEN round((mean_in - mean_out) / pooled, 6) END AS d, CASE WHEN coalesce(pooled > 0, false) THEN '' ELSE 'insufficient samples' END AS note FROM b"""


def rank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop the top fifth of all documents by score, of ties the later ones first."""
    return rank.rank_filter(scored(spark, sf_dir), "p", "doc_id", 0.8).select("doc_id", r("p").alias("p"), r("threshold").alias("threshold"))


RANK_FILTER = f"""WITH {SCORED}, k AS (SELECT *, row_number() OVER (ORDER BY p, doc_id) AS rn, count(*) OVER () AS n FROM scored)
SELECT doc_id, round(p, 6) AS p, round((SELECT quantile_cont(p, 0.8) FROM scored), 6) AS threshold FROM k WHERE rn <= n - floor(round(0.2::DOUBLE * n, 9))"""


def rank_filter_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within each source."""
    return rank.rank_filter(scored(spark, sf_dir), "p", "doc_id", 0.8, ["source"]).select("source", "doc_id", r("p").alias("p"), r("threshold").alias("threshold"))


RANK_FILTER_BY_SOURCE = f"""WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n, quantile_cont(p, 0.8) OVER (PARTITION BY source) AS threshold FROM scored)
SELECT source, doc_id, round(p, 6) AS p, round(threshold, 6) AS threshold FROM k WHERE rn <= n - floor(round(0.2::DOUBLE * n, 9))"""


def auc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rank_auc(scored(spark, sf_dir), "n_chars", "label", ["lang"]).select("lang", "n_positive", "n_negative", r("auc").alias("auc"))


AUC_BY_LANGUAGE = f"""WITH {SCORED}, k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS rk FROM scored),
s AS (SELECT lang, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative, sum(rk) FILTER (label = 1) AS w FROM k GROUP BY 1)
SELECT lang, n_positive, n_negative, CASE WHEN n_positive > 0 AND n_negative > 0 THEN round((w - n_positive * (n_positive + 1) / 2.0::DOUBLE) / (n_positive * n_negative), 6) END AS auc FROM s"""


def accuracy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of a threshold on the score over the documents long enough to judge, with a Wilson interval."""
    rows = scored(spark, sf_dir).select("source", "label", F.expr("cast(p > 0.4D as int)").alias("predicted"), F.expr("n_chars >= 300").alias("usable"))
    out = metrics.accuracy(rows, "predicted", "label", "usable", ["source"])
    return out.select("source", "n", "n_usable", "n_correct", *[r(c).alias(c) for c in ("usable_share", "accuracy", "low", "high")])


def _wilson(k: str, n: str, sign: str) -> str:
    bound = f"({k} / {n}::DOUBLE + {Z * Z} / (2 * {n}) {sign} {Z} * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + {Z * Z} / (4.0::DOUBLE * {n} * {n}))) / (1 + {Z * Z} / {n})"
    return f"greatest(0.0, {bound})" if sign == "-" else f"least(1.0, {bound})"


ACCURACY_BY_SOURCE = f"""WITH {SCORED}, a AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars >= 300) AS n_usable, count(*) FILTER (n_chars >= 300 AND (p > 0.4::DOUBLE)::INT = label) AS n_correct FROM scored GROUP BY 1)
SELECT source, n, n_usable, n_correct, round(n_usable / n::DOUBLE, 6) AS usable_share, CASE WHEN n_usable > 0 THEN round(n_correct / n_usable::DOUBLE, 6) END AS accuracy,
  CASE WHEN n_usable > 0 THEN round({_wilson('n_correct', 'n_usable', '-')}, 6) END AS low, CASE WHEN n_usable > 0 THEN round({_wilson('n_correct', 'n_usable', '+')}, 6) END AS high FROM a"""


def calibration_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration(scored(spark, sf_dir), "p", "label", ["lang"]).select("lang", "n", *[r(c).alias(c) for c in ("brier", "base_brier", "ece")])


CALIBRATION_BY_LANGUAGE = f"""WITH {SCORED}, b AS (SELECT lang, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS sp, sum(label) AS sy, sum((p - label) * (p - label)) AS sb FROM scored GROUP BY ALL)
SELECT lang, sum(n)::BIGINT AS n, round(sum(sb) / sum(n), 6) AS brier, round(sum(sy) / sum(n) * (1 - sum(sy) / sum(n)), 6) AS base_brier, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM b GROUP BY 1"""


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reliability_curve(scored(spark, sf_dir), "p", "label").select("bin", "n", r("mean_p").alias("mean_p"), r("rate").alias("rate"))


RELIABILITY = f"""WITH {SCORED} SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(label), 6) AS rate FROM scored GROUP BY 1"""


def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.majority_baseline(scored(spark, sf_dir), "toxic", ["source"]).select("source", "majority", "n", r("share").alias("share"))


MAJORITY = f"""WITH {SCORED}, g AS (SELECT source, toxic, count(*) AS k FROM scored GROUP BY ALL),
c AS (SELECT *, sum(k) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY k DESC, toxic) AS rn FROM g)
SELECT source, toxic AS majority, n::BIGINT AS n, round(k / n::DOUBLE, 6) AS share FROM c WHERE rn = 1"""


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Brier and log loss of raw and of shrunk probabilities, and their paired difference."""
    rows = scored(spark, sf_dir).withColumn("q", calibrate.shrunk(F.col("p"), F.lit(0.3)))
    y = F.col("label")
    return rows.groupBy("lang").agg(
        r(F.avg(stats.brier(F.col("p"), y))).alias("brier_raw"), r(F.avg(stats.brier(F.col("q"), y))).alias("brier_shrunk"), r(F.avg(stats.log_loss(F.col("p"), y))).alias("log_raw"), r(F.avg(stats.log_loss(F.col("q"), y))).alias("log_shrunk"), r(F.avg(stats.brier(F.col("q"), y) - stats.brier(F.col("p"), y))).alias("difference")
    )


LOSSES = f"""WITH {SCORED}, q AS (SELECT *, 0.5 + (p - 0.5) * 0.7::DOUBLE AS q FROM scored)
SELECT lang, round(avg((p - label) ** 2), 6) AS brier_raw, round(avg((q - label) ** 2), 6) AS brier_shrunk, round(avg(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)), 6) AS log_raw,
  round(avg(-ln(CASE WHEN label = 1 THEN q ELSE 1 - q END)), 6) AS log_shrunk, round(avg((q - label) ** 2 - (p - label) ** 2), 6) + 0.0 AS difference FROM q GROUP BY 1"""


def holm_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's adjustment over the sources' shares taken as p-values; sources with few rows have none."""
    tests = scored(spark, sf_dir).groupBy("lang", "source").agg(F.round(F.avg(1 - F.col("p")) * 0.2, 9).alias("p"), F.count("*").alias("n")).withColumn("p", F.when(F.col("n") >= 3, F.col("p")))
    return metrics.holm(tests, "p", "source", ["lang"]).select("lang", "source", r("p").alias("p"), r("adjusted").alias("adjusted"))


HOLM_ADJUSTED = f"""WITH {SCORED}, a AS (SELECT lang, source, CASE WHEN count(*) >= 3 THEN round(avg(1 - p) * 0.2::DOUBLE, 9) END AS p FROM scored GROUP BY ALL),
k AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY lang) - row_number() OVER (PARTITION BY lang ORDER BY p, source) + 1)) AS s FROM a WHERE p IS NOT NULL)
SELECT lang, source, round(p, 6) AS p, round(max(s) OVER (PARTITION BY lang ORDER BY p, source), 6) AS adjusted FROM k UNION ALL SELECT lang, source, NULL, NULL FROM a WHERE p IS NULL"""


def reweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance-weighted shares of labels with weights (toxic count / all) ** alpha by source."""
    rows = scored(spark, sf_dir).groupBy("lang", "source", "label").agg(F.count("*").alias("older"), (F.sum("toxic") + 1).alias("newer"))
    return metrics.effective_weights(rows, "label", "older", "newer", 0.5, ["lang"]).select("lang", "label", *[r(c).alias(c) for c in ("share", "effective_n", "top_weight")])


REWEIGHTED = f"""WITH {SCORED}, c AS (SELECT lang, source, label, count(*) AS o, sum(toxic) + 1 AS n FROM scored GROUP BY ALL), w AS (SELECT lang, label, pow(o / n::DOUBLE, 0.5) AS w FROM c),
s AS (SELECT lang, label, sum(w) AS w, sum(w * w) AS w2, max(w) AS t FROM w GROUP BY ALL)
SELECT lang, label, round(w / sum(w) OVER (PARTITION BY lang), 6) AS share, round(pow(sum(w) OVER (PARTITION BY lang), 2) / sum(w2) OVER (PARTITION BY lang), 6) AS effective_n,
  round(max(t) OVER (PARTITION BY lang) / sum(w) OVER (PARTITION BY lang), 6) AS top_weight FROM s"""


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two length scores of each source's documents."""
    rows = scored(spark, sf_dir).withColumn("q", F.col("n_chars") / (F.col("n_chars") + 900.0))
    return metrics.agreement(rows, "p", "q", ["lang"]).select("lang", "n", *[r(c).alias(c) for c in ("bias", "low", "high", "mean_abs", "spearman")])


AGREEMENT = f"""WITH {SCORED}, q AS (SELECT *, n_chars / (n_chars + 900.0::DOUBLE) AS q FROM scored),
k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY lang ORDER BY q) + (count(*) OVER (PARTITION BY lang, q) - 1) / 2.0::DOUBLE AS rb FROM q)
SELECT lang, count(*) AS n, round(avg(p - q), 6) AS bias, round(avg(p - q) - 1.96 * stddev_samp(p - q), 6) AS low, round(avg(p - q) + 1.96 * stddev_samp(p - q), 6) AS high, round(avg(abs(p - q)), 6) AS mean_abs, round(corr(ra, rb), 6) AS spearman FROM k GROUP BY 1"""


def control_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features standardised against a control baseline: the good, not toxic documents of each language."""
    rows = scored(spark, sf_dir).withColumn("size", F.log(F.col("n_chars").cast("double") + 1))
    base = calibrate.control_baseline(rows.filter("label = 1 AND toxic = 0"), ["size", "p"], ["lang"])
    return calibrate.standardise(rows, base, ["size", "p"], ["lang"]).select("doc_id", "lang", r("z_size").alias("z_size"), r("z_p").alias("z_p"))


CONTROL_Z = f"""WITH {SCORED}, s AS (SELECT *, ln(n_chars::DOUBLE + 1) AS size FROM scored), b AS (SELECT lang, avg(size) AS ms, greatest(stddev_pop(size), 1e-6) AS ss, avg(p) AS mp, greatest(stddev_pop(p), 1e-6) AS sp FROM s WHERE label = 1 AND toxic = 0 GROUP BY 1)
SELECT doc_id, lang, round((size - ms) / ss, 6) + 0.0 AS z_size, round((p - mp) / sp, 6) + 0.0 AS z_p FROM s LEFT JOIN b USING (lang)"""


def calibrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced logistic calibrator of the labels on two standardised features, applied to its rows."""
    rows = control_z(spark, sf_dir).join(scored(spark, sf_dir).select("doc_id", "label"), "doc_id")
    weights = calibrate.fit_logistic(rows, ["z_size", "z_p"], "label")
    return rows.select("doc_id", "label", F.round(calibrate.predict(weights, ["z_size", "z_p"]), 5).alias("p_recall"))


def gate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as candidates: gates on size, toxic share and accuracy, a composite score, and the best three."""
    rows = scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.avg("label").alias("good"), F.avg("toxic").alias("toxic"), F.avg("p").alias("p"))
    gated = rank.gates(rows, [("too few rows", F.col("n") >= 15), ("low quality", F.col("good") >= 0.75), ("toxic", F.col("toxic") <= 0.25)])
    ranked = rank.composite_top(gated.withColumn("clean", 1 - F.col("toxic")), ["good", "clean", "p"], "source")
    return ranked.select("source", "n", F.array_join("failed", "; ").alias("failed"), r("composite").alias("composite"), F.col("place").cast("long").alias("place"))


GATE_RANKING = f"""WITH {SCORED}, a AS (SELECT source, count(*) AS n, avg(label) AS good, avg(toxic) AS toxic, avg(p) AS p FROM scored GROUP BY 1),
g AS (SELECT *, concat_ws('; ', CASE WHEN n < 15 THEN 'too few rows' END, CASE WHEN good < 0.75 THEN 'low quality' END, CASE WHEN toxic > 0.25 THEN 'toxic' END) AS failed FROM a),
c AS (SELECT *, CASE WHEN failed = '' THEN good * (1 - toxic) * p ELSE 0 END AS composite FROM g), t AS (SELECT source, row_number() OVER (ORDER BY composite DESC, source) AS place FROM c WHERE failed = '')
SELECT source, n, failed, round(composite, 6) AS composite, CASE WHEN place <= 3 THEN place END AS place FROM c LEFT JOIN t USING (source)"""


def qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-valued rule over sources: enough rows, a gap, and a p that may be unknown."""
    rows = scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.avg(F.when(F.col("label") == 1, F.col("p"))).alias("inside"), F.avg(F.when(F.col("label") == 0, F.col("p"))).alias("after"))
    checks = [("sample", F.when(F.col("n") >= 5, F.col("n") >= 12)), ("separation", F.col("inside") > F.col("after"))]
    return rank.qualify(rows, checks, F.col("inside").isNotNull()).select("source", "n", "status", "detail")


QUALIFICATION = f"""WITH {SCORED}, a AS (SELECT source, count(*) AS n, avg(p) FILTER (label = 1) AS i, avg(p) FILTER (label = 0) AS o FROM scored GROUP BY 1),
c AS (SELECT source, n, i IS NOT NULL AS tested, CASE WHEN n >= 5 THEN n >= 12 END AS c1, i > o AS c2 FROM a)
SELECT source, n, CASE WHEN NOT tested THEN 'not_tested' WHEN c1 = false OR c2 = false THEN 'not_qualified' WHEN c1 IS NULL OR c2 IS NULL THEN 'not_tested' ELSE 'qualified' END AS status,
  CASE WHEN NOT tested THEN 'no quality record' WHEN c1 = false THEN 'sample' WHEN c2 = false THEN 'separation' WHEN c1 IS NULL THEN 'sample' WHEN c2 IS NULL THEN 'separation' ELSE '' END AS detail FROM c"""


def grouped_and_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of each language and of all together."""
    return scored(spark, sf_dir).groupingSets([["lang"], []], "lang").agg(F.count("*").alias("n"), r(F.avg("label")).alias("good"), r(F.avg("toxic")).alias("toxic"))


GROUPED_AND_POOLED = f"WITH {SCORED} SELECT lang, count(*) AS n, round(avg(label), 6) AS good, round(avg(toxic), 6) AS toxic FROM scored GROUP BY GROUPING SETS ((lang), ())"


def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity of a join: ids of documents without a label and labels without a document, counted by side."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return metrics.pairing_check(docs, labels, ["doc_id"]).groupBy("side").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


UNMATCHED = """SELECT side, count(*) AS n, min(doc_id) AS first_id FROM (SELECT 'a' AS side, doc_id FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT 'b', doc_id FROM labels ANTI JOIN documents USING (doc_id)) GROUP BY 1"""

QUERIES = {
    "effect_sizes": effect_sizes,
    "rank_filter": rank_filter,
    "rank_filter_by_source": rank_filter_by_source,
    "auc_by_language": auc_by_language,
    "accuracy_by_source": accuracy_by_source,
    "calibration_by_language": calibration_by_language,
    "reliability": reliability,
    "majority": majority,
    "losses": losses,
    "holm_adjusted": holm_adjusted,
    "reweighted": reweighted,
    "agreement": agreement,
    "control_z": control_z,
    "calibrator": calibrator,
    "gate_ranking": gate_ranking,
    "qualification": qualification,
    "grouped_and_pooled": grouped_and_pooled,
    "unmatched": unmatched,
}
ORACLE_SQL = {
    "effect_sizes": EFFECT_SIZES,
    "rank_filter": RANK_FILTER,
    "rank_filter_by_source": RANK_FILTER_BY_SOURCE,
    "auc_by_language": AUC_BY_LANGUAGE,
    "accuracy_by_source": ACCURACY_BY_SOURCE,
    "calibration_by_language": CALIBRATION_BY_LANGUAGE,
    "reliability": RELIABILITY,
    "majority": MAJORITY,
    "losses": LOSSES,
    "holm_adjusted": HOLM_ADJUSTED,
    "reweighted": REWEIGHTED,
    "agreement": AGREEMENT,
    "control_z": CONTROL_Z,
    "gate_ranking": GATE_RANKING,
    "qualification": QUALIFICATION,
    "grouped_and_pooled": GROUPED_AND_POOLED,
    "unmatched": UNMATCHED,
}
