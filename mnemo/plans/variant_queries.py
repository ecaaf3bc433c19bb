"""Variants of decisions, their summary, a manifest of files and an account of planned keys, over documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifest, variants
from .tables import SCORED, r, scored, table

LEAST = 6


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents are an item's draws, of which a quarter of the items may split; a seventh of the draws is not parsed."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select(F.expr("doc_id div 8").alias("item"), (F.col("doc_id") % 8).alias("k"), "n_chars")
    value = F.when(F.col("n_chars") % 7 > 0, F.col("n_chars") % 5 - 2 + F.when((F.col("item") % 4 == 0) & (F.col("n_chars") % 2 == 0), 12).otherwise(0))
    full = F.when(F.col("n_chars") % 3 == 0, 1.0).when(F.col("n_chars") % 3 == 1, (F.col("n_chars") % 100) / 100.0)
    draws = docs.select("item", "k", value.alias("v"), (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("top"), full.alias("full"))
    outcomes = docs.select("item", F.when(F.col("item") % 5 > 0, F.col("item") % 9 - 4).alias("realized")).distinct()
    return variants.item_variants(draws, outcomes, "item", "k", "v", {"top_k": "top", "full": "full"}, "realized", LEAST, "1")


VARIANTS = f"""docs AS (SELECT doc_id // 8 AS item, doc_id % 8 AS k, n_chars FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT item, k, CASE WHEN n_chars % 7 > 0 THEN n_chars % 5 - 2 + CASE WHEN item % 4 = 0 AND n_chars % 2 = 0 THEN 12 ELSE 0 END END::DOUBLE AS v, n_chars / (n_chars + 1500.0::DOUBLE) AS top, CASE n_chars % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN (n_chars % 100) / 100.0::DOUBLE END AS "full" FROM docs),
c AS (SELECT item, v, count(*) AS n FROM w WHERE v IS NOT NULL GROUP BY ALL),
b AS (SELECT item, v, n, row_number() OVER o AS i, count(*) OVER (PARTITION BY item) AS m, sum(n) OVER (PARTITION BY item) AS total, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS upto, max(n) OVER (o ROWS UNBOUNDED PRECEDING) AS pl,
  max(n) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ph FROM c WINDOW o AS (PARTITION BY item ORDER BY v)),
s AS (SELECT DISTINCT x.item FROM b x JOIN b y ON x.item = y.item AND y.i > x.i AND round(y.v - x.v) - 1 >= 3 WHERE x.total >= 8 AND x.upto >= 0.25 * x.total AND y.total - y.upto + y.n >= 0.25 * y.total
  AND (x.upto + y.total - y.upto + y.n) / (x.i + x.m - y.i + 1)::DOUBLE >= 1.5 AND greatest(x.pl, y.ph) >= 10 * coalesce((SELECT max(t.n) FROM b t WHERE t.item = x.item AND t.i > x.i AND t.i < y.i), 0)),
d AS (SELECT item, CASE WHEN item % 5 > 0 THEN item % 9 - 4 END AS realized, count(v) AS n, list_sort(list(v) FILTER (v IS NOT NULL)) AS vs, count(*) FILTER (v > 0) AS up, max(v) FILTER (k = 0) AS first,
  avg(top) FILTER (k = 0 AND v IS NOT NULL) AS top_first, avg(top) FILTER (v IS NOT NULL) AS top_all, avg("full") FILTER (k = 0 AND v IS NOT NULL) AS full_first, avg("full") FILTER (v IS NOT NULL) AS full_all FROM w GROUP BY item),
e AS (SELECT item, realized, 'single' AS mode, first IS NULL AS failed, first AS raw, (first > 0)::INT::DOUBLE AS share, top_first AS top, full_first AS "full" FROM d
  UNION ALL SELECT d.item, realized, 'ensemble', n < {LEAST}, CASE WHEN n >= {LEAST} AND s.item IS NULL THEN vs[((n - 1) // 2) + 1] END, up / nullif(n, 0)::DOUBLE, top_all, full_all FROM d LEFT JOIN s ON d.item = s.item),
f AS (SELECT item, realized, mode, adjustment, failed, raw, share, CASE WHEN NOT failed THEN CASE adjustment WHEN 'top_k' THEN top WHEN 'full' THEN "full" END END AS p FROM e, (VALUES ('none'), ('top_k'), ('full')) a(adjustment)),
g AS (SELECT *, raw * (1 - greatest(0, least(1, coalesce(p, 0)))) AS adjusted, CASE WHEN NOT failed AND realized IS NOT NULL THEN greatest(0.01::DOUBLE, least(0.99::DOUBLE, share)) END AS probability, CASE WHEN failed THEN 'no decision' WHEN realized IS NULL THEN 'no outcome' WHEN raw IS NULL THEN 'unresolved' ELSE '' END AS reason FROM f),
v AS (SELECT item, mode, adjustment, CASE WHEN failed THEN 'failed' WHEN raw IS NULL THEN 'unresolved' WHEN p IS NULL THEN 'unadjusted' ELSE 'ok' END AS status, raw, p AS p_recall, adjusted, realized, reason, probability, 0.5 + (1 - coalesce(p, 0)) * (probability - 0.5) AS adjusted_probability,
  CASE WHEN reason = '' THEN round(adjusted, 9) = 0 AND raw <> 0 END AS from_raw, CASE WHEN reason = '' THEN (CASE WHEN round(adjusted, 9) = 0 THEN raw ELSE adjusted END > 0) = (realized > 0) END AS correct FROM g)"""


def item_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision by one draw and by all, unadjusted and by two estimates, for every eight documents."""
    out = _variants(spark, sf_dir)
    return out.select("item", "mode", "adjustment", "status", *[r(c).alias(c) for c in ("raw", "p_recall", "adjusted")], "correct", "from_raw", *[r(c).alias(c) for c in ("probability", "adjusted_probability")], "reason")


ITEM_VARIANTS = f"""WITH {VARIANTS} SELECT item, mode, adjustment, status, round(raw, 6) + 0.0 AS raw, round(p_recall, 6) AS p_recall, round(adjusted, 6) + 0.0 AS adjusted, correct, from_raw, round(probability, 6) AS probability, round(adjusted_probability, 6) AS adjusted_probability, reason FROM v"""

LOSSES = ("brier", "adjusted_brier", "log_loss", "adjusted_log_loss")


def variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = variants.variant_summary(_variants(spark, sf_dir))
    return out.select("mode", "adjustment", "planned", "scored", r("accuracy").alias("accuracy"), r("accuracy_planned").alias("accuracy_planned"), "from_raw", "forecasts", *[r(c).alias(c) for c in LOSSES])


VARIANT_SUMMARY = f"""WITH {VARIANTS}, y AS (SELECT *, (realized > 0)::INT AS y FROM v)
SELECT mode, adjustment, count(*) AS planned, count(correct) AS scored, round(count(*) FILTER (correct) / nullif(count(correct), 0)::DOUBLE, 6) AS accuracy, round(count(*) FILTER (correct) / count(*)::DOUBLE, 6) AS accuracy_planned, count(*) FILTER (from_raw) AS from_raw, count(probability) AS forecasts,
  round(avg((probability - y) ** 2), 6) AS brier, round(avg((adjusted_probability - y) ** 2), 6) AS adjusted_brier, round(avg(-ln(CASE WHEN y = 1 THEN probability ELSE 1 - probability END)), 6) AS log_loss,
  round(avg(-ln(CASE WHEN y = 1 THEN adjusted_probability ELSE 1 - adjusted_probability END)), 6) AS adjusted_log_loss FROM y GROUP BY ALL"""

FILES = {"calibration_1": 40, "calibration_0": 40, "held_out_1": 10_000_000, "held_out_0": 20, "held_out_2": 5}


def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as files of two splits by label: rows against targets, by source, and each file's identity."""
    split = F.when(F.col("doc_id") % 3 == 0, "held_out").otherwise("calibration")
    rows = scored(spark, sf_dir).withColumn("file", F.concat_ws("_", split, F.col("label").cast("string")))
    out = manifest.corpus_manifest(rows, "file", "source", "doc_id", ["doc_id", "label", "n_chars"], FILES)
    parts = F.concat_ws(",", F.transform(F.map_entries("parts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return out.select("file", "target", "rows", "complete", parts.alias("parts"), "first", "last", "identity")


_WORDS = ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT)::VARCHAR AS w{k}" for k in range(4))
CORPUS_MANIFEST = f"""WITH {SCORED}, x AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'held_out' ELSE 'calibration' END || '_' || label AS file, coalesce(source, '') AS part, doc_id, sha256(concat_ws(chr(31), coalesce(doc_id::VARCHAR, ''), coalesce(label::VARCHAR, ''), coalesce(n_chars::VARCHAR, ''))) AS h FROM scored),
t AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {n}::BIGINT)" for f, n in FILES.items())}) t(file, target)),
p AS (SELECT file, string_agg(part || ':' || n, ',' ORDER BY part) AS parts FROM (SELECT file, part, count(*) AS n FROM x GROUP BY ALL) GROUP BY 1),
a AS (SELECT file, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, {_WORDS} FROM x GROUP BY 1)
SELECT t.file, target, coalesce(n, 0) AS rows, coalesce(n, 0) >= target AS complete, coalesce(parts, '') AS parts, first, last, sha256(concat_ws(':', coalesce(n, 0)::VARCHAR, coalesce(w0, '0'), coalesce(w1, '0'), coalesce(w2, '0'), coalesce(w3, '0'))) AS identity
FROM t LEFT JOIN a ON a.file = t.file LEFT JOIN p ON p.file = t.file"""

STAGES = {"pilot": ("calibration", ("identifying", "anonymised")), "control": ("held_out", ("outlook",))}


def key_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two stages plan of the documents against what was recorded: some keys are missing, some repeated, some planned by none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    role = F.when(F.col("doc_id") % 5 == 0, "held_out").when(F.col("doc_id") % 5 < 4, "calibration")
    planned = manifest.planned_keys(docs, "doc_id", role, STAGES)
    stage = F.when(F.col("doc_id") % 5 == 0, "control").otherwise("pilot")
    times = F.when(F.col("n_chars") % 11 == 0, 0).when(F.col("n_chars") % 13 == 0, 2).otherwise(1)
    names = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("outlook"))).otherwise(F.array(F.lit("identifying"), F.lit("anonymised")))
    recorded = docs.select("doc_id", stage.alias("stage"), names.alias("names"), F.explode(F.array_repeat(F.lit(1), times)).alias("_")).select("stage", "doc_id", F.explode("names").alias("rendering"))
    return manifest.key_account(planned, recorded, ["stage", "doc_id", "rendering"])


KEY_ACCOUNT = """WITH p AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'control' ELSE 'pilot' END AS stage, doc_id, n_chars, unnest(CASE WHEN doc_id % 5 = 0 THEN ['outlook'] ELSE ['identifying', 'anonymised'] END) AS rendering FROM documents),
n AS (SELECT stage, doc_id, rendering, sum(CASE WHEN doc_id % 5 < 4 THEN 1 ELSE 0 END)::BIGINT AS planned, sum(CASE WHEN n_chars % 11 = 0 THEN 0 WHEN n_chars % 13 = 0 THEN 2 ELSE 1 END)::BIGINT AS recorded FROM p GROUP BY ALL)
SELECT *, CASE WHEN planned > 1 OR recorded > 1 THEN 'repeated' WHEN planned = 0 THEN 'unplanned' WHEN recorded = 0 THEN 'missing' ELSE 'recorded' END AS state FROM n WHERE planned + recorded > 0"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (item_variants, variant_summary, corpus_manifest, key_account)}
ORACLE_SQL: dict[str, str] = {name: globals()[name.upper()] for name in QUERIES}
