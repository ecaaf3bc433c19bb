"""Summaries and contrasts of an experiment by scope, two modes side by side, and rules over the documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import experiment
from .study_queries import CONDITIONS, REPS, _conditions
from .tables import SCORED, hash_sql, poisson_sql, r, scored, table


def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conditions(spark, sf_dir).withColumn("cohort", F.concat(F.lit("cohort "), (F.col("item") % 2).cast("string")))


COHORTS = f"{CONDITIONS}, g AS (SELECT *, 'cohort ' || item % 2 AS cohort, state <> 'incomplete' AS t, state = 'usable' AS u, state = 'usable' AND n_correct * 2 > n_usable AS ok FROM grid)"


def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arms of an experiment over each cohort and arm, each arm, each cohort, and all."""
    out = experiment.scoped_summary(_cohorts(spark, sf_dir), "cohort", "arm")
    return out.select("scope", "cohort", "arm", "planned", "terminal", "usable", "right", *[r(c).alias(c) for c in ("accuracy_attempted", "accuracy_usable", "coverage", "confidence", "median_confidence")])


EXPERIMENT_SUMMARY = f"""WITH {COHORTS}
SELECT ['cohort and arm', 'cohort', 'arm', 'all'][(grouping(cohort) * 2 + grouping(arm) + 1)::INT] AS scope, cohort, arm, count(*) AS planned, count(*) FILTER (t) AS terminal, count(*) FILTER (u) AS usable, count(*) FILTER (ok) AS "right",
  round(count(*) FILTER (ok) / nullif(count(*) FILTER (t), 0)::DOUBLE, 6) AS accuracy_attempted, round(count(*) FILTER (ok) / nullif(count(*) FILTER (u), 0)::DOUBLE, 6) AS accuracy_usable, round(count(*) FILTER (u) / count(*)::DOUBLE, 6) AS coverage,
  round(avg(confidence) FILTER (u), 6) AS confidence, round(list_sort(list(confidence) FILTER (u))[(count(confidence) FILTER (u) + 1) // 2], 6) AS median_confidence FROM g GROUP BY GROUPING SETS ((cohort, arm), (arm), (cohort), ())"""

CONTRASTS = {"first": ("arm 0", "arm 1"), "second": ("arm 1", "arm 2"), "never run": ("arm 0", "arm 3")}


def experiment_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences between arms over all users and over each cohort."""
    out = experiment.scoped_effects(_cohorts(spark, sf_dir), "item", "cohort", "arm", CONTRASTS, REPS)
    return out.select("contrast", "kind", "scope", "cohort", "planned", "n", *[r(c, 9).alias(c) for c in ("baseline", "comparison", "estimate", "low", "high")], "status")


_SCOPE_KEY = "contrast || '-' || kind || '-' || scope || coalesce('-' || cohort, '')"
EXPERIMENT_EFFECTS = f"""WITH {COHORTS}, c(contrast, x, y) AS (VALUES {", ".join(f"('{n}', '{a}', '{b}')" for n, (a, b) in CONTRASTS.items())}),
p AS (SELECT c.contrast, l.item, l.cohort, l.t AS lt, m.t AS mt, l.u AS lu, m.u AS mu, l.ok::INT::DOUBLE AS lok, m.ok::INT::DOUBLE AS mok, CASE WHEN l.u THEN l.confidence END AS lc, CASE WHEN m.u THEN m.confidence END AS mc FROM c JOIN g l ON l.arm = c.x JOIN g m ON m.arm = c.y AND m.item = l.item),
k AS (SELECT contrast, 'attempted' AS kind, item, cohort, CASE WHEN lt AND mt THEN lok END AS a, CASE WHEN lt AND mt THEN mok END AS b FROM p UNION ALL SELECT contrast, 'valid', item, cohort, CASE WHEN lu AND mu THEN lok END, CASE WHEN lu AND mu THEN mok END FROM p
  UNION ALL SELECT contrast, 'confidence', item, cohort, CASE WHEN mc IS NOT NULL THEN lc END, CASE WHEN lc IS NOT NULL THEN mc END FROM p),
s AS (SELECT contrast, kind, 'cohort' AS scope, item, cohort, a, b, b - a AS d FROM k UNION ALL SELECT contrast, kind, 'all', item, NULL, a, b, b - a FROM k),
w AS (SELECT contrast, kind, scope, cohort, rep, d, CASE WHEN d IS NULL THEN 0 WHEN rep < 0 THEN 1 ELSE {poisson_sql(hash_sql(_SCOPE_KEY, 'rep', 'item'))} END AS w FROM s, range(-1, {REPS}) t(rep)),
m AS (SELECT contrast, kind, scope, cohort, rep, sum(w) AS n, sum(w * d) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL),
e AS (SELECT contrast, kind, scope, cohort, max(n) FILTER (rep < 0)::BIGINT AS n, max(m) FILTER (rep < 0) AS point, quantile_cont(m, 0.025) FILTER (rep >= 0) AS lo, quantile_cont(m, 0.975) FILTER (rep >= 0) AS hi FROM m GROUP BY ALL),
q AS (SELECT contrast, kind, scope, cohort, count(*) AS planned, avg(a) FILTER (d IS NOT NULL) AS baseline, avg(b) FILTER (d IS NOT NULL) AS comparison FROM s GROUP BY ALL),
z AS (SELECT q.*, n, point, CASE WHEN n > 1 THEN least(point, lo) END AS low, CASE WHEN n > 1 THEN greatest(point, hi) END AS high FROM q JOIN e ON q.contrast = e.contrast AND q.kind = e.kind AND q.scope = e.scope AND q.cohort IS NOT DISTINCT FROM e.cohort)
SELECT contrast, kind, scope, cohort, planned, n, round(baseline, 9) AS baseline, round(comparison, 9) AS comparison, round(point, 9) AS estimate, round(low, 9) AS low, round(high, 9) AS high,
  CASE WHEN n = 0 THEN 'unavailable' WHEN n = 1 THEN 'inadequate' WHEN low = high THEN 'degenerate' ELSE 'estimated' END AS status FROM z"""


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to score labelled documents, by language, resampled together by blocks of documents; with what is left out of each and why."""
    rows = scored(spark, sf_dir).withColumn("block", F.floor(F.col("doc_id") / 40))
    loss = lambda p: F.round((p - F.col("label")) * (p - F.col("label")), 9)
    a = rows.filter("doc_id % 11 <> 0").select("lang", "block", "doc_id", F.when(F.col("doc_id") % 13 != 0, loss(F.col("p"))).alias("loss"))
    b = rows.filter("doc_id % 7 <> 0").select("lang", "block", "doc_id", F.when(F.col("doc_id") % 17 != 0, loss(F.lit(0.5))).alias("loss"))
    ledger = experiment.aligned_modes(a, b, ["lang", "block", "doc_id"], "loss")
    out = experiment.mode_comparison(ledger, ["lang"], "block", REPS, 0.05, F.col("lang") == "en")
    left = F.array_join(F.transform(F.map_entries("left_out"), lambda x: F.concat(x["key"], F.lit(": "), x["value"].cast("string"))), ", ")
    return out.select("lang", "n", "blocks", *[r(c, 9).alias(c) for c in ("mean_a", "mean_b", "difference", "low", "high", "p")], "decision", left.alias("left_out"))


MODES = f"""WITH {SCORED}, a AS (SELECT lang, doc_id // 40 AS block, doc_id, CASE WHEN doc_id % 13 <> 0 THEN round((p - label) ** 2, 9) END AS x FROM scored WHERE doc_id % 11 <> 0),
b AS (SELECT lang, doc_id // 40 AS block, doc_id, CASE WHEN doc_id % 17 <> 0 THEN round((0.5 - label) ** 2, 9) END AS y FROM scored WHERE doc_id % 7 <> 0),
l AS (SELECT lang, block, doc_id, x, y, CASE WHEN a.doc_id IS NULL THEN 'only in b' WHEN b.doc_id IS NULL THEN 'only in a' WHEN x IS NULL AND y IS NULL THEN 'no value in either' WHEN x IS NULL THEN 'no value in a' WHEN y IS NULL THEN 'no value in b' ELSE '' END AS reason FROM a FULL JOIN b USING (lang, block, doc_id)),
s AS (SELECT lang, block, sum(x) AS x, sum(y) AS y, count(*) AS c FROM l WHERE reason = '' GROUP BY ALL),
w AS (SELECT lang, rep, x - y AS d, c, {poisson_sql(hash_sql('lang', 'rep', 'block'))} AS w FROM s, range({REPS}) t(rep)), m AS (SELECT lang, rep, sum(w * d) / nullif(sum(w * c), 0) AS d FROM w GROUP BY ALL),
e AS (SELECT lang, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, least(1.0, 2.0 * least(count(*) FILTER (d <= 0) + 1, count(*) FILTER (d >= 0) + 1) / (count(d) + 1)::DOUBLE) AS p FROM m GROUP BY 1),
h AS (SELECT lang, sum(c)::BIGINT AS n, count(*) AS blocks, sum(x) / sum(c) AS mean_a, sum(y) / sum(c) AS mean_b FROM s GROUP BY 1),
o AS (SELECT lang, string_agg(reason || ': ' || n, ', ' ORDER BY reason) AS left_out FROM (SELECT lang, reason, count(*) AS n FROM l WHERE reason <> '' GROUP BY ALL) GROUP BY 1)
SELECT lang, n, blocks, round(mean_a, 9) AS mean_a, round(mean_b, 9) AS mean_b, round(mean_a - mean_b, 9) AS difference, round(low, 9) AS low, round(high, 9) AS high, round(p, 9) AS p,
  CASE WHEN low > 0 AND lang = 'en' THEN 'improve' WHEN low >= -0.05 AND high <= 0.05 THEN 'match' ELSE 'undecided' END AS decision, left_out FROM h JOIN e USING (lang) LEFT JOIN o USING (lang)"""


def corpus_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the documents as a corpus of three splits, in one scan and two counts."""
    docs = table(spark, sf_dir, "documents").withColumn("split", F.col("doc_id") % 3)
    text = F.coalesce("text", F.lit(""))
    rules = {"no_text": F.trim(text) == "", "no_source": F.coalesce(F.trim("source"), F.lit("")) == "", "too_short": F.length(text) < 40, "length": F.col("n_chars") != F.length(text), "address": text.rlike(r"[A-Za-z0-9.]+@[A-Za-z0-9]+\.[a-z]+")}
    return experiment.issue_rows(docs, "doc_id", rules, "text", "split")


CORPUS_ISSUES = r"""WITH d AS (SELECT doc_id, doc_id % 3 AS split, coalesce(text, '') AS t, source, n_chars FROM documents),
i AS (SELECT doc_id, unnest(list_filter([CASE WHEN trim(t, ' ') = '' THEN 'no_text' END, CASE WHEN coalesce(trim(source, ' '), '') = '' THEN 'no_source' END, CASE WHEN length(t) < 40 THEN 'too_short' END, CASE WHEN n_chars <> length(t) THEN 'length' END,
  CASE WHEN regexp_matches(t, '[A-Za-z0-9.]+@[A-Za-z0-9]+\.[a-z]+') THEN 'address' END], lambda x: x IS NOT NULL)) AS code FROM d)
SELECT * FROM i UNION ALL SELECT doc_id, 'duplicate_id' FROM d GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT doc_id, 'split_text_overlap' FROM d WHERE t IN (SELECT t FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1)"""

TEMPLATES = [
    ("{kind:name} of user {user}: {count} draws, at least {least} are needed", "a user has {count} draws of the kind {kind}, and {least} are needed"),
    ("value {value:number} beyond the bound (+/-{bound})", "a value lies beyond {bound}"),
    ("no consensus: {inner:any}", "no decision, since {inner}"),
]


def published_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reasons made of events in the wording that may be published; null where no template fits."""
    e = table(spark, sf_dir, "events")
    kind, n = F.col("event_id") % 5, F.col("event_id").cast("string")
    stored = (
        F.when(kind == 0, F.concat("event_type", F.lit("  of user "), F.col("user_id").cast("string"), F.lit(": "), n, F.lit(" draws, at least 8 are needed.")))
        .when(kind == 1, F.concat(F.lit("value -"), n, F.lit(".5 beyond the bound (+/-40)")))
        .when(kind == 2, F.concat(F.lit("no consensus: "), "event_type"))
        .when(kind == 3, F.concat(F.lit("unknown "), n))
    )
    return e.select("event_id", experiment.reworded(stored, TEMPLATES).alias("reason"))


PUBLISHED_REASONS = r"""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || '  of user ' || user_id || ': ' || event_id || ' draws, at least 8 are needed.' WHEN 1 THEN 'value -' || event_id || '.5 beyond the bound (+/-40)' WHEN 2 THEN 'no consensus: ' || event_type WHEN 3 THEN 'unknown ' || event_id ELSE '' END AS t FROM events),
c AS (SELECT event_id, regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g'), ' '), '\.$', '') AS t FROM e)
SELECT event_id, CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9_]* of user \d+: \d+ draws, at least \d+ are needed$') THEN regexp_replace(t, '^([A-Za-z][A-Za-z0-9_]*) of user (\d+): (\d+) draws, at least (\d+) are needed$', 'a user has \3 draws of the kind \1, and \4 are needed')
  WHEN regexp_matches(t, '^value -?\d+(\.\d+)? beyond the bound \(\+/-\d+\)$') THEN regexp_replace(t, '^value .* beyond the bound \(\+/-(\d+)\)$', 'a value lies beyond \1') WHEN regexp_matches(t, '^no consensus: .+$') THEN regexp_replace(t, '^no consensus: (.+)$', 'no decision, since \1') END AS reason FROM c"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (experiment_summary, experiment_effects, modes, corpus_issues, published_reasons)}
ORACLE_SQL: dict[str, str] = {name: globals()[name.upper()] for name in QUERIES}
