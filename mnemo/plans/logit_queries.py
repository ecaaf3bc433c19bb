"""Kernels over logit vectors: the embeddings table's 64 floats as logits, its label as the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logits
from .tables import r, table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return rows.withColumn("lp", logits.log_softmax(F.col("x")))


V = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda e: exp(e - list_max(x))))) AS z FROM v),
l AS (SELECT *, list_transform(x, lambda e: e - z) AS lp FROM s)"""


def token_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability, rank and entropy of each position's target."""
    rows = _vectors(spark, sf_dir)
    return rows.select("vec_id", r(F.get("lp", F.col("label"))).alias("logprob"), logits.rank_of(F.col("lp"), F.col("label")).cast("long").alias("rank"), r(logits.entropy(F.col("lp"))).alias("entropy"))


TOKEN_EVIDENCE = f"""WITH {V} SELECT vec_id, round(lp[label + 1], 6) AS logprob, len(list_filter(lp, lambda e: e > lp[label + 1])) + 1 AS rank, round(-list_sum(list_transform(lp, lambda e: exp(e) * e)), 6) AS entropy FROM l"""


def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five likeliest entries of each position."""
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode(logits.top_k(F.col("lp"), 5)).alias("place", "t"))
    return rows.select("vec_id", F.col("place").cast("long").alias("place"), F.col("t.id").cast("long").alias("token"), r("t.value").alias("logprob"))


TOP_TOKENS = f"""WITH {V}, e AS (SELECT vec_id, unnest(lp) AS p, unnest(range(len(lp))) AS token FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, token) - 1 AS place FROM e)
SELECT vec_id, place, token, round(p, 6) AS logprob FROM k WHERE place < 5"""


def kept_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability within the first k entries, for several k, by label: mean and least."""
    rows = _vectors(spark, sf_dir).select("label", *[logits.top_k_mass(F.col("lp"), k).alias(f"k{k}") for k in (1, 5, 20)])
    long = rows.select("label", F.expr("stack(3, 1, k1, 5, k5, 20, k20) as (k, mass)"))
    return long.groupBy("label", "k").agg(F.count("*").alias("n"), r(F.avg("mass")).alias("mean_mass"), r(F.min("mass")).alias("least_mass"))


KEPT_MASS = f"""WITH {V}, m AS (SELECT label, k, list_sum(list_transform(list_sort(lp, 'DESC')[1:k], lambda e: exp(e))) AS mass FROM l, (VALUES (1), (5), (20)) t(k))
SELECT label, k, count(*) AS n, round(avg(mass), 6) AS mean_mass, round(min(mass), 6) AS least_mass FROM m GROUP BY ALL"""


def reply_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss, Min-K and Min-K++ of replies: ten vectors in a row are a reply's positions, their logits the alternatives."""
    rows = _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 10).alias("reply"), F.get("lp", F.col("label")).alias("t"), logits.position_z(F.get("lp", F.col("label")), F.col("lp")).alias("z"))
    out = rows.groupBy("reply").agg(F.collect_list(logits.clipped(F.col("t"))).alias("ts"), F.collect_list("z").alias("zs"), F.count("*").alias("n"))
    mean = F.aggregate("ts", F.lit(0.0), lambda a, b: a + b) / F.size("ts")
    return out.select("reply", "n", r(-mean).alias("loss"), r(logits.bottom_mean(F.col("ts"), 0.2)).alias("min_k"), r(logits.bottom_mean(F.col("zs"), 0.2)).alias("min_k_pp"))


REPLY_FEATURES = f"""WITH {V}, t AS (SELECT vec_id // 10 AS reply, lp[label + 1] AS t, (greatest(lp[label + 1], -30) - list_avg(lp)) / greatest(list_stddev_pop(lp), 1e-6) AS z FROM l),
g AS (SELECT reply, count(*) AS n, list_sort(list(greatest(t, -30))) AS ts, list_sort(list(z)) AS zs FROM t GROUP BY 1)
SELECT reply, n, round(-list_avg(ts), 6) AS loss, round(list_avg(ts[1:greatest(1, floor(n * 0.2)::INT)]), 6) AS min_k, round(list_avg(zs[1:greatest(1, floor(n * 0.2)::INT)]), 6) AS min_k_pp FROM g"""


def guided_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy choice of logits moved along the difference of two reference vectors: the next and its mirror."""
    rows = _vectors(spark, sf_dir)
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("strong"))
    moved = rows.join(other, "vec_id").withColumn("y", logits.combine(F.col("x"), F.col("strong"), F.reverse("strong"), 0.5))
    return moved.select("vec_id", logits.argmax(F.col("x")).cast("long").alias("plain"), logits.argmax(F.col("y")).cast("long").alias("guided"), r(F.array_max("y")).alias("best"))


GUIDED_CHOICES = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), j AS (SELECT a.vec_id, a.x, b.x AS s FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
m AS (SELECT vec_id, x, list_transform(x, lambda e, i: e + (s[i] - s[len(s) + 1 - i]) * 0.5::DOUBLE) AS y FROM j)
SELECT vec_id, list_position(x, list_max(x)) - 1 AS plain, list_position(y, list_max(y)) - 1 AS guided, round(list_max(y), 6) AS best FROM m"""


def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far entropy from the first k entries alone is from the whole, for several k."""
    rows = _vectors(spark, sf_dir).select("vec_id", logits.entropy(F.col("lp")).alias("full"), *[logits.entropy(F.slice(F.sort_array("lp", asc=False), 1, k)).alias(f"k{k}") for k in (5, 20, 64)])
    long = rows.select("full", F.expr("stack(3, 5, k5, 20, k20, 64, k64) as (k, h)"))
    d = F.abs(F.col("h") - F.col("full"))
    return long.groupBy("k").agg(r(F.avg(d)).alias("mean_difference"), r(F.max(d)).alias("max_difference"), r(F.avg((d <= 1.0).cast("double"))).alias("within"))


CONVERGENCE = f"""WITH {V}, d AS (SELECT k, abs(-list_sum(list_transform(list_sort(lp, 'DESC')[1:k], lambda e: exp(e) * e)) + list_sum(list_transform(lp, lambda e: exp(e) * e))) AS d FROM l, (VALUES (5), (20), (64)) t(k))
SELECT k, round(avg(d), 6) AS mean_difference, round(max(d), 6) AS max_difference, round(avg((d <= 1.0)::INT), 6) AS within FROM d GROUP BY 1"""


def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validity code for each position: censored, mass above one, or ok; some are spoiled on purpose."""
    rows = _vectors(spark, sf_dir)
    target = F.when(F.col("vec_id") % 17 == 0, F.lit(-9999.0)).otherwise(F.get("lp", F.col("label")))
    mass = logits.top_k_mass(F.when(F.col("vec_id") % 13 == 0, F.transform("lp", lambda e: e + 1)).otherwise(F.col("lp")), 64)
    code = F.when(target <= -9999.0, "censored").when(target > 0, "positive").when(mass > 1.0 + 1e-6, "mass").otherwise("ok")
    return rows.groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


EVIDENCE_CHECK = f"""WITH {V}, c AS (SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN 'censored' WHEN list_sum(list_transform(lp, lambda e: exp(e + CASE WHEN vec_id % 13 = 0 THEN 1 ELSE 0 END))) > 1 + 1e-6 THEN 'mass' ELSE 'ok' END AS code FROM l)
SELECT code, count(*) AS n, min(vec_id) AS first_id FROM c GROUP BY 1"""

QUERIES = {
    "token_evidence": token_evidence,
    "top_tokens": top_tokens,
    "kept_mass": kept_mass,
    "reply_features": reply_features,
    "guided_choices": guided_choices,
    "convergence": convergence,
    "evidence_check": evidence_check,
}
ORACLE_SQL = {
    "token_evidence": TOKEN_EVIDENCE,
    "top_tokens": TOP_TOKENS,
    "kept_mass": KEPT_MASS,
    "reply_features": REPLY_FEATURES,
    "guided_choices": GUIDED_CHOICES,
    "convergence": CONVERGENCE,
    "evidence_check": EVIDENCE_CHECK,
}
