"""The driver's tables and the small views that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import poisson_thresholds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column: Column | str, places: int = 6) -> Column:
    """A double rounded for comparison across engines, without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), places) + 0.0


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: doc_id, source, lang, label, toxic, n_chars and p, a score from 0 to 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "source", "lang", F.col("quality").alias("label"), "toxic", "n_chars", (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("p"))


SCORED = "scored AS (SELECT doc_id, source, lang, quality AS label, toxic, n_chars, n_chars / (n_chars + 1500.0::DOUBLE) AS p FROM documents JOIN labels USING (doc_id))"


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as repeated draws: item (user), order (ts, event_id), answer (event_type), value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), "ts", "event_id", F.col("event_type").alias("answer"), "value")


DRAWS = "draws AS (SELECT user_id AS item, ts, event_id, event_type AS answer, value FROM events)"


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean order price of each priority, as the closes of a ticker."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 4).alias("close"))


CLOSES = "closes AS (SELECT o_orderpriority AS ticker, o_orderdate::DATE AS day, round(avg(o_totalprice), 4) AS close FROM orders GROUP BY ALL)"


def hash_sql(*parts: str) -> str:
    """resample.hash_uniform in SQL."""
    return f"('0x' || substr(md5({" || '-' || ".join(parts)}), 1, 8))::BIGINT"


def poisson_sql(u: str, rate: str | None = None) -> str:
    """resample.poisson_count in SQL."""
    if rate is None:
        return "(" + " + ".join(f"({u} >= {t})::INT" for t in poisson_thresholds(1.0)) + ")"
    return f"list_sum(list_transform(range(12), lambda k: ({u} >= 4294967296 * list_sum(list_transform(range(k + 1), lambda i: exp(-({rate})) * ({rate}) ** i / factorial(i::INT))))::INT))"


def bootstrap_sql(name: str, source: str, by: str, unit: str, value: str, reps: int) -> str:
    """A table of by, n, point, lo and hi (before they are made to contain the point) of the bootstrapped mean."""
    return f"""{name}_d AS (SELECT {by}, rep, {value} AS x, CASE WHEN rep < 0 THEN 1 ELSE {poisson_sql(hash_sql(by, 'rep', unit))} END AS w FROM {source}, range(-1, {reps}) t(rep) WHERE {value} IS NOT NULL),
{name}_m AS (SELECT {by}, rep, sum(w)::BIGINT AS n, sum(w * x) / nullif(sum(w), 0) AS s FROM {name}_d GROUP BY ALL),
{name} AS (SELECT {by}, max(n) FILTER (rep < 0) AS n, max(s) FILTER (rep < 0) AS point, quantile_cont(s, 0.025) FILTER (rep >= 0) AS lo, quantile_cont(s, 0.975) FILTER (rep >= 0) AS hi FROM {name}_m GROUP BY ALL)"""
