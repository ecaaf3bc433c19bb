"""Append-only logs as streams: the latest version of each key, and incremental intake with a high-water mark."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import latest_version


def read_log(spark: SparkSession, path: str, schema: str, plan_hash: str | None = None) -> DataFrame:
    """A stream of JSON lines. A line that does not parse (a torn last line) has `_corrupt_record`; lines of another plan are left out."""
    stream = spark.readStream.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return stream if plan_hash is None else stream.filter(F.col("plan_hash").isNull() | (F.col("plan_hash") == plan_hash))


class ForeignLines(ValueError):
    """The log holds lines that were recorded under another plan."""


def merge_latest(key: Sequence[str], order: Sequence[str], path: str, plan_hash: str | None = None, refuse: bool = True) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the last version of each key of a batch to a Parquet table.

    A batch writes a folder of its own and reads no other, so one that is run again after a failure gives the same table,
    and what it costs does not grow with the table. Beside it stands the batch's account: its lines, those that do not
    parse (torn), those of another plan (foreign, if `plan_hash` is given) and the draws. They are counted while the batch is
    written. Torn and foreign lines are never written; foreign ones stop the stream if `refuse` is set, before the batch
    counts as done. latest_of_table takes the last version over all batches, and account adds the accounts up.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        torn = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in batch.columns else F.lit(False)
        foreign = ~torn & ~F.col("plan_hash").eqNullSafe(F.lit(plan_hash)) if plan_hash is not None else F.lit(False)
        told = batch.withColumns({"_torn": torn, "_foreign": foreign})
        seen = Observation(f"log-{batch_id}")
        counted = told.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if("_torn").alias("torn"), F.count_if("_foreign").alias("foreign"))
        kept = counted.filter(~F.col("_torn") & ~F.col("_foreign")).drop("_torn", "_foreign", "_corrupt_record")
        latest_version(kept, key, order).drop("first_seen").write.mode("overwrite").parquet(f"{path}/log_batch={batch_id}")
        found = seen.get
        if refuse and found["foreign"]:
            raise ForeignLines(f"{found['foreign']} lines of batch {batch_id} were recorded under another plan")
        row = [(found["lines"], found["torn"], found["foreign"], found["lines"] - found["torn"] - found["foreign"])]
        batch.sparkSession.createDataFrame(row, "lines long, torn long, foreign long, draws long").coalesce(1).write.mode("overwrite").parquet(f"{path}_account/log_batch={batch_id}")

    return merge


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _since_base(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None, int]:
    """The last base that compact wrote, the batches after it, and the last batch of that base (-1: none)."""
    bases, batches = _table(spark, f"{path}_base"), _table(spark, path)
    upto = -1 if bases is None else bases.agg(F.max("upto")).first()[0]
    upto = -1 if upto is None else int(upto)
    base = None if bases is None else bases.filter(F.col("upto") == upto).drop("upto")
    return base, None if batches is None else batches.filter(F.col("log_batch") > upto), upto


def latest_of_table(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last version of each key of the table that merge_latest writes; an error if there is none yet."""
    base, batches, _ = _since_base(spark, path)
    parts = [p for p in (base, batches.drop("log_batch") if batches is not None else None) if p is not None]
    if not parts:
        raise ValueError("the log is empty")
    return latest_version(reduce(DataFrame.unionByName, parts), key, order).drop("first_seen")


def compact(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str]) -> int:
    """Write the last version of each key so far as a base, so that later reads take it and the batches after it alone.

    Batches stay where they are; a base that is not whole has no effect, as it is read only once its job is done. Returns the
    last batch that the base holds. A reader takes the largest base, so two that run at once do no harm.
    """
    _, batches, upto = _since_base(spark, path)
    last = None if batches is None else batches.agg(F.max("log_batch")).first()[0]
    if last is None:
        return upto
    latest_of_table(spark, path, key, order).write.mode("overwrite").parquet(f"{path}_base/upto={last}")
    return int(last)


def account(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row: lines of the log, torn and foreign ones, draws, keys, and draws that a later version of their key replaces."""
    counts = spark.read.parquet(f"{path}_account").agg(*[F.sum(c).alias(c) for c in ("lines", "torn", "foreign", "draws")])
    keys = latest_of_table(spark, path, key, order).agg(F.count(F.lit(1)).alias("keys"))
    return counts.crossJoin(keys).withColumn("superseded", F.col("draws") - F.col("keys"))


def drain_log(spark: SparkSession, source: str, schema: str, key: Sequence[str], order: Sequence[str], out: str, checkpoint: str, plan_hash: str | None = None, refuse: bool = True) -> None:
    """Run the log's stream over what is there."""
    merge = merge_latest(key, order, out, plan_hash, refuse)
    query = read_log(spark, source, schema).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_of_log(spark: SparkSession, source: str, schema: str, key: Sequence[str], order: Sequence[str], out: str, checkpoint: str) -> DataFrame:
    """Run the log's stream over what is there and return the last version of each key."""
    drain_log(spark, source, schema, key, order, out, checkpoint)
    return latest_of_table(spark, out, key, order)


def intake(existing: DataFrame, arrivals: DataFrame, day: str, url: str, title: str) -> DataFrame:
    """Rows of arrivals to append: dated on or after the last day of existing, new by address and by title.

    The high-water mark is inclusive, so rows of the same day that come late still enter. Of arrivals that repeat each
    other the first by (day, address, title) stays, so that the same arrivals give the same rows however they are dealt.
    """
    mark = existing.agg(F.max(day).alias("_mark"))
    fresh = arrivals.join(F.broadcast(mark)).filter(F.col("_mark").isNull() | (F.col(day) >= F.col("_mark"))).drop("_mark")
    fresh = fresh.join(existing.select(url).distinct(), url, "left_anti").join(existing.select(title).distinct(), title, "left_anti")
    from ..operators.corpus import dedup_first

    return dedup_first(fresh, [url, title], [day, url, title]).select(*arrivals.columns)


def assemble_replies(events: DataFrame) -> DataFrame:
    """Text, number of parts and validity of each reply from its numbered parts: a gap or a repeated part invalidates it."""
    parts = events.groupBy("reply_id").agg(F.count("*").alias("n"), F.countDistinct("part").alias("n_distinct"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    whole = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("n_distinct") == F.col("n"))
    return parts.select("reply_id", "n", whole.alias("valid"), F.when(whole, F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("text"))
