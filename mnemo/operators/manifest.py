"""Accounts of a study's files and keys: what each file holds against its target, and which planned keys are recorded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity(text: Column) -> list[Column]:
    """Aggregates _w0 to _w3, the sums of four 32-bit words of each row's SHA-256: alike for the same rows in any order, repeats counted.

    Sums are made in part on every task, so no group stands in one place, as it would to be hashed in an order.
    """
    words = [F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 8 * k + 1, 8), 16, 10).cast("decimal(20,0)") for k in range(4)]
    return [F.sum(w).cast("decimal(38,0)").alias(f"_w{k}") for k, w in enumerate(words)]


def corpus_manifest(rows: DataFrame, file: str, part: str, at: str, key: Sequence[str], targets: Mapping[str, int]) -> DataFrame:
    """file, target, rows, complete, parts (part -> rows), first and last (of `at`), and identity, for each file with a target.

    A file without rows has 0 and no parts; rows of files without a target, or of none, are left out, and rows without a part
    count under ''. identity is the SHA-256 of the number of rows and of their identity by the columns of key, null being empty.
    Parts are meant to be few, as quarters are; they are what stands in a row.
    """
    spark = rows.sparkSession
    wanted = spark.createDataFrame(sorted(targets.items()), "_file string, target long")
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key))
    cells = rows.groupBy(F.col(file).cast("string").alias("_file"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part")).agg(F.count("*").alias("_n"), F.min(at).alias("_first"), F.max(at).alias("_last"), *identity(text))
    sums = [F.sum(f"_w{k}").cast("decimal(38,0)").cast("string").alias(f"_s{k}") for k in range(4)]
    files = cells.groupBy("_file").agg(F.sum("_n").alias("rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_part", "_n")))).alias("parts"), F.min("_first").alias("first"), F.max("_last").alias("last"), *sums)
    n = F.coalesce("rows", F.lit(0)).cast("long")
    digest = F.sha2(F.concat_ws(":", n.cast("string"), *(F.coalesce(f"_s{k}", F.lit("0")) for k in range(4))), 256)
    return wanted.join(files, "_file", "left").select(F.col("_file").alias(file), "target", n.alias("rows"), (n >= F.col("target")).alias("complete"), "parts", "first", "last", digest.alias("identity"))


def planned_keys(rows: DataFrame, key: str, role: Column, stages: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """stage, key and rendering: each key of a stage's role in each of its renderings. stages: stage -> (role, renderings); other roles are unused."""
    plan = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(r).alias("_role"), F.array(*map(F.lit, names)).alias("_renderings")) for s, (r, names) in stages.items()))
    mine = rows.select(key, role.alias("_mine"), F.explode(plan).alias("_s")).filter("_mine = _s._role")
    return mine.select(F.col("_s.stage").alias("stage"), key, F.explode("_s._renderings").alias("rendering"))


def key_account(planned: DataFrame, recorded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, planned and recorded (how often each is) and state: recorded, missing, unplanned, or repeated (planned or recorded more than once).

    Null keys are equal to each other. Both sides are counted before they meet, so a key that is repeated makes one row.
    """
    sides = planned.select(*keys, F.lit(1).alias("_p"), F.lit(0).alias("_r")).unionByName(recorded.select(*keys, F.lit(0).alias("_p"), F.lit(1).alias("_r")))
    n = sides.groupBy(*keys).agg(F.sum("_p").alias("planned"), F.sum("_r").alias("recorded"))
    state = F.when((F.col("planned") > 1) | (F.col("recorded") > 1), "repeated").when(F.col("planned") == 0, "unplanned").when(F.col("recorded") == 0, "missing").otherwise("recorded")
    return n.withColumn("state", state)
