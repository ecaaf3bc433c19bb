"""Running sums and places in a group's order, without bringing a group into one task.

Rows are range-partitioned by group and order and kept by a checkpoint, so a partition holds a stretch of a group or whole
groups. What stands before a stretch is the sum of the stretches before it: one row for a partition and group, or a few more
than there are partitions. Only these are brought together by group; rows themselves are summed within their stretch.
Groups may be null. Rows of equal group and order stand in any order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import cut

Order = Sequence[str | Column]


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of which nulls match; the result has left's columns, then right's others. Without keys right has one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def sums_before(rows: DataFrame, by: Sequence[str], order: Order, sums: Mapping[str, str | Column], totals: Mapping[str, str] | None = None) -> DataFrame:
    """rows with the sums, of the rows of their group that stand before them in the order: column name -> what is summed.

    `totals` names the sums that are wanted of the whole group too: column name -> name of the sum.
    """
    by = list(by)
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_v_{name}": F.col(c) if isinstance(c, str) else c for name, c in sums.items()}
    named = rows.withColumns(values)
    ranged = cut(named.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    stretch = ranged.groupBy("_part", *by).agg(*[F.sum(v).alias(f"_s_{name}") for name, v in zip(sums, values, strict=True)])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    before = stretch.select("_part", *by, *[zero(F.sum(f"_s_{name}").over(earlier)).alias(f"_b_{name}") for name in sums], *[F.sum(f"_s_{name}").over(Window.partitionBy(*by)).alias(out) for out, name in (totals or {}).items()])
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({f"_o_{name}": zero(F.sum(v).over(inside)) for name, v in zip(sums, values, strict=True)})
    found = match(own, before, ["_part", *by])
    return found.select(*rows.columns, *[(F.col(f"_b_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums], *(totals or {}))


def places(rows: DataFrame, by: Sequence[str], order: Order, place: str = "place", size: str | None = None) -> DataFrame:
    """rows with their place (from 0) in their group's order, and with the group's size."""
    return sums_before(rows, by, order, {place: F.lit(1).cast("long")}, {size: place} if size else None)


def average_ranks(rows: DataFrame, value: str, out: str, by: Sequence[str] = (), size: str | None = None) -> DataFrame:
    """rows with the 1-based rank of their value in their group, ties sharing their mean rank, and the group's size.

    Equal values are counted before they are ordered. A null value has no rank.
    """
    by = list(by)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = sums_before(counts, by, [value], {"_before": "_n"}, {"_size": "_before"})
    ranked = ranked.select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out), *([F.col("_size").alias(size)] if size else []))
    return match(rows, ranked, [*by, value], "left")


def following_sums(rows: DataFrame, by: Sequence[str], place: str, value: str, length: int, out: str, stretch: int = 4096) -> DataFrame:
    """rows with the sum of value over their place and the length - 1 places after it in their group.

    Rows are dealt by stretches of places; the first rows of a stretch are seen by the one before it too.
    """
    by = list(by)
    stretch = max(stretch, 4 * length)
    own = rows.withColumn("_stretch", F.floor(F.col(place) / stretch)).withColumn("_guest", F.lit(False))
    guests = own.filter((F.col(place) % stretch < length - 1) & (F.col("_stretch") > 0)).withColumn("_stretch", F.col("_stretch") - 1).withColumn("_guest", F.lit(True))
    ahead = Window.partitionBy(*by, "_stretch").orderBy(place).rowsBetween(0, length - 1)
    return own.unionByName(guests).withColumn(out, F.sum(value).over(ahead)).filter(~F.col("_guest")).drop("_stretch", "_guest")
