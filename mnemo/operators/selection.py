"""Selection in an order where what is taken keeps others out: greedy acceptance by keys with targets, and windows that do not overlap, with quotas.

Both give what a loop over the ordered rows gives, by rounds that decide many rows at once. A row of which nothing undecided
comes before among those it conflicts with is taken; what conflicts with a taken one before it is not. Rounds end when all
is decided; each is kept by a checkpoint, and nothing but counts comes to the driver. Where targets bound what is taken, a
stretch of the order of bounded length is looped over in one task, and joins with what is taken decide all other rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import cut
from . import ordered
from .resample import hash_uniform

#: Times that chains of rows are halved before it is asked whether one is left.
HALVINGS = 4
#: Rows that one task decides in the order at most. Targets of more than a 16th of it in all are met by rounds.
LOOP = 1 << 16


def _taken(links: DataFrame, status: DataFrame) -> DataFrame:
    """status (id, taken: true, false or null) with nothing undecided left; links (id, key): rows that share a key conflict."""
    while True:
        open_ = status.filter("taken IS NULL")
        if open_.isEmpty():
            return status
        known = links.join(status.filter("taken IS NULL OR taken"), "id")
        # of each key: the taken row, and the first two undecided ones
        heads = known.groupBy("key").agg(F.min(F.when(F.col("taken"), F.col("id"))).alias("_taken"), F.min(F.when(F.col("taken").isNull(), F.col("id"))).alias("_first"))
        waiting = known.filter("taken IS NULL").select("id", "key").join(heads, "key")
        second = waiting.filter(F.col("id") > F.col("_first")).groupBy("key").agg(F.min("id").alias("_second"))
        waiting = waiting.join(second, "key", "left")
        before = F.when(F.col("id") > F.col("_first"), F.col("_first"))
        each = waiting.groupBy("id").agg(
            F.bool_or(F.coalesce(F.col("_taken") < F.col("id"), F.lit(False))).alias("out"), F.min(before).alias("low"), F.max(before).alias("high"), F.bool_or((F.col("id") > F.col("_first")) & (F.col("id") != F.col("_second"))).alias("many")
        )
        each = cut(open_.select("id").join(each, "id", "left").fillna(False, ["out", "many"]))
        # a row with one undecided row before it is taken if and only if that one is not: such rows are chains, which are halved
        chain = each.filter(~F.col("out") & ~F.col("many") & (F.col("low") == F.col("high"))).select("id", F.col("low").alias("to"), F.lit(True).alias("flip"))
        while True:
            for _ in range(HALVINGS):
                further = chain.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("flip").alias("_flip"))
                joined = chain.join(further, "to", "left")
                chain = joined.select("id", F.coalesce("_to", "to").alias("to"), (F.col("flip") != F.coalesce("_flip", F.lit(False))).alias("flip"))
            chain = cut(chain)
            if chain.join(chain.select(F.col("id").alias("to")), "to", "left_semi").isEmpty():
                break
        ends = each.select(F.col("id").alias("to"), F.when(F.col("out"), False).when(F.col("low").isNull(), True).alias("_end"))
        followed = chain.join(ends, "to").select("id", F.when(F.col("flip"), ~F.col("_end")).otherwise(F.col("_end")).alias("_chained"))
        now = F.when(F.col("out"), False).when(F.col("low").isNull(), True).otherwise(F.col("_chained"))
        decided = each.join(followed, "id", "left").select("id", now.alias("_now"))
        status = cut(status.join(decided, "id", "left").select("id", F.coalesce("taken", "_now").alias("taken")))


def accept(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[str], group: str | None = None, targets: Mapping[str, int] | None = None) -> DataFrame:
    """rows with `place` (from 0, in the order) and `outcome`: accepted, duplicate, or full.

    In the order, a row is accepted unless it shares a key with an accepted one before it; a row that is not accepted keeps
    nobody out, and null keys are shared by none. With `targets`, a group takes no more rows once it has so many (a group
    without a target takes none), and what it leaves out is full, unless it is a duplicate. Equal places in the order stand
    in any order. Few targets are met over stretches of the order, many by rounds; there, when a group is full, the rows after
    that are decided anew, once for each group at most.
    """
    placed = cut(ordered.places(rows, [], list(order), "place"))
    columns = [F.col(c) if isinstance(c, str) else c for c in keys]
    if targets is not None and 16 * sum(max(n, 0) for n in targets.values()) <= LOOP:
        return _by_stretches(placed, columns, group, dict(targets)).select(*rows.columns, "place", "outcome")
    named = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}:"), c.cast("string"))) for k, c in enumerate(columns)]
    links = cut(placed.select(F.col("place").alias("id"), F.explode(F.array_distinct(F.array_compact(F.array(*named)))).alias("key")))
    status = placed.select(F.col("place").alias("id"), F.lit(None).cast("boolean").alias("taken"))
    if targets is None:
        decided = _taken(links, status)
    else:
        decided = _with_targets(links, status, placed.select(F.col("place").alias("id"), F.col(group).alias("group")), dict(targets))
    sharing = links.join(decided.filter("taken"), "id").groupBy("key").agg(F.min("id").alias("_by"))
    twice = links.join(sharing, "key").filter("_by < id").select("id").distinct().withColumn("_twice", F.lit(True))
    told = decided.join(twice, "id", "left")
    outcome = F.when(F.col("taken"), "accepted").when(F.col("_twice"), "duplicate").otherwise("full")
    return placed.join(told.select(F.col("id").alias("place"), outcome.alias("outcome")), "place").select(*rows.columns, "place", "outcome")


def _looped(room: Sequence[int], size: int, names: Sequence[str]):
    """Of a stretch in its order: the rows a loop takes, and one of slot -1 with the last id if the stretch has `size` rows."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, used, n, last = list(room), [set() for _ in names], 0, None
        for batch in batches:
            keep = []
            for at, (id_, slot, *values) in enumerate(batch[["id", "slot", *names]].itertuples(index=False, name=None)):
                n, last = n + 1, id_
                if left[slot] > 0 and not any(v is not None and v in u for v, u in zip(values, used, strict=True)):
                    left[slot] -= 1
                    keep.append(at)
                    for v, u in zip(values, used, strict=True):
                        u.add(v)
            yield batch.iloc[keep]
        if n == size:
            yield pd.DataFrame([(last, -1, *(None for _ in names))], columns=["id", "slot", *names])

    return step


def _by_stretches(placed: DataFrame, keys: Sequence[Column], group: str, targets: dict) -> DataFrame:
    """placed with `outcome`, for targets that are few in all.

    A stretch holds the next rows of the order that are still open: their group has room, and they share no key with a row
    taken in the stretches before. One task loops over it. It is eight times as long as the one before, LOOP rows at most;
    it ends when no group has room or no row is open. What is taken is at most the targets, so it is broadcast.
    """
    names = [f"_key{k}" for k in range(len(keys))]
    slot = reduce(lambda c, t: c.when(F.col(group) == t[1], t[0]), enumerate(targets), F.when(F.lit(False), -1))
    keyed = placed.withColumns({n: c.cast("string") for n, c in zip(names, keys, strict=True)})
    slim = keyed.select(F.col("place").alias("id"), slot.cast("int").alias("slot"), *names)
    room, begin, size = [max(n, 0) for n in targets.values()], 0, min(LOOP, max(1024, 16 * sum(max(n, 0) for n in targets.values())))
    schema = ", ".join(["id long", "slot int", *(f"{n} string" for n in names)])
    taken = placed.sparkSession.createDataFrame([], schema)
    while begin is not None and any(room):
        open_ = slim.filter((F.col("id") >= begin) & F.col("slot").isin(*[k for k, n in enumerate(room) if n]))
        for n in names:
            open_ = open_.join(F.broadcast(taken.select(n)), n, "left_anti")
        stretch = open_.select("id", "slot", *names).orderBy("id").limit(size).coalesce(1).sortWithinPartitions("id")
        found = cut(stretch.mapInPandas(_looped(room, size, names), schema))
        counts = {r["slot"]: r for r in found.groupBy("slot").agg(F.count("*").alias("n"), F.max("id").alias("last")).collect()}
        room = [n - (counts[k]["n"] if k in counts else 0) for k, n in enumerate(room)]
        begin = counts[-1]["last"] + 1 if -1 in counts else None
        taken, size = taken.unionByName(found.filter("slot >= 0")), min(LOOP, size * 8)
    own = F.broadcast(taken.select(F.col("id").alias("place"), F.lit(True).alias("_taken")))
    told, twice = keyed.join(own, "place", "left"), F.lit(False)
    for n in names:
        told = told.join(F.broadcast(taken.select(n, F.col("id").alias(f"_by{n}"))), n, "left")
        twice = twice | F.coalesce(F.col(f"_by{n}") < F.col("place"), F.lit(False))
    return told.withColumn("outcome", F.when(F.col("_taken"), "accepted").when(twice, "duplicate").otherwise("full"))


def _with_targets(links: DataFrame, status: DataFrame, groups: DataFrame, targets: dict) -> DataFrame:
    """The same with targets. Rows are decided in stretches of the order, each eight times as long, until every group is full or the rows end."""
    known = reduce(lambda c, t: c.when(F.col("group") == t[0], t[1]), targets.items(), F.when(F.lit(False), 0)).otherwise(0)
    full = {g for g, n in targets.items() if n <= 0}
    plan = cut(status.join(groups, "id").withColumn("_target", known))
    rows, begin, end = plan.count(), 0, max(1024, 16 * sum(max(n, 0) for n in targets.values()))
    done = plan.select("id", "taken").limit(0)
    while True:
        shut = F.col("_target") <= 0
        shut = shut | F.col("group").isin(*full) if full else shut
        fresh = plan.filter((F.col("id") >= begin) & (F.col("id") < end)).select("id", F.when(~shut, F.lit(None).cast("boolean")).otherwise(False).alias("taken"))
        done = _filled(links.filter(F.col("id") < end), cut(done.unionByName(fresh)), plan, known, full)
        if end >= rows or full >= set(targets):
            return done.unionByName(plan.filter(F.col("id") >= end).select("id", F.lit(False).alias("taken")))
        begin, end = end, end * 8


def _filled(links: DataFrame, status: DataFrame, groups: DataFrame, known: Column, full: set) -> DataFrame:
    """status with nothing undecided; groups that reach their target are closed after it, and come to `full`."""
    while True:
        done = _taken(links, status)
        counted = ordered.places(done.filter("taken").join(groups.select("id", "group"), "id"), ["group"], ["id"], "_k")
        # the row with which each group that was open reaches its target; the first of them is right, and what comes after it is not yet
        reached = {r["group"]: r["id"] for r in counted.withColumn("_target", known).filter("_k + 1 = _target").collect() if r["group"] not in full}
        if not reached:
            return done
        at = min(reached.values())
        full.update(g for g, i in reached.items() if i == at)
        shut = F.col("group").isin(*full) | (F.col("_target") <= 0)
        joined = done.withColumnRenamed("taken", "_done").join(groups.select("id", "group", "_target"), "id")
        status = cut(joined.select("id", F.when(F.col("id") <= at, F.col("_done")).when(shut, False).otherwise(F.lit(None).cast("boolean")).alias("taken")))


def disjoint_windows(rows: DataFrame, group: Sequence[str], stratum: Sequence[str], at: str, length: int, key: str, quota: int, salt: str) -> DataFrame:
    """rows with `outcome`: selected, overlap, or quota_full.

    A row is a window of `length` places that begins at `at`. In the order of a salted hash of its key, a row is selected
    unless its stratum (of a group) has its quota already, or else its window meets that of a selected row of its group.
    """
    group, stratum = list(group), [*group, *(s for s in stratum if s not in group)]
    ranked = rows.withColumn("_rank", F.struct(hash_uniform(F.lit(salt), F.col(key)).alias("h"), F.col(key).alias("k")))
    state = cut(ranked.select(*stratum, F.col(at).alias("_at"), "_rank", F.lit(None).cast("boolean").alias("_taken")))
    stretch = max(4096, 8 * length)
    while not state.filter("_taken IS NULL").isEmpty():
        live = state.filter("_taken IS NULL OR _taken")
        own = live.withColumn("_stretch", F.floor(F.col("_at") / stretch)).withColumn("_guest", F.lit(False))
        low, high = F.col("_at") % stretch < length, F.col("_at") % stretch >= stretch - length
        guests = own.filter(low).withColumn("_stretch", F.col("_stretch") - 1).unionByName(own.filter(high).withColumn("_stretch", F.col("_stretch") + 1)).withColumn("_guest", F.lit(True))
        near = Window.partitionBy(*group, "_stretch").orderBy("_at").rangeBetween(-(length - 1), length - 1)
        seen = own.unionByName(guests).withColumns({"_free": F.min(F.when(F.col("_taken").isNull(), F.col("_rank"))).over(near), "_hold": F.min(F.when(F.col("_taken"), F.col("_rank"))).over(near)}).filter("NOT _guest")
        counts = {"_in": F.when(F.col("_taken"), 1).otherwise(0), "_maybe": F.when(F.col("_taken").isNull(), 1).otherwise(0)}
        seen = ordered.sums_before(seen.drop("_guest", "_stretch"), stratum, ["_rank"], counts)
        out = (F.col("_hold") < F.col("_rank")) | (F.col("_in") >= quota)
        sure = (F.col("_free") == F.col("_rank")) & (F.col("_in") + F.col("_maybe") < quota)
        now = F.when(F.col("_taken").isNotNull(), F.col("_taken")).when(F.coalesce(out, F.lit(False)), False).when(sure, True)
        state = cut(seen.select(*stratum, "_at", "_rank", now.alias("_taken")).unionByName(state.filter("NOT _taken")))
    final = ordered.sums_before(state, stratum, ["_rank"], {"_in": F.col("_taken").cast("int")})
    outcome = F.when(F.col("_taken"), "selected").when(F.col("_in") >= quota, "quota_full").otherwise("overlap")
    told = final.select(*stratum, F.col("_at").alias(at), F.col("_rank.k").alias(key), outcome.alias("outcome"))
    return ordered.match(rows, told, [*stratum, at, key])
