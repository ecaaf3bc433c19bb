"""Replies that arrive in parts, assembled with state over a stream, and the same over a table.

A reply's parts are numbered from 0; the last one says so (`final`). A reply is closed when all parts up to its final one are
there, or when the watermark passes its latest time by `patience`. Parts may come in any order and over any number of batches
and restarts. What is wrong invalidates the whole reply, and it has no text: `repeated` (a part twice), `gap` (a part is
lacking below another), `unfinished` (no final part), `continued` (a part beyond the final one), `too_long` (more characters
than `limit`; its text is no longer held). The first of these in this order is the reason.

The state of a reply is what it has said so far, at most `limit` characters, and the numbers of the parts; of a closed one, a
mark until the watermark has passed it, so that what comes afterwards is ignored and does not begin it anew. Parts later than
the watermark are left out, as everywhere in a stream. The state has a key for a block of 256 reply numbers in a row, as a
call for each reply costs more than the reply; so a batch touches the blocks of its replies, and a block never holds more.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REASONS = ("repeated", "gap", "unfinished", "continued", "too_long")
OUT = "reply_id long, n long, valid boolean, reason string, text string"
#: Replies of 2 ** BLOCK_BITS numbers in a row share a key of the state.
BLOCK_BITS = 8
#: Of each reply: parts: number and text of each part held; n: parts seen; last: number of the final part; latest: milliseconds.
STATE = "replies array<struct<reply:long,parts:array<struct<part:long,text:string>>,n:long,chars:long,repeated:boolean,last:long,latest:long,closed:boolean>>"


def outcome(parts: dict[int, str], n: int, chars: int, repeated: bool, last: int, limit: int) -> tuple[bool, str, str | None]:
    """Whether a closed reply is valid, the reason if not, and its text."""
    top = max(parts, default=-1)
    wrong = {"repeated": repeated, "gap": len(parts) != top + 1, "unfinished": last < 0, "continued": 0 <= last < top, "too_long": chars > limit}
    reason = next((r for r in REASONS if wrong[r]), "")
    return not reason, reason, None if reason else "".join(parts[k] for k in sorted(parts))


def assembled_stream(parts: DataFrame, patience: str = "10 minutes", delay: str = "1 minute", limit: int = 1 << 20) -> DataFrame:
    """reply_id, n, valid, reason and text of each reply of a stream of parts (reply_id, part, text, final, ts), once it is closed."""
    wait = int(pd.Timedelta(patience) / timedelta(milliseconds=1))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of each reply: parts, n, chars, repeated, last, latest, closed
        held = {r["reply"]: [{p["part"]: p["text"] for p in r["parts"]}, r["n"], r["chars"], r["repeated"], r["last"], r["latest"], r["closed"]] for r in (state.get[0] if state.exists else [])}
        touched = set()
        if not state.hasTimedOut:
            for batch in batches:
                for reply, part, text, final, at in zip(*(batch[c].tolist() for c in ("reply", "part", "text", "final", "at")), strict=True):
                    touched.add(reply)
                    h = held.setdefault(reply, [{}, 0, 0, False, -1, 0, False])
                    h[5] = max(h[5], at)
                    if h[6]:
                        continue
                    said, text = h[0], text or ""
                    h[1], h[2], h[3] = h[1] + 1, h[2] + (0 if part in said else len(text)), h[3] or part in said
                    said.setdefault(part, text)
                    if final:
                        h[4] = max(h[4], part)
        passed, out, kept = state.getCurrentWatermarkMs(), [], []
        for reply, (said, n, chars, repeated, last, latest, closed) in held.items():
            if reply in touched and chars > limit:
                said = dict.fromkeys(said, "")
            due = latest + wait <= passed
            done = due or (last >= 0 and max(said, default=-1) == last == len(said) - 1)
            if done and not closed:
                out.append((None if pd.isna(key[0]) else reply, n, *outcome(said, n, chars, repeated, last, limit)))
            if not due:
                closed = closed or done
                kept.append({"reply": reply, "parts": [] if closed else [{"part": k, "text": t} for k, t in said.items()], "n": n, "chars": chars, "repeated": repeated, "last": last, "latest": latest, "closed": closed})
        if kept:
            state.update((kept,))
            state.setTimeoutTimestamp(max(1, min(r["latest"] for r in kept) + wait - 1))  # a timeout comes once the watermark is beyond it
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    told = parts.select(F.col("reply_id").cast("long"), F.col("part").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("final"), F.lit(False)).alias("final"), F.col("ts").cast("timestamp").alias("ts"))
    told = told.filter("part IS NOT NULL AND ts IS NOT NULL").withColumn("at", F.unix_millis("ts"))
    told = told.select(F.shiftright("reply_id", BLOCK_BITS).alias("block"), F.coalesce("reply_id", F.lit(0)).alias("reply"), "part", "text", "final", "ts", "at")
    return told.withWatermark("ts", delay).groupBy("block").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def assembled(parts: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """The same of a table of parts, of which nothing more comes; with `latest`, the last time of each reply."""
    rows = parts.select(F.col("reply_id").cast("long"), F.col("part").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("final"), F.lit(False)).alias("final"), "ts").filter("part IS NOT NULL AND ts IS NOT NULL")
    each = rows.groupBy("reply_id", "part").agg(F.count("*").alias("_n"), F.min("text").alias("text"), F.bool_or("final").alias("final"), F.max("ts").alias("ts"))
    whole = each.groupBy("reply_id").agg(F.sum("_n").alias("n"), F.count("*").alias("_parts"), F.max("part").alias("_top"), F.max(F.when(F.col("final"), F.col("part"))).alias("_last"), F.sum(F.length("text")).alias("_chars"), F.array_sort(F.collect_list(F.struct("part", "text"))).alias("_said"), F.max("ts").alias("latest"))
    reason = (
        F.when(F.col("n") > F.col("_parts"), "repeated").when(F.col("_parts") != F.col("_top") + 1, "gap").when(F.col("_last").isNull(), "unfinished")
        .when(F.col("_last") < F.col("_top"), "continued").when(F.col("_chars") > limit, "too_long").otherwise("")
    )
    text = F.array_join(F.transform("_said", lambda s: s["text"]), "")
    return whole.select("reply_id", "n", (reason == "").alias("valid"), reason.alias("reason"), F.when(reason == "", text).alias("text"), "latest")


def drained(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there, appending to the table `out`, and read that."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
