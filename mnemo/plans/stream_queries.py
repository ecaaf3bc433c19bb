"""Streams over the driver's tables: replies in parts with state, and a log of draws with an account of its lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import shared_folder
from ..streaming import logs, replies
from .tables import r, table

PATIENCE_S = 600


def _parts(events: DataFrame) -> DataFrame:
    """Events as parts of replies of three to eight parts; errors are lost, some purchases come twice."""
    reply, part = F.floor(F.col("event_id") / 8), F.col("event_id") % 8
    size = 3 + reply % 6
    rows = events.select(reply.alias("reply_id"), part.alias("part"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit(";")).alias("text"), (part == size - 1).alias("final"), "ts", (part < size).alias("_in"), "event_type", "value")
    twice = F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("_in AND event_type <> 'error'").withColumn("_copy", F.explode(twice)).select("reply_id", "part", "text", "final", "ts")


def streamed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that a stream of the events closes: complete ones, and those that the watermark has passed."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern, as a stream's own path must be a folder
    closed = replies.assembled_stream(_parts(events), f"{PATIENCE_S} seconds", "0 seconds")
    folder = shared_folder(spark, "replies")
    return replies.drained(closed, f"{folder}/out", f"{folder}/checkpoint").withColumn("text", F.md5("text"))


STREAMED_REPLIES = f"""WITH e AS (SELECT event_id // 8 AS reply_id, event_id % 8 AS part, event_type || ' ' || event_id || ';' AS text, 3 + (event_id // 8) % 6 AS size, ts, event_type, value FROM events),
k AS (SELECT e.* FROM e, generate_series(1, CASE WHEN event_type = 'purchase' AND value > 60 THEN 2 ELSE 1 END) WHERE part < size AND event_type <> 'error'),
p AS (SELECT reply_id, part, count(*) AS c, any_value(text) AS text, any_value(size) AS size, max(ts) AS ts FROM k GROUP BY ALL),
w AS (SELECT reply_id, sum(c)::BIGINT AS n, count(*) AS parts, max(part) AS top, any_value(size) AS size, string_agg(text, '' ORDER BY part) AS text, max(ts) AS latest FROM p GROUP BY 1),
o AS (SELECT *, CASE WHEN n > parts THEN 'repeated' WHEN parts <> top + 1 THEN 'gap' WHEN top < size - 1 THEN 'unfinished' ELSE '' END AS reason, parts = size AS whole FROM w)
SELECT reply_id, n, reason = '' AS valid, reason, CASE WHEN reason = '' THEN md5(text) END AS text FROM o WHERE whole OR latest + INTERVAL {PATIENCE_S} SECOND <= (SELECT max(ts) FROM k)"""


def assembled_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same replies from the table at once, with all that stay open."""
    out = replies.assembled(_parts(table(spark, sf_dir, "events")))
    return out.select("reply_id", "n", "valid", "reason", F.md5("text").alias("text"))


ASSEMBLED_REPLIES = STREAMED_REPLIES[: STREAMED_REPLIES.index(" WHERE whole OR")]

DRAW_SCHEMA = "plan_hash string, user_id long, event_type string, version long, value double"


def _draw_log(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON lines made of the events: some are cut short, some were recorded under another plan."""
    e = table(spark, sf_dir, "events")
    plan = F.when(F.col("event_id") % 89 == 0, "plan-0").otherwise("plan-1")
    line = F.to_json(F.struct(plan.alias("plan_hash"), "user_id", "event_type", F.col("event_id").alias("version"), "value"))
    torn = F.when(F.col("event_id") % 97 == 0, F.substring(line, 1, 25)).otherwise(line)
    folder = shared_folder(spark, "draw-log")
    e.select(torn.alias("value")).write.text(f"{folder}/lines")
    return folder


def draw_log_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the log, torn, foreign and superseded ones, after a stream and a compaction."""
    folder = _draw_log(spark, sf_dir)
    key, order, out = ["user_id", "event_type"], ["version"], f"{folder}/table"
    logs.drain_log(spark, f"{folder}/lines", DRAW_SCHEMA, key, order, out, f"{folder}/checkpoint", "plan-1", refuse=False)
    logs.compact(spark, out, key, order)
    latest = logs.latest_of_table(spark, out, key, order).agg(r(F.sum("value"), 4).alias("latest_value"), F.sum("version").alias("latest_version"))
    return logs.account(spark, out, key, order).crossJoin(latest)


DRAW_LOG_ACCOUNT = """WITH e AS (SELECT *, event_id % 97 = 0 AS torn, event_id % 97 <> 0 AND event_id % 89 = 0 AS foreign_ FROM events),
l AS (SELECT user_id, event_type, max(event_id) AS version, arg_max(value, event_id) AS value FROM e WHERE NOT torn AND NOT foreign_ GROUP BY ALL)
SELECT count(*) AS lines, count(*) FILTER (torn) AS torn, count(*) FILTER (foreign_) AS "foreign", count(*) FILTER (NOT torn AND NOT foreign_) AS draws, (SELECT count(*) FROM l) AS keys,
  count(*) FILTER (NOT torn AND NOT foreign_) - (SELECT count(*) FROM l) AS superseded, (SELECT round(sum(value), 4) FROM l) AS latest_value, (SELECT sum(version)::BIGINT FROM l) AS latest_version FROM e"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (streamed_replies, assembled_replies, draw_log_account)}
ORACLE_SQL: dict[str, str] = {name: globals()[name.upper()] for name in QUERIES}
