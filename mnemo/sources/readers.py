"""Readers of evaluation sets, registries, snapshots, observations, charts and indexes; writers of records."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVAL_SCHEMA = "_cutoff_date string, prompt string, target_direction int, metadata map<string,string>, _corrupt_record string"


def read_eval_set(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """Rows (prompt, target_direction, metadata, row hash) of JSON lines, and the cutoff date of a header line.

    A line that is no object, a missing prompt or a target other than -1, 0 and 1 fails the read when it is run.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", EVAL_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    header = F.col("r._cutoff_date").isNotNull() & F.col("r.prompt").isNull()
    cutoffs = rows.filter(header).select("r._cutoff_date").limit(2).collect()
    if len(cutoffs) > 1:
        raise ValueError("more than one header line")
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r.prompt").isNull() | ~F.coalesce(F.col("r.target_direction").isin(-1, 0, 1), F.lit(False))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad evaluation row: "), F.substring("value", 1, 80)))).otherwise(F.col("r.prompt"))
    out = rows.filter(~header).select(checked.alias("prompt"), "r.target_direction", "r.metadata", F.sha2("value", 256).alias("row_hash"))
    return out, cutoffs[0][0] if cutoffs else None


def eval_warnings(rows: DataFrame, least: int = 100, most: float = 0.6) -> DataFrame:
    """n, share of the majority class, and warnings of a small or lopsided set."""
    counts = rows.groupBy("target_direction").agg(F.count("*").alias("c"))
    out = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), (F.max("c") / F.sum("c")).alias("majority"))
    return out.withColumn("warnings", F.array_compact(F.array(F.when(F.col("n") < least, "few rows"), F.when(F.col("majority") > most, "lopsided"))))


def read_cutoffs(spark: SparkSession, path: str) -> DataFrame:
    """model, cutoff and source (the address in the line's comment) of a YAML file with `models:` and `id: date` lines."""
    lines = spark.read.text(path)
    pattern = r"^\s+[\"']?([^\"'#\s][^\"'#]*?)[\"']?\s*:\s*[\"']?(\d{4}-\d{2}-\d{2})[\"']?\s*(?:#.*?(https?://\S+).*|#.*)?$"
    found = lines.select(*(F.regexp_extract("value", pattern, i).alias(n) for i, n in ((1, "model"), (2, "cutoff"), (3, "source")))).filter("model <> ''")
    return found.select("model", F.to_date("cutoff").alias("cutoff"), F.nullif("source", F.lit("")).alias("source"))


def read_snapshot(spark: SparkSession, path: str, series: str) -> DataFrame:
    """day and value of a two-column CSV file with an exact header; '.' and blank are null; a day that stands twice fails the read."""
    rows = spark.read.option("header", True).option("enforceSchema", False).option("nullValue", ".").schema(f"DATE date, {series} double").csv(path)
    dup = F.count("*").over(Window.partitionBy("DATE"))
    day = F.when(dup > 1, F.raise_error(F.concat(F.lit("repeated day "), F.col("DATE").cast("string"))).cast("date")).otherwise(F.col("DATE"))
    return rows.select(day.alias("day"), F.col(series).alias("value"))


def observations(rows: DataFrame, body: str, as_of: str) -> DataFrame:
    """series, day and value of observation documents: '.' is left out, days after as_of and outside the real-time window too."""
    schema = "observations array<struct<date:string,value:string,realtime_start:string,realtime_end:string>>"
    found = rows.select("series", F.explode(F.from_json(body, schema)["observations"]).alias("o"))
    inside = (F.col("o.date") <= as_of) & (F.col("o.realtime_start") <= as_of) & (F.col("o.realtime_end") >= as_of)
    return found.filter((F.col("o.value") != ".") & inside).select("series", F.to_date("o.date").alias("day"), F.col("o.value").try_cast("double").alias("value"))


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def chart_bars(rows: DataFrame, body: str) -> DataFrame:
    """ticker, day and close of chart documents with parallel arrays of timestamps and closes; state 'ok', 'missing' or 'invalid'."""
    schema = "chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>"
    result = F.get(F.from_json(body, schema)["chart"]["result"], F.lit(0))
    closes = F.get(result["indicators"]["quote"], F.lit(0))["close"]
    bars = rows.select("ticker", F.explode(F.arrays_zip(result["timestamp"].alias("t"), closes.alias("c"))).alias("b"))
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("b.t"), "America/New_York"))
    return bars.select("ticker", day.alias("day"), F.col("b.c").alias("close"), F.when(F.col("b.c").isNull(), "missing").when(F.col("b.c") <= 0, "invalid").otherwise("ok").alias("state"))


def form_index(lines: DataFrame, forms: Sequence[str]) -> DataFrame:
    """form, company, cik, filed and file of a fixed-width index: the last three fields are split off from the right."""
    value = F.rtrim("value")
    tail = r"^(.*?)\s+(\d+)\s+(\d{4}-?\d{2}-?\d{2})\s+(\S+)$"
    head, cik, filed, file = (F.regexp_extract(value, tail, i) for i in (1, 2, 3, 4))
    form = F.regexp_extract(head, "^(" + "|".join(re.escape(f) for f in sorted(forms, key=len, reverse=True)) + r")\s{2,}(\S.*)$", 1)
    company = F.trim(F.regexp_replace(head, r"^\S+(?: \S+)*?\s{2,}", ""))
    return lines.filter(form != "").select(form.alias("form"), company.alias("company"), cik.alias("cik"), F.to_date(F.regexp_replace(filed, "-", ""), "yyyyMMdd").alias("filed"), file.alias("file"))


# fixed values: the type of the wanted exhibit, the endings of text files, and the host of relative links
EXHIBIT = r"(?i)^EX-99\.0?1$"
TEXT_FILE = r"(?i)\.(htm|html|txt)$"
FILING_HOST = "https://www.sec.gov"


def listed_exhibit(body: Column, folder: Column) -> Column:
    """The address of a filing's exhibit by the types in its folder's JSON listing; null if the listing names none."""
    items = F.from_json(body, "directory struct<item array<struct<type string, name string>>>")["directory"]["item"]
    wanted = F.filter(items, lambda x: x["type"].rlike(EXHIBIT) & x["name"].rlike(TEXT_FILE))
    return F.concat(folder, F.lit("/"), F.get(wanted, F.lit(0))["name"])


def linked_exhibit(html: Column) -> Column:
    """The address of a filing's exhibit by the table of its index page: the first link of the first row of that type to a text."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))

    def typed(row: Column) -> Column:
        cells = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1))
        return F.exists(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"(\s|&nbsp;)+", " ")).rlike(EXHIBIT))

    def link(row: Column) -> Column:
        found = F.regexp_extract(row, r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']""", 1)
        return F.regexp_replace(found, r"^/ix\?doc=", "")

    links = F.filter(F.transform(F.filter(rows, typed), link), lambda x: x.rlike(TEXT_FILE))
    first = F.get(links, F.lit(0))
    return F.when(first.startswith("http"), first).otherwise(F.concat(F.lit(FILING_HOST), first))


def write_records(records: DataFrame, path: str) -> None:
    """One JSON line for each record."""
    records.write.mode("overwrite").json(path)


def write_summary(summary: DataFrame, path: str, columns: Sequence[str], places: int = 6) -> None:
    """A CSV table with fixed columns; numbers that are none are empty, doubles have a fixed number of places."""
    kinds = dict(summary.dtypes)

    def cell(name: str) -> Column:
        if kinds[name] != "double":
            return F.col(name)
        return F.when(F.col(name).isNull() | F.isnan(name), None).otherwise(F.format_string(f"%.{places}f", F.col(name))).alias(name)

    summary.select(*[cell(c).alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; lines whose model begins with two underscores are sentinels and left out."""
    return spark.read.schema(schema).json(path).filter(~F.col("model").startswith("__"))
