"""Texts: reply parsing, language checks, fidelity, leaks, hashes, n-gram models, compression."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing, text
from ..operators import corpus, ngram
from ..sources import html
from .tables import r, table


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in every form that the parsers know, with failures, built from the events' columns."""
    e = table(spark, sf_dir, "events")
    v = F.format_string("%.2f", F.col("value") % 1)
    d = F.when(F.col("event_id") % 3 == 0, "1").when(F.col("event_id") % 3 == 1, "-1").otherwise("0")
    kind = F.col("event_id") % 10
    reply = (
        F.when(kind == 0, F.concat(F.lit("Direction: "), d, F.lit("\nConfidence: "), v))
        .when(kind == 1, F.concat(F.lit("**Direction:** 5 then Direction = "), d, F.lit(" and Confidence: "), F.floor(F.col("value") % 1 * 100).cast("string"), F.lit("%")))
        .when(kind == 2, F.concat(F.lit('Answer {"direction": '), d, F.lit(', "confidence": '), v, F.lit("} done")))
        .when(kind == 3, F.concat(F.lit("direction 7. {bad} {\"Direction\": \""), d, F.lit("\"}")))
        .when(kind == 4, F.concat(F.lit("My final Direction would be "), d, F.lit(", Confidence maybe "), v))
        .when(kind == 5, F.lit("The price will be higher than before, not lower at all"))
        .when(kind == 6, F.lit("It fell sharply; the trend is bearish"))
        .when(kind == 7, F.lit("Mostly unchanged, a flat day"))
        .when(kind == 8, F.lit("No idea. Confidence: 1.7"))
        .otherwise(F.lit(""))
    )
    return e.select("event_id", kind.cast("long").alias("kind"), reply.alias("reply"), d.cast("int").alias("expected"), "value")


def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the replies of each form parse."""
    rows = _replies(spark, sf_dir).withColumns({"direction": parsing.direction(F.col("reply")), "confidence": parsing.confidence(F.col("reply"))})
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count("direction").alias("n_direction"), F.sum("direction").cast("long").alias("sum_direction"), F.count("confidence").alias("n_confidence"), r(F.sum("confidence"), 4).alias("sum_confidence"))


def _sql_words(words: tuple[str, ...]) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN contains(z, '{w}') THEN length(z) - strpos(reverse(z), '{w[::-1]}') - {len(w)} + 2 ELSE 0 END" for w in words) + ")"


def _sql_last(pattern: str, kind: str) -> str:
    """The number in the last match of a pattern, if it is a direction or a share."""
    number = f"try_cast(regexp_extract_all(t, '{pattern}', 1)[-1] AS DOUBLE)"
    return f"CASE WHEN {number} IN (-1, 0, 1) THEN {number} END" if kind == "direction" else f"CASE WHEN {number} BETWEEN 0 AND 1 THEN {number} END"


def _sql_json(name: str, kind: str) -> str:
    numbers = [f"try_cast(json_extract_string(o, '$.{n}') AS DOUBLE)" for n in (name.lower(), name.title(), name.upper())]
    return ", ".join(f"CASE WHEN {n} IN (-1, 0, 1) THEN {n} END" if kind == "direction" else f"CASE WHEN {n} BETWEEN 0 AND 1 THEN {n} END" for n in numbers)


# the replies are made again, and parsed layer by layer
PARSED_REPLIES = rf"""WITH e AS (SELECT event_id % 10 AS kind, CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '-1' ELSE '0' END AS d, printf('%.2f', value % 1) AS v, floor(value % 1 * 100)::BIGINT AS pct FROM events),
w AS (SELECT kind, CASE kind WHEN 0 THEN 'Direction: ' || d || chr(10) || 'Confidence: ' || v WHEN 1 THEN '**Direction:** 5 then Direction = ' || d || ' and Confidence: ' || pct || '%' WHEN 2 THEN 'Answer {{"direction": ' || d || ', "confidence": ' || v || '}} done'
  WHEN 3 THEN 'direction 7. {{bad}} {{"Direction": "' || d || '"}}' WHEN 4 THEN 'My final Direction would be ' || d || ', Confidence maybe ' || v WHEN 5 THEN 'The price will be higher than before, not lower at all' WHEN 6 THEN 'It fell sharply; the trend is bearish'
  WHEN 7 THEN 'Mostly unchanged, a flat day' WHEN 8 THEN 'No idea. Confidence: 1.7' ELSE '' END AS t FROM e),
o AS (SELECT kind, t, lower(right(t, {parsing.TAIL_CHARS})) AS z, list_filter(regexp_extract_all(t, '{parsing.JSON_OBJECT}'), lambda x: json_valid(x))[1] AS o FROM w),
l AS (SELECT *, {_sql_words(parsing.UP_WORDS)} AS up, {_sql_words(parsing.DOWN_WORDS)} AS down, {_sql_words(parsing.FLAT_WORDS)} AS flat, try_cast(regexp_extract_all(t, '{parsing.PERCENT}', 1)[-1] AS DOUBLE) / 100 AS percent FROM o),
p AS (SELECT kind, coalesce({_sql_last(parsing.DIRECTION, "direction")}, {_sql_json("direction", "direction")}, {_sql_last(parsing.DIRECTION_LOOSE, "direction")}, CASE WHEN greatest(up, down, flat) = 0 THEN NULL WHEN greatest(up, down, flat) = up THEN 1 WHEN greatest(up, down, flat) = down THEN -1 ELSE 0 END) AS direction,
  coalesce(CASE WHEN percent <= 1 THEN percent END, {_sql_last(parsing.CONFIDENCE, "share")}, {_sql_json("confidence", "share")}, {_sql_last(parsing.CONFIDENCE_LOOSE, "share")}) AS confidence FROM l)
SELECT kind, count(*) AS n, count(direction) AS n_direction, sum(direction)::BIGINT AS sum_direction, count(confidence) AS n_confidence, round(sum(confidence), 4) AS sum_confidence FROM p GROUP BY 1"""


def strict_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict JSON of components with fences, duplicate keys, constants and bounds."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 6
    body = F.concat(F.lit('{"a": '), F.col("event_id").cast("string"), F.lit(', "b": 0.5}'))
    reply = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.lit('{"a": 1, "a": 2}')).when(kind == 3, F.lit('{"a": NaN}')).when(kind == 4, F.lit('{"a": true}')).otherwise(F.lit("[1]"))
    rows = e.select(kind.cast("long").alias("kind"), parsing.parse_components(reply).alias("p"))
    inside = parsing.within_bounds(F.col("p.components"), {"a": (0.0, 5000.0), "b": (0.0, 1.0)})
    return rows.groupBy("kind", F.coalesce("p.code", F.lit("ok")).alias("code")).agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"))


STRICT_COMPONENTS = r"""WITH e AS (SELECT event_id % 6 AS kind, '{"a": ' || event_id || ', "b": 0.5}' AS body FROM events),
t AS (SELECT kind, CASE kind WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN '{"a": 1, "a": 2}' WHEN 3 THEN '{"a": NaN}' WHEN 4 THEN '{"a": true}' ELSE '[1]' END AS t FROM e),
u AS (SELECT kind, coalesce(nullif(regexp_extract(t, '(?s)\A\s*```(?:json)?[ \t]*\n(.*?)\n?```\s*\z', 1), ''), t) AS t FROM t),
j AS (SELECT kind, CASE WHEN json_valid(t) AND NOT regexp_matches(t, '\b(NaN|Infinity)\b') THEN t::JSON END AS j FROM u),
k AS (SELECT kind, j, CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) END AS keys, CASE WHEN json_type(j) = 'OBJECT' THEN list_transform(json_extract(j, '$.*'), lambda x: json_type(x)) END AS kinds FROM j),
c AS (SELECT kind, j, keys, CASE WHEN j IS NULL THEN 'not_json' WHEN coalesce(len(keys), 0) = 0 THEN 'not_object' WHEN len(list_distinct(keys)) < len(keys) THEN 'duplicate_key' WHEN len(list_filter(kinds, lambda x: x NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT'))) > 0 THEN 'not_number' ELSE 'ok' END AS code FROM k)
SELECT kind, code, count(*) AS n, count(*) FILTER (code = 'ok' AND list_sort(keys) = ['a', 'b'] AND try_cast(j ->> '$.a' AS DOUBLE) BETWEEN 0 AND 5000 AND try_cast(j ->> '$.b' AS DOUBLE) BETWEEN 0 AND 1) AS n_inside FROM c GROUP BY ALL"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-field answers: answered, abstained or invalid."""
    props = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.lit('{"k": null}')).otherwise(F.col("props")).alias("reply"))
    return props.groupBy(parsing.answer_status(F.col("reply"), "k").alias("status")).agg(F.count("*").alias("n"))


ANSWERS = r"""SELECT CASE WHEN event_id % 7 = 0 THEN 'abstained' WHEN regexp_full_match(trim(props), '\{\s*"k"\s*:\s*-?\d+(\.\d+)?\s*\}') THEN 'answered' ELSE 'invalid' END AS status, count(*) AS n FROM events GROUP BY 1"""


def english_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(text.english_looking(F.col("text"))).alias("n_english"))


_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
ENGLISH_DOCUMENTS = rf"""WITH t AS (SELECT lang, regexp_extract_all(lower(text), '[a-z]+') AS w, regexp_replace(text, '[ \t\n\r\v\f]+', '', 'g') AS d FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (len(w) >= 30 AND length(regexp_replace(d, '[^\x00-\x7F]+', '', 'g')) / length(d)::DOUBLE >= 0.95 AND len(list_filter(w, lambda x: x IN ({_STOPS}))) / len(w)::DOUBLE >= 0.12) AS n_english FROM t GROUP BY 1"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of a title (the first line) and a body, their key and deduplication key."""
    lines = F.split("text", "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.get(lines, F.lit(0)).alias("title"), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), " ").alias("body"))
    built = docs.withColumn("prompt", text.build_prompt(F.col("title"), F.col("body")))
    return built.select("doc_id", text.prompt_key(F.col("prompt")).alias("key"), text.dedup_key(F.col("title"), F.col("prompt")).alias("dedup"), F.length("prompt").cast("long").alias("n"))


PROMPTS = r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), t AS (SELECT doc_id, l[1] AS title, array_to_string(l[2:], ' ') AS body FROM l), p AS (SELECT doc_id, title, trim(left(title || chr(10) || chr(10) || coalesce(body, ''), 1500), ' ') AS prompt FROM t)
SELECT doc_id, left(sha256(prompt), 16) AS key, CASE WHEN length(trim(title, ' ')) > 0 THEN sha256(lower(trim(title, ' '))) ELSE sha256(prompt) END AS dedup, length(prompt) AS n FROM p"""


def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that look like titles, by language."""
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(text.title_like(F.col("line"))).alias("n_titles"))


TITLE_LINES = r"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (length(line) >= 20 AND length(regexp_replace(line, '\P{L}+', '', 'g')) >= 0.6::DOUBLE * length(replace(line, ' ', '')) AND len(regexp_split_to_array(trim(line, ' '), '\s+')) >= 3) AS n_titles FROM l GROUP BY 1"""


def fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and capitalised words that a rewrite (every third sentence dropped) lost or gained."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array_join(F.filter(F.split("text", "\n"), lambda s, i: i % 3 != 2), "\n").alias("rewrite"))
    tokens = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+(?:[.,][0-9]+)*|[A-Z][A-Za-z]+"), F.lit(0))
    a, b = (docs.select("doc_id", F.explode(tokens(F.col(c))).alias("token")) for c in ("text", "rewrite"))
    return corpus.multiset_difference(a, b, ["doc_id"], "token").groupBy("doc_id").agg(F.count("*").alias("n_changed"), F.sum(F.col("n_original") - F.col("n_candidate")).alias("n_lost"))


FIDELITY = r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), w AS (SELECT doc_id, text, array_to_string(list_filter(l, lambda s, i: (i - 1) % 3 <> 2), chr(10)) AS rewrite FROM d),
a AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*|[A-Z][A-Za-z]+')) AS token FROM w), b AS (SELECT doc_id, unnest(regexp_extract_all(rewrite, '[0-9]+(?:[.,][0-9]+)*|[A-Z][A-Za-z]+')) AS token FROM w),
c AS (SELECT doc_id, token, count(*) AS n, 0 AS m FROM a GROUP BY ALL UNION ALL SELECT doc_id, token, 0, count(*) FROM b GROUP BY ALL), s AS (SELECT doc_id, token, sum(n) AS n, sum(m) AS m FROM c GROUP BY ALL)
SELECT doc_id, count(*) AS n_changed, sum(n - m)::BIGINT AS n_lost FROM s WHERE n <> m GROUP BY 1"""


def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which a run of eight words stands in a document."""
    return corpus.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


LEAK_SCAN = r"""WITH t AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
g AS (SELECT DISTINCT side, id, array_to_string(w[i:i + 7], ' ') AS r FROM t, unnest(range(1, greatest(len(w) - 7, 1) + 1)) u(i) WHERE len(w) >= 8), s AS (SELECT id, count(*) AS n_runs FROM g WHERE side = 1 GROUP BY 1)
SELECT a.id AS doc_id, b.id AS item_id, count(*) AS n_hits, any_value(n_runs) AS n_runs FROM g a JOIN g b ON a.r = b.r AND a.side = 0 AND b.side = 1 JOIN s ON s.id = b.id GROUP BY ALL"""


def trigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items scored under a trigram model of the English documents."""
    docs = table(spark, sf_dir, "documents").filter("lang = 'en'")
    one, two, three = ngram.counts(ngram.tokens(docs, "doc_id", "text"))
    items = ngram.tokens(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return ngram.score(items, one, two, three, "item_id").select("item_id", "n_tokens", r("log_p", 5).alias("log_p"))


TRIGRAM_SCORES = r"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents WHERE lang = 'en'), b AS (SELECT item_id AS id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM benchmark),
t AS (SELECT w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM d, unnest(range(1, len(w) + 1)) u(i)), q AS (SELECT id, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM b, unnest(range(1, len(w) + 1)) u(i)),
n1 AS (SELECT c, count(*) AS n FROM t GROUP BY 1), n2 AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY ALL), n3 AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY ALL),
o1 AS (SELECT b, sum(n) AS n FROM n2 GROUP BY 1), o2 AS (SELECT a, b, sum(n) AS n FROM n3 GROUP BY ALL), z AS (SELECT sum(n)::DOUBLE AS total, count(*) AS v FROM n1),
p AS (SELECT q.id, (coalesce(n3.n, 0) + (coalesce(n2.n, 0) + (coalesce(n1.n, 0) + 1) / (total + v)) / (coalesce(o1.n, 0) + 1)) / (coalesce(o2.n, 0) + 1) AS p
  FROM q CROSS JOIN z LEFT JOIN n1 ON q.c = n1.c LEFT JOIN n2 ON q.b = n2.b AND q.c = n2.c LEFT JOIN n3 ON q.a = n3.a AND q.b = n3.b AND q.c = n3.c LEFT JOIN o1 ON q.b = o1.b LEFT JOIN o2 ON q.a = o2.a AND q.b = o2.b)
SELECT id AS item_id, count(*) AS n_tokens, round(sum(ln(p)), 5) AS log_p FROM p GROUP BY 1"""


def trigram_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity of a language's counts: distinct and total n-grams, and contexts that outnumber their unigram."""
    words = ngram.tokens(table(spark, sf_dir, "documents"), "doc_id", "text", by=("lang",))
    return ngram.integrity(words, ("lang",)).select("lang", *[f"{c}{k}" for k in (1, 2, 3) for c in ("distinct", "total")], "n_bad")


TRIGRAM_TOTALS = r"""WITH d AS (SELECT lang, doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents), t AS (SELECT lang, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM d, unnest(range(1, len(w) + 1)) u(i)),
x AS (SELECT lang, count(DISTINCT c) AS distinct1, count(*) AS total1, count(DISTINCT (b, c)) FILTER (b IS NOT NULL) AS distinct2, count(b) AS total2, count(DISTINCT (a, b, c)) FILTER (a IS NOT NULL) AS distinct3, count(a) AS total3 FROM t GROUP BY 1),
u AS (SELECT lang, c AS token, count(*) AS n FROM t GROUP BY ALL), o AS (SELECT lang, b AS token, count(*) AS out FROM t WHERE b IS NOT NULL GROUP BY ALL),
y AS (SELECT o.lang, count(*) FILTER (out > coalesce(u.n, 0)) AS n_bad FROM o LEFT JOIN u ON o.lang = u.lang AND o.token = u.token GROUP BY 1)
SELECT x.*, n_bad FROM x JOIN y USING (lang)"""


@F.pandas_udf(T.LongType())
def _compressed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(zlib.compress((t or "").encode(), 9)))


def zlib_size(c: Column) -> Column:
    """Bytes of the text compressed at level 9."""
    return _compressed(c)


def zlib_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed size and ratio of every document; an empty text has ratio 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"), zlib_size(F.col("text")).alias("z"))
    return docs.select("doc_id", "z", r(F.when(F.col("n") > 0, F.col("n") / F.col("z")).otherwise(0.0)).alias("ratio"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, share of table text and first title of every page."""
    rows = table(spark, sf_dir, "pages").select("page_id", html.page_lines(F.col("html")).alias("p"))
    return rows.select("page_id", F.size("p.lines").cast("long").alias("n_lines"), r("p.table_share").alias("table_share"), text.first_title(F.col("p.lines")).alias("title"))


QUERIES = {
    "parsed_replies": parsed_replies,
    "strict_components": strict_components,
    "answers": answers,
    "english_documents": english_documents,
    "prompts": prompts,
    "title_lines": title_lines,
    "fidelity": fidelity,
    "leak_scan": leak_scan,
    "trigram_scores": trigram_scores,
    "trigram_totals": trigram_totals,
    "zlib_ratios": zlib_ratios,
    "page_lines": page_lines,
}
ORACLE_SQL = {
    "parsed_replies": PARSED_REPLIES,
    "strict_components": STRICT_COMPONENTS,
    "answers": ANSWERS,
    "english_documents": ENGLISH_DOCUMENTS,
    "prompts": PROMPTS,
    "title_lines": TITLE_LINES,
    "fidelity": FIDELITY,
    "leak_scan": LEAK_SCAN,
    "trigram_scores": TRIGRAM_SCORES,
    "trigram_totals": TRIGRAM_TOTALS,
}
