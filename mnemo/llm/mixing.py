"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling, all in DataFrame functions.

Documents are counted by source, language and topic: a cell is one combination, its mass the tokens in it. Raking
scales the cells' masses until their sums over each dimension meet the target marginals. A cell's calibrated weight is
its fitted mass over its own; a document's expected copies are its cell's weight times one factor for all cells, such
that the expected tokens are the given share of all. The whole part of that number always stands in the sample and the
rest is the probability of one copy more, so a document of a cell of which there is more than wanted is drawn or not,
and one of a cell of which more is wanted than there is stands repeatedly: nothing is capped, and the sampled tokens meet
the targets in expectation. The draw is a hash of the doc_id, so a document's fate depends neither on partitions nor on
order.

Targets: a marginal is given as weights by value, or as an exponent by which the corpus's own shares are tempered
(1 leaves them, 0 makes all values equal). Values of the corpus without a given weight get none and are never kept.

Cells are counted with partial sums, so a hot source sends one row a task. The cell table alone passes through the
rounds, whose windows hold the cells of one value; totals and the factor are sums that leave one row. It is broadcast only up to MAX_BROADCAST_CELLS cells; a larger one is joined by its keys.

Defined cases: a null source or language is the value ''; a null text is empty and has no tokens, and a document
without tokens is kept like the rest of its cell (with the cell's weight, or if the whole cell has none, always).
Rows of equal doc_id share one draw, and a null doc_id is one like another. Repeated rows count as often as they stand.
Texts of any length are counted whole. An empty table gives no rows. The sample has the columns of docs, whatever their
names; mixed adds columns of its own, which replace equal names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

DIMENSIONS = ("source", "lang", "topic")
#: Exponents of the target marginals, rounds of raking, share of the tokens to keep.
EXPONENTS = {"source": 0.7, "lang": 0.7, "topic": 1.0}
ROUNDS = 8
KEEP = 0.9
SEED = 17
#: The marginals' largest deviation at which no more rounds follow, and rounds at most.
TOLERANCE = 1e-6
MAX_ROUNDS = 64
MAX_BROADCAST_CELLS = 10_000
TOKEN = r"[^\x20\x09-\x0D]+"


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def topic(text: Column, n_tokens: Column) -> Column:
    """A coarse topic by the form of a text: tables, shouting, symbols, brief, long or plain prose."""
    size = F.length(text)
    marks = F.length(F.regexp_replace(text, "[^#$%&*]+", ""))
    return (
        F.when(_count(text, "|") * 40 > size, "table")
        .when(_count(text, "!!") * 40 > size, "shout")
        .when(marks * 20 > size, "symbols")
        .when(n_tokens < 50, "brief")
        .when(n_tokens >= 1000, "long")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """docs with the columns __source, __lang, __topic and __tokens beside its own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = F.regexp_count(text, F.lit(TOKEN)).cast("long")
    out = docs.withColumns({"__source": F.coalesce(F.col("source").cast("string"), F.lit("")), "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "__tokens": tokens})
    return out.withColumn("__topic", topic(text, F.col("__tokens")))


def _target(cells: DataFrame, dimension: str, given: dict[str, float] | float) -> DataFrame:
    """value and share of the target marginal of one dimension."""
    if isinstance(given, dict):
        values = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "value string, weight double")
    else:
        sums = cells.groupBy(F.col(f"__{dimension}").alias("value")).agg(F.sum("tokens").alias("tokens"))
        values = sums.select("value", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(float(given)))).otherwise(0.0).alias("weight"))
    total = values.agg(F.sum("weight").alias("total"))
    return values.join(F.broadcast(total)).select(F.col("value").alias(f"__{dimension}"), (F.col("weight") / F.col("total")).alias(f"target_{dimension}"))


def deviation(cells: DataFrame) -> float:
    """The largest difference of a value's fitted share from its target share, over all values of cells that have tokens."""
    worst = [cells.groupBy(f"__{d}").agg(F.abs(F.sum("fitted") - F.first(f"target_{d}")).alias("off"), F.sum("tokens").alias("tokens")).filter("tokens > 0").agg(F.max("off")) for d in DIMENSIONS]
    return max((row[0] or 0.0) for row in (w.first() for w in worst))


def raked_cells(rows: DataFrame, targets: dict[str, dict[str, float] | float] = EXPONENTS, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """__source, __lang, __topic, tokens, target_*, fitted (share), weight and expected (copies of a document) of every cell of described rows.

    After `rounds` rounds four more follow at a time until all marginals are met to TOLERANCE, unless they get no nearer
    (targets can contradict each other where combinations are missing) or MAX_ROUNDS are done.
    """
    keys = [f"__{d}" for d in DIMENSIONS]
    cells = cut(rows.groupBy(*keys).agg(F.sum("__tokens").alias("tokens")))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for d in DIMENSIONS:
        # one row for a value of the dimension
        cells = cells.join(_target(cells, d, targets[d]), f"__{d}", "left").fillna(0.0, [f"target_{d}"])
    cells = cut(cells.withColumn("fitted", F.col("tokens") / float(total) if total else F.lit(0.0)))
    done, off = 0, None
    while True:
        for d in DIMENSIONS * (rounds if done == 0 and rounds < 4 else 4):
            mass = F.sum("fitted").over(Window.partitionBy(f"__{d}"))
            cells = cells.withColumn("fitted", F.when(mass > 0, F.col("fitted") * F.col(f"target_{d}") / mass).otherwise(0.0))
        cells = cut(cells)
        done += 4
        if done >= rounds:
            before, off = off, deviation(cells)
            if off <= TOLERANCE or done >= MAX_ROUNDS or (before is not None and off > 0.99 * before):
                break
    cells = cut(cells.withColumn("weight", F.when(F.col("tokens") > 0, F.col("fitted") * float(total) / F.col("tokens"))))
    wanted = cells.agg(F.sum(F.col("tokens") * F.col("weight"))).first()[0] or 0.0
    weight = F.col("weight")
    return cells.withColumn("expected", F.when(weight.isNull(), 1.0).otherwise(F.lit(keep * total / wanted) * weight) if wanted > 0 else F.lit(1.0))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 that the doc_id decides."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def mixed(docs: DataFrame, targets: dict[str, dict[str, float] | float] = EXPONENTS, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """docs with __source, __lang, __topic, __tokens, __weight, __expected and __copies beside its own columns."""
    rows = described(docs)
    keys = [f"__{d}" for d in DIMENSIONS]
    cells = raked_cells(rows, targets, keep=keep).select(*keys, F.col("weight").alias("__weight"), F.col("expected").alias("__expected"))
    if cells.limit(MAX_BROADCAST_CELLS + 1).count() <= MAX_BROADCAST_CELLS:
        cells = F.broadcast(cells)
    whole = F.floor("__expected")
    return rows.join(cells, keys).withColumn("__copies", whole + (draw(F.col("doc_id"), seed) < F.col("__expected") - whole).cast("long"))


def sample_mix(docs: DataFrame, targets: dict[str, dict[str, float] | float] = EXPONENTS, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """The rows of docs in the mix, with all their columns; a row stands there as often as its cell's share needs."""
    # the row in one struct, so that no column of docs clashes with the mix's own
    rows = docs.select("doc_id", "text", "source", "lang", F.struct(*docs.columns).alias("__row"))
    repeated = mixed(rows, targets, keep, seed).filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select("__row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, expected, copies (in the sample) and kept (whether there are any) of every document."""
    return mixed(docs.select("doc_id", "text", "source", "lang")).select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"),
        F.round("__weight", 6).alias("weight"), F.round("__expected", 6).alias("expected"), F.col("__copies").alias("copies"), (F.col("__copies") > 0).alias("kept"),
    )


def mix_sql(targets: dict[str, float] = EXPONENTS, rounds: int = ROUNDS, keep: float = KEEP, seed: int = SEED, documents: str = "documents") -> str:
    """DuckDB SQL of mix_report, for targets given as exponents."""
    count = lambda part: f"(length(t) - length(replace(t, '{part}', ''))) / {float(len(part))}"
    steps = [
        f"rows AS (SELECT *, length(regexp_extract_all(t, '{TOKEN}')) AS n_tokens FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM {documents}))",
        f"""told AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN {count('|')} * 40 > length(t) THEN 'table' WHEN {count('!!')} * 40 > length(t) THEN 'shout'
  WHEN (length(t) - length(translate(t, '#$%&*', ''))) * 20 > length(t) THEN 'symbols' WHEN n_tokens < 50 THEN 'brief' WHEN n_tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM rows)""",
        "counted AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM told GROUP BY ALL)",
        *(f"sum_{d} AS (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {targets[d]}) ELSE 0 END AS w FROM counted GROUP BY 1), goal_{d} AS (SELECT {d}, w / sum(w) OVER () AS target_{d} FROM sum_{d})" for d in DIMENSIONS),
        "fit_0 AS (SELECT *, tokens / sum(tokens) OVER () AS fitted FROM counted JOIN goal_source USING (source) JOIN goal_lang USING (lang) JOIN goal_topic USING (topic))",
    ]
    k = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            steps.append(f"fit_{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(fitted) OVER (PARTITION BY {d}) > 0 THEN fitted * target_{d} / sum(fitted) OVER (PARTITION BY {d}) ELSE 0 END AS fitted) FROM fit_{k})")
            k += 1
    steps += [
        f"weighed AS (SELECT *, CASE WHEN tokens > 0 THEN fitted * sum(tokens) OVER () / tokens END AS weight, sum(tokens) OVER () AS total FROM fit_{k})",
        f"cells AS (SELECT source, lang, topic, weight, CASE WHEN weight IS NULL OR NOT sum(tokens * weight) OVER () > 0 THEN 1.0 ELSE {keep} * total / sum(tokens * weight) OVER () * weight END AS expected FROM weighed)",
        f"drawn AS (SELECT doc_id, source, lang, topic, n_tokens, weight, expected, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT / {float(1 << 52)} AS draw FROM told JOIN cells USING (source, lang, topic))",
        "counts AS (SELECT *, floor(expected)::BIGINT + (draw < expected - floor(expected))::BIGINT AS copies FROM drawn)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(expected, 6) AS expected, copies, copies > 0 AS kept FROM counts"
