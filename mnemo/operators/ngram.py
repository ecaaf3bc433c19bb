"""Interpolated trigram models from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut


def tokens(docs: DataFrame, doc_id: str, text: str, pattern: str = r"\p{L}+", by: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, place and token of every word, with the two tokens before it in the same document."""
    words = docs.select(*by, doc_id, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0)).alias("token"))
    # the words before are taken within the row, by shifted copies, so nothing is shuffled to put them beside each other
    shifted = lambda k: F.slice(F.concat(F.array(*[F.lit(None).cast("string")] * k), "token"), F.lit(1), F.size("token"))
    zipped = words.select(*by, doc_id, "token", shifted(1).alias("before1"), shifted(2).alias("before2"))
    return zipped.select(*by, doc_id, F.posexplode(F.arrays_zip("token", "before1", "before2")).alias("place", "_g")).select(*by, doc_id, "place", "_g.*")


def counts(words: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unigram, bigram and trigram counts of tokens(); contexts end at document boundaries."""
    one = words.groupBy(*by, "token").agg(F.count("*").alias("n1"))
    two = words.filter("before1 IS NOT NULL").groupBy(*by, "before1", "token").agg(F.count("*").alias("n2"))
    three = words.filter("before2 IS NOT NULL").groupBy(*by, "before2", "before1", "token").agg(F.count("*").alias("n3"))
    return one, two, three


def integrity(words: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, distinct and total n-grams of each order, and n_bad: words that come before others more often than they come at all.

    Trigrams are counted, of these bigrams and of these words: tokens() is read once, and only the first step deals all grams.
    """
    where = lambda c, n: F.sum(F.when(F.col(c).isNotNull(), n).otherwise(0))
    three = words.groupBy(*by, "before2", "before1", "token").agg(F.count("*").alias("n"))
    two = three.groupBy(*by, "before1", "token").agg(F.sum("n").alias("n"), F.count("before2").alias("distinct3"), where("before2", F.col("n")).alias("total3"))
    own = F.struct(F.col("token").alias("word"), F.col("n").alias("n1"), F.lit(0).cast("long").alias("out"), "distinct3", "total3", F.col("before1").isNotNull().cast("long").alias("distinct2"), F.when(F.col("before1").isNotNull(), F.col("n")).otherwise(0).alias("total2"))
    none = [F.lit(0).cast("long").alias(c) for c in ("distinct3", "total3", "distinct2", "total2")]
    context = F.struct(F.col("before1").alias("word"), F.lit(0).cast("long").alias("n1"), F.col("n").alias("out"), *none)
    both = two.select(*by, F.explode(F.when(F.col("before1").isNull(), F.array(own)).otherwise(F.array(own, context))).alias("_w")).select(*by, "_w.*")
    sums = ("n1", "out", "distinct3", "total3", "distinct2", "total2")
    one = both.groupBy(*by, "word").agg(*[F.sum(c).alias(c) for c in sums])
    found = one.groupBy(*by).agg(F.count_if(F.col("n1") > 0).alias("distinct1"), F.sum("n1").alias("total1"), *[F.sum(f"{c}{k}").alias(f"{c}{k}") for k in (2, 3) for c in ("distinct", "total")], F.count_if(F.col("out") > F.col("n1")).alias("n_bad"))
    return found.filter("total2 > 0")


def interpolated(n1: Column, total: Column, vocabulary: Column, n2: Column, out1: Column, n3: Column, out2: Column) -> Column:
    """p3 from counts: each order is smoothed by the one below with the weight of one observation."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    p1 = (zero(n1) + 1) / (total + vocabulary)
    p2 = (zero(n2) + p1) / (zero(out1) + 1)
    return (zero(n3) + p2) / (zero(out2) + 1)


def score(words: DataFrame, one: DataFrame, two: DataFrame, three: DataFrame, doc_id: str) -> DataFrame:
    """Token count and summed log probability of each document under a model's counts. Unseen contexts back off.

    The document side is made distinct by trigram first, so a repeated trigram is looked up once a document. Of the counts
    only those of the documents' words and contexts are kept: as they are keys of the counts, what else a model counts goes
    before it is shuffled. The sums of a context are of all that follows it in the model.
    """
    one = cut(one)
    whole = one.agg(F.sum("n1").alias("total"), F.count("*").alias("vocabulary"))
    asked = lambda *names: words.select(*names).distinct()
    one = one.join(asked("token"), "token", "left_semi")
    # each order is counted once: what is kept serves the lookups and the sums of its contexts
    two = cut(two.join(asked("before1").filter("before1 IS NOT NULL"), "before1", "left_semi"))
    three = cut(three.join(asked("before2", "before1").filter("before2 IS NOT NULL"), ["before2", "before1"], "left_semi"))
    out1 = two.groupBy("before1").agg(F.sum("n2").alias("out1"))
    out2 = three.groupBy("before2", "before1").agg(F.sum("n3").alias("out2"))
    grams = words.groupBy(doc_id, "before2", "before1", "token").agg(F.count("*").alias("c"))
    found = (
        grams.join(one, "token", "left")
        .join(two, ["before1", "token"], "left")
        .join(out1, "before1", "left")
        .join(three, ["before2", "before1", "token"], "left")
        .join(out2, ["before2", "before1"], "left")
        .join(F.broadcast(whole))
    )
    p = interpolated(*(F.col(c) for c in ("n1", "total", "vocabulary", "n2", "out1", "n3", "out2")))
    return found.groupBy(doc_id).agg(F.sum("c").alias("n_tokens"), F.sum(F.col("c") * F.log(p)).alias("log_p"))
