"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of a text are Spark column expressions. Small regression trees are boosted on a sample of labelled documents;
every path from a tree's root to a node is a conjunctive rule. A lasso logistic regression over the rules keeps a few of
them; these become a Spark column expression, so that scoring is one projection.

The sample is bounded: at most MAX_SAMPLE labelled documents, those with the smallest hashes of their doc_id. Only
labels whose crc32(doc_id as text) mod 4 is not 2 are used. Neither labels nor lang, source or doc_id enter a score.

Defined cases: a null text is empty; an empty text has all statistics 0 and a score like any other text. Labels without
a document, null labels and null ids are left out; of labels that contradict each other each counts. Without labels of
both kinds every score is the share of good labels (0.5 without any label).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SAMPLE = 20_000
THRESHOLD = 0.7
HELD_OUT = 2
TREES, DEPTH, MIN_LEAF, CUTS = 24, 3, 20, 48
PENALTY, STEPS = 0.0006, 800


NAMES = ("log_size", "word_size", "distinct_words", "distinct_lines", "line_words", "symbols", "pipes", "upper", "digits", "exclaims", "stops")


def statistics(text: Column) -> Column:
    """An array of one struct, the statistics of a text.

    Words and lines, and then the statistics, are bound to lambda variables. As plain columns the optimizer would put
    each expression wherever it is named (also into a filter), and evaluate it as often.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.array(F.struct(t.alias("text"), F.split(F.trim(t), r"\s+").alias("words"), F.split(t, "\n").alias("lines")))
    return F.transform(parts, _statistics)


def _statistics(parts: Column) -> Column:
    t, words, lines = parts["text"], parts["words"], parts["lines"]
    size = F.length(t)
    count = lambda kept: F.length(F.regexp_replace(t, f"[^{kept}]+", ""))
    share = lambda part, whole: F.when(size > 0, part / F.greatest(whole, F.lit(1))).otherwise(0.0)
    values = (
        F.log1p(size.cast("double")),
        share(size, F.size(words)),
        share(F.size(F.array_distinct(words)), F.size(words)),
        share(F.size(F.array_distinct(lines)), F.size(lines)),
        share(F.size(words), F.size(lines)),
        share(count(r"#$%&*<>=+~^{}\[\]\\|@_"), size),
        share(size - F.length(F.replace(t, F.lit("|"), F.lit(""))), F.size(words)),
        share(count("A-Z"), size),
        share(count("0-9"), size),
        share(count("!?"), F.size(words)),
        share(count(".,;"), F.size(words)),
    )
    return F.struct(*(v.cast("double").alias(n) for n, v in zip(NAMES, values, strict=True)))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is it above?, threshold) and its weight."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, text: Column) -> Column:
        """The probability of a good label as a column expression over a text."""
        return F.get(F.transform(statistics(text), self._score), F.lit(0))

    def _score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule in self.rules:
            holds = F.lit(True)
            for name, above, threshold in rule.tests:
                holds = holds & ((stats[name] > threshold) if above else (stats[name] <= threshold))
            total = total + F.when(holds, rule.weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, tests: tuple, depth: int, found: list, fitted: np.ndarray) -> None:
    """Grow a regression tree on the rows; note the path to every node below the root, and the leaves' means."""
    if tests:
        found.append(tests)
    fitted[rows] = residual[rows].mean() if len(rows) else 0.0
    if depth == 0 or len(rows) < 2 * MIN_LEAF:
        return
    best, r = (1e-9, 0, 0.0), residual[rows]
    for j in range(x.shape[1]):
        order = np.argsort(x[rows, j], kind="stable")
        v, sums = x[rows, j][order], np.cumsum(r[order])
        at = np.unique(np.linspace(MIN_LEAF, len(rows) - MIN_LEAF, CUTS).astype(int))
        at = at[v[at - 1] < v[np.minimum(at, len(v) - 1)]]
        if not len(at):
            continue
        left, n = sums[at - 1], len(rows)
        gain = left**2 / at + (sums[-1] - left) ** 2 / (n - at) - sums[-1] ** 2 / n
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float((v[at[k] - 1] + v[at[k]]) / 2))
    gain, j, threshold = best
    if gain <= 1e-9:
        return
    above = x[rows, j] > threshold
    for side in (False, True):
        _paths(x, residual, rows[above == side], (*tests, (j, side, threshold)), depth - 1, found, fitted)


def _holds(x: np.ndarray, tests: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, threshold in tests:
        out &= (x[:, j] > threshold) == above
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """Trees by boosting, their paths as rules, and lasso logistic weights by accelerated proximal gradient."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 2 * MIN_LEAF:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return RuleModel(float(np.log(share / (1 - share))), ())
    logit = np.full(len(y), np.log(share / (1 - share)))
    found: list[tuple] = []
    spread = np.random.default_rng(0)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        rows = np.sort(spread.permutation(len(y))[: max(2 * MIN_LEAF, len(y) * 2 // 3)])
        paths: list[tuple] = []
        fitted = np.zeros(len(y))
        _paths(x, y - p, rows, (), DEPTH, paths, fitted)
        leaf = np.zeros(len(y))
        for tests in paths:  # a deeper path comes after the one that it extends
            inside = _holds(x, tests)
            leaf[inside] = (y - p)[inside].sum() / max((p * (1 - p))[inside].sum(), 1.0)
        logit = np.clip(logit + 0.3 * leaf, -8, 8)
        found += paths
    found = sorted(set(found))
    rules = np.stack([_holds(x, t) for t in found], 1)
    middle, scale = rules.mean(0), np.maximum(rules.std(0), 1e-3)
    # rows that the same rules hold for count as one with their number
    packed = np.packbits(rules, axis=1)
    _, at, which, count = np.unique(packed, axis=0, return_index=True, return_inverse=True, return_counts=True)
    z, good, n = (rules[at] - middle) / scale, np.bincount(which.reshape(-1), y, len(at)), len(y)
    w, b, w_old, step = np.zeros(z.shape[1]), float(np.log(share / (1 - share))), np.zeros(z.shape[1]), 4.0 / max(np.linalg.eigvalsh((z.T * count) @ z / n)[-1], 1.0)
    for k in range(STEPS):
        v = w + (k / (k + 3)) * (w - w_old)
        error = count / (1 + np.exp(-(b + z @ v))) - good
        w_old, b = w, b - error.sum() / n * 2.0
        w = v - step * (z.T @ error) / n
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0.0)
    weights = w / scale
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel(float(b - (weights * middle).sum()), tuple(Rule(tuple((names[j], side, t) for j, side, t in found[i]), float(weights[i])) for i in kept))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> RuleModel:
    """Fit the model on a bounded sample of labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0.0, 1.0) & ~held_out(F.col("doc_id")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(F.broadcast(sample), "doc_id")  # max_sample rows
    got = rows.select("doc_id", "quality", F.get(statistics(F.col("text")), F.lit(0)).alias("s")).select("doc_id", "quality", "s.*").toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    return fit_rules(got[list(NAMES)].to_numpy(float), got["quality"].to_numpy(float), list(NAMES))


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs with the columns score and predicted beside its own."""
    out = docs.withColumn("score", model.score(F.col("text")))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns."""
    return docs.filter(model.score(F.col("text")) >= THRESHOLD)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_quality(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
