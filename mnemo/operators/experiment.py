"""An experiment as a whole: summaries and contrasts of its conditions by scope, two modes of scoring side by side, and rules over a corpus."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import inference, ordered, resample


def scoped_summary(rows: DataFrame, cohort: str, arm: str) -> DataFrame:
    """scope, cohort, arm and the figures of rows of study.condition_rows with a cohort, over each cohort and arm, each arm, each cohort, and all.

    One pass with grouping sets. Every rate stands with its own denominator: an incomplete row is planned and no error, an
    unusable one is terminal and no right answer. The median confidence is the lower middle value of the usable rows; it is
    found by places in the order of each scope, which no task holds whole.
    """
    usable, terminal = F.col("state") == "usable", F.col("state") != "incomplete"
    right = usable & (F.col("n_correct") * 2 > F.col("n_usable"))
    named = rows.select(F.col(cohort).cast("string").alias("cohort"), F.col(arm).cast("string").alias("arm"), "confidence", usable.alias("_usable"), terminal.alias("_terminal"), right.alias("_right"))
    scope = F.element_at(F.array(*map(F.lit, ("cohort and arm", "cohort", "arm", "all"))), F.grouping_id().cast("int") + 1)
    sets = named.groupingSets([["cohort", "arm"], ["arm"], ["cohort"], []], "cohort", "arm").agg(
        scope.alias("scope"), F.count("*").alias("planned"), F.count_if("_terminal").alias("terminal"), F.count_if("_usable").alias("usable"), F.count_if("_right").alias("right"), F.avg(F.when(F.col("_usable"), F.col("confidence"))).alias("confidence")
    )
    kept = named.filter("_usable AND confidence IS NOT NULL")
    kinds = [("cohort and arm", "cohort", "arm"), ("cohort", "cohort", None), ("arm", None, "arm"), ("all", None, None)]
    each = F.array(*[F.struct(F.lit(s).alias("scope"), (F.col(c) if c else F.lit(None).cast("string")).alias("cohort"), (F.col(a) if a else F.lit(None).cast("string")).alias("arm")) for s, c, a in kinds])
    spread = kept.select(F.explode(each).alias("_k"), "confidence").select("_k.*", "confidence")
    keys = ["scope", "cohort", "arm"]
    middle = ordered.places(spread, keys, ["confidence"], "_place", "_n").filter(F.col("_place") == F.floor((F.col("_n") - 1) / 2)).select(*keys, F.col("confidence").alias("median_confidence"))
    rate = lambda n, d: F.try_divide(F.col(n).cast("double"), F.col(d).cast("double"))
    return ordered.match(sets, middle, keys, "left").select(*keys, "planned", "terminal", "usable", "right", rate("right", "terminal").alias("accuracy_attempted"), rate("right", "usable").alias("accuracy_usable"), rate("usable", "planned").alias("coverage"), "confidence", "median_confidence")


def scoped_effects(rows: DataFrame, item: str, cohort: str, arm: str, contrasts: Mapping[str, tuple[str, str]], n_reps: int, confidence: float = 0.95) -> DataFrame:
    """contrast, kind, scope (cohort or all), cohort, planned, n, baseline, comparison, estimate, low, high and status of paired differences between arms.

    `attempted` takes the items both of whose conditions are terminal, and counts right answers; `valid` those with two usable
    ones; `confidence` those with two confidences. A bootstrap draws items; both conditions of an item move together. Status:
    unavailable (no item), inadequate (one), degenerate (bounds that agree), or estimated.
    """
    usable = F.col("state") == "usable"
    right = (usable & (F.col("n_correct") * 2 > F.col("n_usable"))).cast("double")
    values = rows.select(F.col(item).alias("_item"), F.col(cohort).cast("string").alias("cohort"), F.col(arm).alias("_arm"), F.struct((F.col("state") != "incomplete").alias("terminal"), usable.alias("usable"), right.alias("right"), F.when(usable, F.col("confidence")).alias("confidence")).alias("_v"))
    arms = sorted({a for pair in contrasts.values() for a in pair})
    wide = values.groupBy("_item", "cohort").agg(*[F.max(F.when(F.col("_arm") == a, F.col("_v"))).alias(f"_{k}") for k, a in enumerate(arms)])

    def side(name: str, kind: str, pair: tuple[str, str]) -> Column:
        left, other = (F.col(f"_{arms.index(a)}") for a in pair)
        field = "confidence" if kind == "confidence" else "right"
        fits = {"attempted": left["terminal"] & other["terminal"], "valid": left["usable"] & other["usable"], "confidence": left["confidence"].isNotNull() & other["confidence"].isNotNull()}[kind]
        kept = lambda c: F.when(F.coalesce(fits, F.lit(False)), c)
        return F.struct(F.lit(name).alias("contrast"), F.lit(kind).alias("kind"), kept(left[field]).alias("a"), kept(other[field]).alias("b"))

    every = F.array(*[side(n, k, p) for n, p in contrasts.items() for k in ("attempted", "valid", "confidence")])
    scopes = F.array(F.struct(F.lit("cohort").alias("scope"), F.col("cohort")), F.struct(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("cohort")))
    pairs = wide.select("_item", F.explode(scopes).alias("_k"), every.alias("_e")).select("_item", "_k.*", F.explode("_e").alias("_s")).select("_item", "scope", "cohort", "_s.*")
    keys = ["contrast", "kind", "scope", "cohort"]
    told = pairs.withColumn("d", F.col("b") - F.col("a"))
    means = told.groupBy(*keys).agg(F.count("*").alias("planned"), F.avg(F.when(F.col("d").isNotNull(), F.col("a"))).alias("baseline"), F.avg(F.when(F.col("d").isNotNull(), F.col("b"))).alias("comparison"))
    found = resample.bootstrap(told, keys, "_item", "d", n_reps, confidence=confidence)
    out = ordered.match(means, found, keys)
    status = F.when(F.col("n") == 0, "unavailable").when(F.col("n") == 1, "inadequate").when(F.col("low") == F.col("high"), "degenerate").otherwise("estimated")
    bound = lambda c: F.when(F.col("n") > 1, F.col(c))
    return out.select(*keys, "planned", "n", "baseline", "comparison", F.col("point").alias("estimate"), bound("low").alias("low"), bound("high").alias("high"), status.alias("status"))


def aligned_modes(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, a, b and reason of every row of either mode: '' for a pair, else why it is left out; the ledger of a comparison.

    A key that stands more than once in a mode is 'repeated in a' (or b), since it names no one row.
    """
    one = lambda df, side: df.groupBy(*keys).agg(F.first(value).alias(side), F.count("*").alias(f"_n_{side}"))
    left, right = one(a, "a"), one(b, "b").withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])
    both = left.join(right, on, "full").select(*[F.coalesce(left[k], right[f"_r_{k}"]).alias(k) for k in keys], "a", "b", "_n_a", "_n_b")
    rules = [("repeated in a", F.col("_n_a") > 1), ("repeated in b", F.col("_n_b") > 1), ("only in b", F.col("_n_a").isNull()), ("only in a", F.col("_n_b").isNull()), ("no value in either", F.col("a").isNull() & F.col("b").isNull()), ("no value in a", F.col("a").isNull()), ("no value in b", F.col("b").isNull())]
    reason = F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in rules], F.lit(""))
    return both.select(*keys, "a", "b", reason.alias("reason"))


def mode_comparison(ledger: DataFrame, by: Sequence[str], block: str, n_reps: int, margin: float, checked: Column, confidence: float = 0.95) -> DataFrame:
    """by, n, blocks, mean_a, mean_b, difference, low, high, p, decision and left_out (reason -> rows) of a ledger with a block for each pair.

    Both modes are resampled together: pairs are summed by block first, and a replicate takes each block as often as a Poisson
    draw from the hash of (by, replicate, block) says. decision: see inference.decide.
    """
    by = list(by)
    pairs = ledger.filter("reason = ''")
    sums = pairs.groupBy(*by, block).agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"), F.count("*").alias("_c"))
    drawn = sums.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n_reps - 1)))).withColumn("_w", resample.poisson_count(resample.hash_uniform(*map(F.col, by), F.col("_rep"), F.col(block))))
    again = drawn.groupBy(*by, "_rep").agg(F.try_divide(F.sum(F.col("_w") * (F.col("_a") - F.col("_b"))), F.sum(F.col("_w") * F.col("_c")).cast("double")).alias("_d"))
    tail = (1 - confidence) / 2
    found = again.groupBy(*by).agg(F.percentile("_d", F.array(F.lit(tail), F.lit(1 - tail))).alias("_ends"), inference.two_sided(F.col("_d")).alias("p"))
    whole = sums.groupBy(*by).agg(F.sum("_c").alias("n"), F.count("*").alias("blocks"), F.try_divide(F.sum("_a"), F.sum("_c").cast("double")).alias("mean_a"), F.try_divide(F.sum("_b"), F.sum("_c").cast("double")).alias("mean_b"))
    causes = ledger.filter("reason <> ''").groupBy(*by, "reason").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "_n")))).alias("left_out"))
    out = ordered.match(ordered.match(whole, found, by), causes, by, "left")
    out = out.withColumns({"difference": F.col("mean_a") - F.col("mean_b"), "low": F.col("_ends")[0], "high": F.col("_ends")[1]})
    return out.select(*by, "n", "blocks", "mean_a", "mean_b", "difference", "low", "high", "p", inference.decide(F.col("low"), F.col("high"), checked, margin).alias("decision"), "left_out")


# ---- rules over a corpus


def with_issues(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rows with `issues`, the codes of all rules that a row breaks, in the rules' order, in one projection; an unknown rule holds."""
    return rows.withColumn("issues", F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), code) for code, broken in rules.items()])))


def issue_rows(rows: DataFrame, key: str, rules: Mapping[str, Column], text: str, split: str) -> DataFrame:
    """key and code of every rule that a row breaks, of keys that stand more than once (duplicate_id), and of texts that stand in more than one split (split_text_overlap).

    Equal keys and equal texts are found by counts with partial sums; only what is repeated is joined back.
    """
    own = with_issues(rows, rules).select(key, F.explode("issues").alias("code"))
    twice = rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key, F.lit("duplicate_id").alias("code"))
    hashed = rows.select(key, F.col(split).alias("_split"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("_h"))
    shared = hashed.groupBy("_h").agg(F.min("_split").alias("_lo"), F.max("_split").alias("_hi")).filter("_lo < _hi").select("_h")
    across = hashed.join(shared, "_h", "left_semi").select(key, F.lit("split_text_overlap").alias("code"))
    return own.unionByName(twice).unionByName(across)


#: What a template's slot takes; a name without a kind takes digits.
SLOTS = {"int": r"\d+", "name": r"[A-Za-z][A-Za-z0-9_]*", "number": r"-?\d+(?:\.\d+)?", "any": r".+"}


def template_pattern(template: str) -> tuple[str, list[str]]:
    """A template, text with slots like {count} or {model:name}, as an anchored pattern with its slots' names in order."""
    parts = re.split(r"\{(\w+(?::\w+)?)\}", template)
    names = [p.partition(":")[0] for p in parts[1::2]]
    if len(set(names)) < len(names):
        raise ValueError(f"a slot stands twice in {template!r}")
    quote = lambda t: re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", t)
    body = "".join(quote(p) if k % 2 == 0 else f"({SLOTS[p.partition(':')[2] or 'int']})" for k, p in enumerate(parts))
    return f"^{body}$", names


def reworded(text: Column, templates: Sequence[tuple[str, str]]) -> Column:
    """A stored reason in the wording of the first template that it fits whole; null where none does, empty for none.

    A wording may use the template's slots. White space is squeezed and a closing full stop goes.
    """
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), r"\.$", "")
    found = F.when(clean == "", F.lit(""))
    for template, wording in templates:
        pattern, names = template_pattern(template)
        said = re.split(r"\{(\w+)\}", wording)
        parts = [F.lit(p) if k % 2 == 0 else F.regexp_extract(clean, pattern, names.index(p) + 1) for k, p in enumerate(said)]
        found = found.when(clean.rlike(pattern), F.concat(*parts))
    return found
