"""Scoped summaries and effects, the ledger of two modes, and rules and templates, against loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from mnemo.operators import experiment

RNG = random.Random(9)


def grid():
    rows = []
    for item in range(40):
        for arm in ("a", "b", "c"):
            state = RNG.choice(["usable", "usable", "unusable", "incomplete"]) if arm != "c" else "incomplete"
            n = RNG.randrange(1, 5) if state == "usable" else 0
            rows.append((item, "pre" if item % 3 else None, arm, state, n, RNG.randrange(0, n + 1), RNG.random() if state == "usable" and RNG.random() < 0.8 else None))
    return rows


SCHEMA = "item long, cohort string, arm string, state string, n_usable int, n_correct int, confidence double"


def test_scoped_summary(spark):
    rows = grid()
    got = {(r["scope"], r["cohort"], r["arm"]): r for r in experiment.scoped_summary(spark.createDataFrame(rows, SCHEMA), "cohort", "arm").collect()}
    assert len(got) == 6 + 3 + 2 + 1
    for (scope, cohort, arm), r in got.items():
        mine = [x for x in rows if (scope not in ("cohort and arm", "cohort") or x[1] == cohort) and (scope not in ("cohort and arm", "arm") or x[2] == arm)]
        usable = [x for x in mine if x[3] == "usable"]
        right = sum(x[5] * 2 > x[4] for x in usable)
        said = sorted(x[6] for x in usable if x[6] is not None)
        terminal = sum(x[3] != "incomplete" for x in mine)
        assert (r["planned"], r["terminal"], r["usable"], r["right"]) == (len(mine), terminal, len(usable), right)
        assert r["accuracy_attempted"] == (pytest.approx(right / terminal) if terminal else None)
        assert r["median_confidence"] == (said[(len(said) - 1) // 2] if said else None)
        assert r["confidence"] == (pytest.approx(statistics.mean(said)) if said else None)


def test_scoped_effects(spark):
    rows = grid()
    out = experiment.scoped_effects(spark.createDataFrame(rows, SCHEMA), "item", "cohort", "arm", {"x": ("a", "b"), "y": ("a", "c")}, 50).collect()
    got = {(r["contrast"], r["kind"], r["scope"], r["cohort"]): r for r in out}
    assert len(got) == len(out) == 2 * 3 * 3
    by = {(x[0], x[2]): x for x in rows}
    ok = lambda x: float(x[3] == "usable" and x[5] * 2 > x[4])
    fits = {"attempted": lambda p, q: p[3] != "incomplete" != q[3], "valid": lambda p, q: p[3] == q[3] == "usable", "confidence": lambda p, q: p[6] is not None and q[6] is not None}
    for (name, kind, scope, cohort), r in got.items():
        pairs = [(by[i, "a"], by[i, "b" if name == "x" else "c"]) for i in range(40) if scope == "all" or by[i, "a"][1] == cohort]
        kept = [(p, q) for p, q in pairs if fits[kind](p, q)]
        value = (lambda x: x[6]) if kind == "confidence" else ok
        assert (r["planned"], r["n"]) == (len(pairs), len(kept))
        if kept:
            assert r["estimate"] == pytest.approx(statistics.mean(value(q) - value(p) for p, q in kept)) and r["baseline"] == pytest.approx(statistics.mean(value(p) for p, _ in kept))
        if len(kept) > 1:
            assert r["low"] <= r["estimate"] <= r["high"] and r["status"] in ("estimated", "degenerate")
        else:
            assert r["low"] is None and r["status"] == ("inadequate" if kept else "unavailable")


def test_ledger_of_two_modes(spark):
    a = spark.createDataFrame([("g", 1, 1, 0.5), ("g", 1, 2, None), ("g", 2, 3, 0.2), ("g", 2, 4, 0.1), ("g", 2, 4, 0.3), (None, 3, 5, 0.9)], "lang string, block long, k long, x double")
    b = spark.createDataFrame([("g", 1, 1, 0.1), ("g", 1, 2, 0.3), ("g", 2, 4, 0.3), ("g", 9, 6, 0.3), (None, 3, 5, 0.4)], "lang string, block long, k long, x double")
    ledger = experiment.aligned_modes(a, b, ["lang", "block", "k"], "x")
    assert {(r["k"], r["reason"]) for r in ledger.collect()} == {(1, ""), (2, "no value in a"), (3, "only in a"), (4, "repeated in a"), (5, ""), (6, "only in b")}
    out = {r["lang"]: r for r in experiment.mode_comparison(ledger, ["lang"], "block", 30, 0.1, F.lit(True)).collect()}
    assert out["g"]["left_out"] == {"no value in a": 1, "only in a": 1, "only in b": 1, "repeated in a": 1} and out[None]["left_out"] is None
    assert (out["g"]["n"], out["g"]["difference"], out["g"]["decision"]) == (1, pytest.approx(0.4), "improve")


def test_issues_of_rows_and_of_the_corpus(spark):
    rows = spark.createDataFrame([(1, "a text", 0), (2, "a text", 1), (3, None, 0), (3, "", 2), (4, "fine", 1), (5, "fine", 1)], "id long, text string, split int")
    rules = {"empty": F.coalesce("text", F.lit("")) == "", "short": F.length("text") < 5}
    got = sorted(tuple(r) for r in experiment.issue_rows(rows, "id", rules, "text", "split").collect())
    assert got == sorted([(3, "empty"), (3, "empty"), (3, "short"), (4, "short"), (5, "short"), (3, "duplicate_id"), (1, "split_text_overlap"), (2, "split_text_overlap"), (3, "split_text_overlap"), (3, "split_text_overlap")])
    assert experiment.issue_rows(rows.limit(0), "id", rules, "text", "split").collect() == []


def test_templates_fit_whole_and_take_typed_slots(spark):
    templates = [("needs {least}: has {count}", "{count} of {least}"), ("(a+b) {x:number}?", "sum {x}"), ("no {what:any}", "none")]
    texts = [" needs  8: has 3. ", "needs 8: has three", "(a+b) -1.5?", "no way", "not this", "", None, "needs 8: has 3 more"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r[0] for r in df.orderBy("k").select(experiment.reworded(F.col("t"), templates)).collect()]
    assert got == ["3 of 8", None, "sum -1.5", "none", None, "", "", None]
    with pytest.raises(ValueError):
        experiment.template_pattern("{a} {a}")
