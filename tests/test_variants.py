"""Variants of decisions, their summary, manifests and accounts of keys, against loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemo.operators import manifest, variants

RNG = random.Random(31)
DRAWS = "item long, k int, v double, top double, full double, status string"


def ensembles():
    rows, came = [], []
    for item in range(60):
        for k in range(RNG.choice([1, 4, 9])):
            v = None if RNG.random() < 0.2 else float(RNG.randrange(-3, 4))
            rows.append((item, k, v, RNG.random(), RNG.choice([None, 1.0, 1.3, -0.2, 0.4]), "clash"))
        if item % 4:
            came.append((item, None if item % 7 == 0 else RNG.choice([-0.5, 0.0, 1e-12, 0.7])))
    # two clusters far apart
    rows += [(60, k, float(20 * (k % 2)), 0.5, 0.5, "clash") for k in range(12)]
    return rows, [*came, (60, 1.0)]


def wanted(rows, came, least):
    up = lambda x: round(x, 9) > 0
    for item in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == item and r[2] is not None]
        for mode in ("single", "ensemble"):
            used = [r for r in mine if mode == "ensemble" or r[1] == 0]
            failed = len(used) < (least if mode == "ensemble" else 1)
            values = sorted(r[2] for r in used)
            raw = None if failed or (mode == "ensemble" and item == 60) else values[(len(values) - 1) // 2]
            for adjustment, at in (("none", None), ("top_k", 3), ("full", 4)):
                carried = [r[at] for r in used if at and r[at] is not None]
                p = sum(carried) / len(carried) if carried and not failed else None
                scale = 1 - min(max(p or 0.0, 0.0), 1.0)
                y = dict(came).get(item)
                adjusted = None if raw is None else raw * scale
                scored = not failed and y is not None and raw is not None
                from_raw = scored and round(adjusted, 9) == 0 and raw != 0
                prob = None if failed or y is None else min(max(sum(map(up, values)) / len(values), 0.01), 0.99)
                status = "failed" if failed else "unresolved" if raw is None else "unadjusted" if p is None else "ok"
                reason = "no decision" if failed else "no outcome" if y is None else "unresolved" if raw is None else ""
                yield (item, mode, adjustment), (status, raw, p, adjusted, (up(raw if from_raw else adjusted) == up(y)) if scored else None, from_raw if scored else None, prob, None if prob is None else 0.5 + scale * (prob - 0.5), y, reason)


def test_item_variants(spark):
    rows, came = ensembles()
    draws, outcomes = spark.createDataFrame(rows, DRAWS), spark.createDataFrame(came, "item long, y double")
    out = variants.item_variants(draws, outcomes, "item", "k", "v", {"top_k": "top", "full": "full"}, "y", 3, "1")
    got = {(r["item"], r["mode"], r["adjustment"]): r for r in out.collect()}
    want = dict(wanted(rows, came, 3))
    assert got.keys() == want.keys() and len(got) == 61 * 6
    names = ("status", "raw", "p_recall", "adjusted", "correct", "from_raw", "probability", "adjusted_probability", "realized", "reason")
    for key, values in want.items():
        for name, value in zip(names, values, strict=True):
            assert got[key][name] == (pytest.approx(value, abs=1e-12) if isinstance(value, float) else value), (key, name)
    assert {r["status"] for r in got.values()} == {"failed", "unresolved", "unadjusted", "ok"} and any(r["from_raw"] for r in got.values())
    for r in variants.variant_summary(out).collect():
        mine = [v for (_, mode, a), v in want.items() if (mode, a) == (r["mode"], r["adjustment"])]
        right, forecasts = [v[4] for v in mine if v[4] is not None], [(v[7], round(v[8], 9) > 0) for v in mine if v[7] is not None]
        assert (r["planned"], r["scored"], r["forecasts"]) == (61, len(right), len(forecasts))
        assert r["accuracy"] == pytest.approx(sum(right) / len(right))
        assert r["adjusted_log_loss"] == pytest.approx(sum(-math.log(p if y else 1 - p) for p, y in forecasts) / len(forecasts))
        assert r["adjusted_brier"] == pytest.approx(sum((p - y) ** 2 for p, y in forecasts) / len(forecasts))
    empty = variants.item_variants(draws.limit(0), outcomes, "item", "k", "v", {"top_k": "top"}, "y", 3, "1")
    assert empty.count() == 0 and variants.variant_summary(empty).count() == 0


def test_corpus_manifest(spark):
    rows = [("a", "q1", 3, "x"), ("a", "q2", 1, None), ("a", None, 2, "x"), ("b", "q1", 9, "y"), (None, "q1", 4, "z"), ("other", "q1", 4, "z")]
    schema, targets = "file string, part string, at int, text string", {"a": 3, "b": 2, "none": 0}
    made = lambda x: {r["file"]: r for r in manifest.corpus_manifest(spark.createDataFrame(x, schema).repartition(3), "file", "part", "at", ["at", "text"], targets).collect()}
    got = made(rows)
    assert {f: (r["rows"], r["complete"], r["parts"], r["first"], r["last"]) for f, r in got.items()} == {"a": (3, True, {"": 1, "q1": 1, "q2": 1}, 1, 3), "b": (1, False, {"q1": 1}, 9, 9), "none": (0, True, None, None, None)}
    # the order of rows does not count; a row more, or another text, does
    assert made(rows[::-1])["a"]["identity"] == got["a"]["identity"]
    for other in ([*rows, rows[0]], [("a", "q1", 3, "w"), *rows[1:]], [("a", "q1", 3, "x"), ("a", "q2", 1, "x"), *rows[2:]]):
        assert made(other)["a"]["identity"] != got["a"]["identity"] and made(other)["b"]["identity"] == got["b"]["identity"]
    assert all(r["rows"] == 0 for r in made([]).values()) and len(made([])) == 3


def test_planned_keys_and_their_account(spark):
    rows = [(1, "c"), (2, "c"), (3, "h"), (4, "unused"), (None, "c"), (2, "c"), (5, None)]
    stages = {"pilot": ("c", ("one", "two")), "control": ("h", ("out",)), "again": ("c", ("one",))}
    planned = manifest.planned_keys(spark.createDataFrame(rows, "id long, role string"), "id", F.col("role"), stages)
    want = [(s, i, name) for i, role in rows for s, (wanted_role, names) in stages.items() if role == wanted_role for name in names]
    assert Counter(map(tuple, planned.collect())) == Counter(want)
    done = [("pilot", 1, "one"), ("pilot", 1, "two"), ("pilot", 1, "two"), ("pilot", None, "one"), ("pilot", 8, "one")]
    account = manifest.key_account(planned, spark.createDataFrame(done, "stage string, id long, rendering string"), ["stage", "id", "rendering"])
    p, d = Counter(want), Counter(done)
    state = lambda k: "repeated" if max(p[k], d[k]) > 1 else "unplanned" if not p[k] else "missing" if not d[k] else "recorded"
    assert {tuple(r)[:3]: tuple(r)[3:] for r in account.collect()} == {k: (p[k], d[k], state(k)) for k in p | d}
    assert manifest.key_account(planned.limit(0), planned.limit(0), ["id"]).count() == 0
