"""Greedy acceptance, windows that do not overlap, aligned prices and the portfolio against loops."""

import hashlib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from mnemo.operators import corpus, portfolio, selection

RNG = random.Random(6)


def loop(rows, targets=None):
    seen, counts, out = set(), {}, {}
    for i, g, a, b in sorted(rows):
        keys = {(n, v) for n, v in (("a", a), ("b", b)) if v is not None}
        if keys & seen:
            out[i] = "duplicate"
        elif targets is not None and counts.get(g, 0) >= targets.get(g, 0):
            out[i] = "full"
        else:
            out[i] = "accepted"
            seen |= keys
            counts[g] = counts.get(g, 0) + 1
    return out


@pytest.mark.parametrize(("targets", "span"), [(None, 90), ({"x": 12, "y": 0}, 60)])
def test_acceptance_matches_a_loop(spark, targets, span):
    rows = [(i, RNG.choice("xyz"), RNG.choice([None, *range(span)]), RNG.choice([None, *range(span)])) for i in range(150)]
    df = spark.createDataFrame(rows, "i long, g string, a long, b long").repartition(2)
    got = {r["i"]: r["outcome"] for r in selection.accept(df, ["a", "b"], ["i"], "g", targets).collect()}
    assert got == loop(rows, targets)


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    """Each row shares one key with the row before: every other one is accepted."""
    rows = [(i, "x", i // 2, (i + 1) // 2 + 10_000) for i in range(400)]
    cuts = []
    monkeypatch.setattr(selection, "cut", lambda df: cuts.append(1) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    got = corpus.dedup_greedy(spark.createDataFrame(rows, "i long, g string, a long, b long"), "a", "b", ["i"]).collect()
    assert sorted(r["i"] for r in got) == [i for i, o in loop(rows).items() if o == "accepted"]
    assert len(cuts) < 14


def test_acceptance_of_nothing(spark):
    assert selection.accept(spark.createDataFrame([], "i long, a long"), ["a"], ["i"]).collect() == []


def test_windows_match_a_loop(spark):
    rows = [(g, t, d, at, f"{g}{t}{at}") for g in ("pre", None) for t in ("a", "b") for at in range(0, 60) if RNG.random() < 0.7 for d in [RNG.choice([1, -1])]]
    df = spark.createDataFrame(rows, "cohort string, ticker string, direction int, at long, item string")
    for quota in (4,):
        want, used, left = {}, {}, {}
        for g, t, d, at, item in sorted(rows, key=lambda r: (int(hashlib.md5(f"s-{r[4]}".encode()).hexdigest()[:8], 16), r[4])):
            if left.get((g, t, d), quota) == 0:
                want[item] = "quota_full"
            elif any(abs(at - u) < 6 for u in used.get((g, t), [])):
                want[item] = "overlap"
            else:
                want[item] = "selected"
                used.setdefault((g, t), []).append(at)
                left[g, t, d] = left.get((g, t, d), quota) - 1
        got = {r["item"]: r["outcome"] for r in selection.disjoint_windows(df, ["cohort", "ticker"], ["direction"], "at", 6, "item", quota, "s").collect()}
        assert got == want


def test_aligned_prices(spark):
    rows = [(d, t, 10.0 + d, 1) for d in range(40) for t in "ab" if not (d == 7 and t == "b")] + [(3, "a", 99.0, 2), (9, "b", float("nan"), 2)]
    df = spark.createDataFrame(rows, "d int, t string, p double, k int")
    got = portfolio.aligned_prices(df, "d", "t", "p", "k").collect()
    assert sorted({r["day"] for r in got}) == [d for d in range(40) if d not in (7, 9)] and all(r["reason"] == "" for r in got)
    assert [r["price"] for r in got if r["day"] == 3 and r["ticker"] == "a"] == [99.0]
    (short,) = portfolio.aligned_prices(df, "d", "t", "p", "k", least_days=39).collect()
    assert (short["day"], short["price"], short["reason"]) == (None, None, "aligned days: 38")


def traded(days, fee, cash):
    held, fees, out = dict.fromkeys(days[0][1], 0.0), 0.0, []
    for day, prices, weights in days:
        worth = cash + sum(held[t] * p for t, p in prices.items())
        if worth <= 0:
            held, cash = dict.fromkeys(held, 0.0), 0.0
            out.append((day, 0.0, 0.0, fees))
            continue
        deal = {t: weights.get(t, 0.0) * worth - held[t] * p for t, p in prices.items()}
        sold, bought = sum(max(-d, 0) for d in deal.values()), sum(max(d, 0) for d in deal.values())
        room = cash + sold * (1 - fee)
        part = max(0.0, min(1.0, room / (bought * (1 + fee)))) if bought else 1.0
        for t, d in deal.items():
            held[t] += (d * part if d > 0 else d) / prices[t]
        cash, fees = room - bought * part * (1 + fee), fees + (sold + bought * part) * fee
        out.append((day, cash + sum(held[t] * p for t, p in prices.items()), cash, fees))
    return out


@pytest.mark.parametrize(("fee", "cash", "swing"), [(0.0, 100.0, 0.05), (0.01, 100.0, 0.05), (0.01, 5000.0, 0.05), (0.02, 100.0, 0.9)])
def test_portfolio_matches_a_loop(spark, fee, cash, swing):
    price, days = dict.fromkeys("abc", 10.0), []
    for d in range(60):
        price = {t: p * (1 + RNG.uniform(-swing, swing)) for t, p in price.items()}
        weights = {t: RNG.uniform(-0.4, 0.5) for t in "abc" if RNG.random() < 0.7}
        days.append((d, dict(price), weights))
    prices = spark.createDataFrame([(d, t, p) for d, ps, _ in days for t, p in ps.items()], "day int, ticker string, price double")
    weights = spark.createDataFrame([("v", d, t, w) for d, _, ws in days for t, w in ws.items()] + [("v", 999, "a", 1.0), ("v", 3, "zz", 1.0)], "variant string, day int, ticker string, weight double")
    got = sorted((r["day"], r["value"], r["cash"], r["fees"]) for r in portfolio.rebalanced(weights, prices, ["variant"], fee, cash).collect())
    for g, w in zip(got, traded(days, fee, cash), strict=True):
        assert g == pytest.approx(w, rel=1e-9, abs=1e-6)
    returns = portfolio.daily_returns(portfolio.rebalanced(weights, prices, ["variant"], fee, cash), ["variant"], cash).orderBy("day").collect()
    assert returns[0]["ret"] == pytest.approx(returns[0]["value"] / cash - 1)


def test_fees_take_from_the_value(spark):
    prices = spark.createDataFrame([(d, t, 10.0 + (d * 7 + k) % 5) for d in range(30) for k, t in enumerate("ab")], "day int, ticker string, price double")
    weights = prices.select(F.lit("v").alias("variant"), "day", "ticker", ((F.col("day") % 3) / 5).alias("weight"))
    ends = [portfolio.rebalanced(weights, prices, ["variant"], fee, 100.0).agg(F.max_by("value", "day"), F.max("fees")).first() for fee in (0.0, 0.01)]
    assert ends[0][0] > ends[1][0] and ends[0][1] == 0 < ends[1][1]


def test_targets_beyond_the_first_stretch(spark):
    """Targets that are met late, or never, are decided over several stretches of the order."""
    rows = [(i, "x" if i > 1500 and i % 50 == 0 else "y", i if i % 2 else i // 40, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, g string, a long, b long").repartition(2)
    targets = {"x": 20, "y": 3000}
    got = {r["i"]: r["outcome"] for r in selection.accept(df, ["a", "b"], ["i"], "g", targets).collect()}
    assert got == loop(rows, targets)


def test_assembled_months_say_what_they_lack(spark):
    from datetime import date

    from mnemo.operators import assembly

    obs = [("s", date(2020 + k // 12, k % 12 + 1, 10), float(k % 5), date(2020 + k // 12, k % 12 + 1, 12), None) for k in range(24)]
    obs += [("s", date(2021, 6, 20), 99.0, date(2022, 1, 1), None), ("flat", date(2021, 1, 5), 1.0, date(2021, 1, 5), None), ("flat", date(2021, 2, 5), 1.0, date(2021, 2, 5), None)]
    observations = spark.createDataFrame(obs, "series string, day date, value double, known_from date, known_to date")
    decisions = spark.createDataFrame([(date(2021, 6, 30),), (date(2021, 3, 31),), (date(2030, 1, 31),)], "decision date")
    known = {(r["series"], r["decision"]): r for r in assembly.as_known(observations, decisions, 12, 6, 2).collect()}
    r = known["s", date(2021, 6, 30)]
    window = [float(k % 5) for k in range(6, 18)]
    mean = sum(window) / 12
    spread = (sum((x - mean) ** 2 for x in window) / 11) ** 0.5
    assert (r["n"], r["current"], r["z"]) == (12, 2.0, pytest.approx((2.0 - mean) / spread)) and r["reason"] == ""
    assert known["flat", date(2021, 3, 31)]["reason"] == "flat does not vary" and ("s", date(2030, 1, 31)) not in known
    closes = spark.createDataFrame([("t", date(2021, 3, 29), 10.0), ("t", date(2021, 4, 28), 12.0), ("t", date(2021, 6, 10), 9.0)], "ticker string, day date, close double")
    returns = assembly.next_month_returns(closes, decisions, F.lit(date(2022, 1, 1)))
    got = {r["decision"]: r for r in returns.collect()}
    assert got[date(2021, 3, 31)]["ret"] == pytest.approx(0.2) and got[date(2021, 6, 30)]["reason"] == "t has no close at the end of the month"
    out = {r["decision"]: r for r in assembly.assembled(decisions, assembly.as_known(observations, decisions, 12, 6, 2), returns, ["s", "flat"]).collect()}
    assert out[date(2021, 3, 31)]["state"] == "excluded" and out[date(2030, 1, 31)]["reason"] == "s has no value"
    only = {r["decision"]: r for r in assembly.assembled(decisions, assembly.as_known(observations, decisions, 12, 6, 2), returns, ["s"]).collect()}
    assert (only[date(2021, 3, 31)]["state"], only[date(2021, 3, 31)]["item_id"], only[date(2021, 3, 31)]["returns"]) == ("complete", "macro-2021-03", {"t": pytest.approx(0.2)})
    assert only[date(2021, 6, 30)]["state"] == "no outcome"


def test_nearest_match_against_all_pairs(spark):
    """Ties from below and above, values far apart, copies, values that have no logarithm, and keys of one side alone."""
    rng = random.Random(11)
    values = lambda: [rng.choice([rng.random() * 10, rng.randint(1, 9) * 1.0, 2.0 ** rng.randint(-3, 30), 100.0 * (1 + rng.randint(0, 3) * 1e-13), -1.0, 0.0, None]) for _ in range(150)]
    left = [(rng.choice("ab"), i, v) for i, v in enumerate(values())] + [("c", 900, 2.0)]
    right = [(rng.choice("ab"), 1000 - i, v) for i, v in enumerate(values())] + [("d", 5, 2.0)]
    out = corpus.nearest_match(spark.createDataFrame(left, "g string, i int, v double"), spark.createDataFrame(right, "g string, j int, w double"), ["g"], "i", "v", "j", "w", 0.5)
    log = lambda v: math.log(v) if v is not None and v > 0 else None
    for r in out.collect():
        x = log(next(v for g, i, v in left if i == r.i))
        near = [] if x is None else sorted((round(abs(x - log(w)), 12), j) for g, j, w in right if g == r.g and log(w) is not None and abs(x - log(w)) <= 0.5)
        assert (r.distance, r.match_id) == (pytest.approx(near[0][0], abs=2e-12), near[0][1]) if near else (None, None)
    assert out.count() == len(left)


def test_nearest_match_meets_few_values(spark):
    """20,000 against 20,000 values of one band and key: all pairs would be 400 million."""
    rows = spark.range(20000)
    a, b = rows.select(F.lit(1).alias("g"), "id", (F.col("id") * 2 + 100001).alias("v")), rows.select(F.lit(1).alias("g"), F.col("id").alias("j"), (F.col("id") * 2 + 100000).alias("w"))
    begin = time.monotonic()
    got = corpus.nearest_match(a, b, ["g"], "id", "v", "j", "w", 0.5).filter("match_id = id + 1 OR (id = 19999 AND match_id = id)").count()
    assert got == 20000 and time.monotonic() - begin < 30


@pytest.mark.parametrize("most", [1 << 16, 1024])
def test_few_targets_take_few_checkpoints(spark, monkeypatch, most):
    """Over one stretch and over several of them (most rows share a key with a row of an earlier one) the rows are those of a loop."""
    rng = random.Random(most)
    rows = [(i, rng.choice(["x", "y", "z", None]), rng.choice([None, *range(40)]) if i < 2500 else rng.randrange(400), rng.choice([None, i, i % 7])) for i in range(4000)]
    targets, cuts = {"x": 30, "y": 12, "w": 3, "z": 0}, []
    monkeypatch.setattr(selection, "LOOP", most)
    monkeypatch.setattr(selection, "cut", lambda df: cuts.append(1) or df.localCheckpoint())
    df = spark.createDataFrame(rows, "i long, g string, a long, b long").repartition(2)
    got = {r["i"]: r["outcome"] for r in selection.accept(df, ["a", "b"], ["i"], "g", targets).collect()}
    assert got == loop(rows, targets)
    assert len(cuts) <= 2 + len(rows) // 1024
