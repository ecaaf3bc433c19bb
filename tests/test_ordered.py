"""Operators over ordered data against loops: the split search, ranks and running sums, drawn counts."""

import bisect
import hashlib
import math
import random
import statistics
import time
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import pytest
from pyspark.sql import functions as F

from mnemo.operators import consensus, inference, metrics, ordered, rank, resample, study

RNG = random.Random(3)


def brute_split(values, min_mass=0.25, min_gap=3, contrast=10.0, min_draws=8, min_density=1.5):
    counts = {v: values.count(v) for v in sorted(set(values))}
    at, total, best = list(counts), len(values), None
    if total < min_draws:
        return None
    for i in range(len(at)):
        for j in range(i + 1, len(at)):
            lower, upper = sum(counts[p] for p in at[: i + 1]), sum(counts[p] for p in at[j:])
            trough = max((counts[p] for p in at[i + 1 : j]), default=0)
            peak = max(max(counts[p] for p in at[: i + 1]), max(counts[p] for p in at[j:]))
            held = len(at[: i + 1]) + len(at[j:])
            if min(lower, upper) < min_mass * total or at[j] - at[i] - 1 < min_gap or lower + upper < min_density * held or peak < contrast * trough:
                continue
            key = (total - lower - upper, -(peak - contrast * trough), i, j)
            if best is None or key < best[0]:
                best = (key, at[i], at[j], lower, upper)
    return best


@pytest.mark.parametrize("contrast", [10.0, 1.5])
def test_split_search_matches_pairs(spark, contrast):
    items = {}
    for k in range(150):
        centres = [(0, 2), (RNG.randrange(3, 25), 2)] if k % 3 else [(0, 8)]
        items[k] = [RNG.randrange(-w, w + 1) + c for c, w in centres for _ in range(RNG.randrange(1, 30))] + [RNG.randrange(0, 20) for _ in range(RNG.randrange(0, 4))]
    rows = spark.createDataFrame([(k, float(v)) for k, vs in items.items() for v in vs], "item long, v double")
    got = {r["item"]: r for r in consensus.split_search(rows, ["item"], "v", "1", contrast=contrast).collect()}
    found = 0
    for k, values in items.items():
        want, r = brute_split(values, contrast=contrast), got[k]
        assert r["n"] == len(values)
        if len(values) < 8:
            assert r["separated"] is None
        elif want is None:
            assert r["separated"] is False
        else:
            found += 1
            assert (r["separated"], r["gap_low"], r["gap_high"]) == (True, want[1], want[2])
            assert (r["lower_mass"], r["upper_mass"], r["trough_mass"]) == pytest.approx((want[3] / len(values), want[4] / len(values), want[0][0] / len(values)))
    assert 20 < found < 140


def test_split_search_of_many_positions(spark):
    rows = spark.range(5000).select(F.lit(1).alias("item"), F.when(F.col("id") < 2500, F.col("id")).otherwise(F.col("id") + 900).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), (F.col("id") % 3 + 1).cast("int"))))
    began = time.monotonic()
    (r,) = consensus.split_search(rows, ["item"], "v", "1").collect()
    assert (r["separated"], r["gap_low"], r["gap_high"]) == (True, 2499.0, 3400.0) and time.monotonic() - began < 30


def test_split_search_of_nothing(spark):
    assert consensus.split_search(spark.createDataFrame([], "item long, v double"), ["item"], "v", "1").collect() == []


# ---- running sums and places


def grouped(n=600):
    """Rows of which one group holds two thirds, one is null and one has one row."""
    return [(k, RNG.choice(["hot"] * 8 + [None, "b", "c"]), RNG.randrange(0, 40), RNG.random()) for k in range(n)] + [(n, "alone", 1, 0.5)]


def test_sums_before_and_places(spark):
    rows = grouped()
    df = spark.createDataFrame(rows, "id long, g string, v int, w double").repartition(7)
    got = ordered.sums_before(df, ["g"], ["v", "id"], {"before": "w", "place": F.lit(1).cast("long")}, {"n": "place"}).collect()
    assert len(got) == len(rows)
    for r in got:
        earlier = [x for x in rows if x[1] == r["g"] and (x[2], x[0]) < (r["v"], r["id"])]
        assert (r["place"], r["n"]) == (len(earlier), sum(x[1] == r["g"] for x in rows))
        assert r["before"] == pytest.approx(sum(x[3] for x in earlier))
    whole = ordered.places(df, [], ["v", "id"]).collect()
    assert sorted((r["place"], r["v"], r["id"]) for r in whole) == [(k, v, i) for k, (v, i) in enumerate(sorted((x[2], x[0]) for x in rows))]
    assert ordered.places(df.limit(0), ["g"], ["v"], size="n").collect() == []


def test_average_ranks_and_auc_of_groups(spark):
    rows = grouped()
    df = spark.createDataFrame(rows, "id long, g string, v int, w double").withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    for r in ordered.average_ranks(df, "v", "rank", ["g"], "n").collect():
        same = [x[2] for x in rows if x[1] == r["g"]]
        assert r["rank"] == sum(x < r["v"] for x in same) + (same.count(r["v"]) + 1) / 2 and r["n"] == len(same)
    for r in metrics.rank_auc(df, "v", "label", ["g"]).collect():
        ups, downs = ([x[2] for x in rows if x[1] == r["g"] and (x[0] % 3 == 0) == side] for side in (True, False))
        wins = sum((u > d) + (u == d) / 2 for u in ups for d in downs)
        assert (r["n_positive"], r["n_negative"]) == (len(ups), len(downs))
        assert r["auc"] is None if not ups or not downs else r["auc"] == pytest.approx(wins / len(ups) / len(downs))


def test_rank_filter_of_groups(spark):
    rows = grouped()
    df = spark.createDataFrame(rows, "id long, g string, v int, w double").withColumn("v", F.col("v").cast("double"))
    got = {(r["g"], r["id"]): r["threshold"] for r in rank.rank_filter(df, "v", "id", 0.8, ["g"]).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        mine = sorted((r[2], r[0]) for r in rows if r[1] == g)
        at = 0.8 * (len(mine) - 1)
        low, high = mine[math.floor(at)][0], mine[math.ceil(at)][0]
        for _, i in mine[: len(mine) - math.floor(round(0.2 * len(mine), 9))]:
            want[g, i] = low + (high - low) * (at - math.floor(at))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_following_sums(spark):
    rows = [(g, k, float(RNG.randrange(100))) for g, n in (("a", 50), (None, 9), ("c", 2)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, x double")
    for r in ordered.following_sums(df, ["g"], "k", "x", 4, "s", stretch=5).collect():
        assert r["s"] == sum(x for g, k, x in rows if g == r["g"] and r["k"] <= k < r["k"] + 4)


# ---- drawn counts


def uniform(*parts):
    return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def poisson(u, rate=1.0):
    total, term, k = 0.0, math.exp(-rate), 0
    for i in range(12):
        total += term
        term *= rate / (i + 1)
        k += u >= total * 2**32
    return k


def test_poisson_counts_have_their_distribution(spark):
    df = spark.range(20_000).select(resample.hash_uniform(F.lit("x"), F.col("id")).alias("u"), (F.col("id") % 2 / 2 + 0.5).alias("rate"))
    got = df.select("u", "rate", resample.poisson_count(F.col("u")).alias("one"), resample.poisson_count(F.col("u"), F.col("rate")).alias("own")).collect()
    assert all(r["one"] == poisson(r["u"]) and r["own"] == poisson(r["u"], r["rate"]) for r in got)
    assert statistics.mean(r["one"] for r in got) == pytest.approx(1, abs=0.03) and statistics.pvariance([r["one"] for r in got]) == pytest.approx(1, abs=0.05)
    assert statistics.mean(r["own"] for r in got if r["rate"] == 0.5) == pytest.approx(0.5, abs=0.03)


def test_bootstrap_by_name_matches_a_loop(spark):
    rows = [("a", k, RNG.gauss(1, 3)) for k in range(60)] + [("b", 0, 4.0), ("c", 0, None), ("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, k long, x double")
    resample.register("largest_less_mean", resample.Statistic({"x": lambda v: v, "x3": lambda v: v * v * v}, lambda s: F.try_divide(s["x3"] - s["x"], s["w"])))
    got = {r["g"]: r for r in resample.bootstrap(df, ["g"], "k", "x", 80, "largest_less_mean").collect()}
    mine = [(k, x) for g, k, x in rows if g == "a"]
    again = []
    for rep in range(80):
        w = [poisson(uniform("a", rep, k)) for k, _ in mine]
        again.append(sum(c * (x**3 - x) for c, (_, x) in zip(w, mine, strict=True)) / sum(w))
    again.sort()
    at = lambda q: again[int(q * 79)] + (again[min(79, int(q * 79) + 1)] - again[int(q * 79)]) * (q * 79 - int(q * 79))
    point = sum(x**3 - x for _, x in mine) / 60
    assert (got["a"]["n"], got["a"]["point"]) == (60, pytest.approx(point))
    assert (got["a"]["low"], got["a"]["high"]) == (pytest.approx(min(point, at(0.025))), pytest.approx(max(point, at(0.975))))
    assert [got["b"][c] for c in ("n", "point", "low", "high")] == [1, 60.0, 60.0, 60.0]
    assert [got["c"][c] for c in ("n", "point", "low", "high")] == [0, None, None, None]


def test_bootstrap_covers_the_mean(spark):
    """Intervals of the mean hold it about as often as they say."""
    rows = [(g, k, RNG.gauss(5, 2)) for g in range(200) for k in range(40)]
    got = resample.bootstrap(spark.createDataFrame(rows, "g long, k long, x double"), ["g"], "k", "x", 200, confidence=0.9).collect()
    assert 0.8 <= sum(r["low"] <= 5 <= r["high"] for r in got) / len(got) <= 0.97


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_dealt_units_are_the_first_of_the_order(spark, buckets):
    units = spark.createDataFrame([("a", k, float(k)) for k in range(50)] + [("b", k, 1.0) for k in range(3)], "g string, u long, s double")
    sizes = spark.createDataFrame([("a", 17), ("b", 3)], "g string, _m int")
    got = {(r["g"], r["_rep"]): r["s"] for r in resample.deal(units, sizes, ["g"], "u", lambda rep: resample.hash_uniform(rep, F.col("u")), 9, ["s"], buckets=buckets).collect()}
    want = {("a", rep): float(sum(sorted(range(50), key=lambda u: (uniform(rep, u), u))[:17])) for rep in range(9)} | {("b", rep): 3.0 for rep in range(9)}
    assert got == want


def test_block_means_of_a_series(spark):
    xs = [RNG.random() for _ in range(23)]
    df = spark.createDataFrame([("a", k, x, 0.0) for k, x in enumerate(xs)] + [("b", 0, 1.0, 0.0)], "g string, k long, a double, b double")
    got = {r["g"]: r for r in inference.paired_loss_difference(df, "k", "a", "b", 5, 60, by=["g"]).collect()}
    means = []
    for rep in range(60):
        w = [poisson(uniform("a", rep, p), math.ceil(23 / 5) / 19) for p in range(19)]
        if sum(w):
            means.append(sum(c * sum(xs[p : p + 5]) for p, c in enumerate(w)) / sum(w) / 5)
    means.sort()
    assert got["a"]["difference"] == pytest.approx(sum(xs) / 23) and got["a"]["n"] == 23
    assert means[0] <= got["a"]["low"] <= got["a"]["high"] <= means[-1] and got["a"]["standard_error"] == pytest.approx(statistics.stdev(means))
    assert bisect.bisect(means, got["a"]["low"]) <= 3
    assert (got["b"]["difference"], got["b"]["low"], got["b"]["high"]) == (1.0, 1.0, 1.0)


def test_rounded_means_are_summed_in_order_however_rows_are_dealt(spark):
    """Means that lie halfway but for the error of their sums: every dealing of the rows gives what a loop in order gives."""
    rng = random.Random(5)
    added = lambda values: reduce(lambda a, b: a + b, values, 0.0)  # noqa: E731  (sum() of floats is compensated)
    groups = []
    while len(groups) < 30:
        values = [round(rng.random() * 100, 2) for _ in range(13)]
        values[-1] = round(13 * 40.5 - sum(values[:-1]), 2)
        # only such whose sum has another side of the half in another order
        if len({added(rng.sample(values, 13)) / 13 < 40.5 for _ in range(40)}) > 1:
            groups.append(values)
    rows = [(g, k, v) for g, values in enumerate(groups) for k, v in enumerate(values)] + [(None, 0, 1.5), (None, 1, None), (77, 0, None)]
    loop = lambda values: float(Decimal(repr(added(values) / 13)).quantize(Decimal(1), ROUND_HALF_UP))
    want = {g: loop(values) for g, values in enumerate(groups)} | {None: 2.0, 77: None}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g int, k int, v double").repartition(4)
        assert {r.g: r.v for r in study.rounded_means(df, ["g"], "v", "k").collect()} == want


def test_halves_of_means_are_exact(spark, tmp_path):
    """A mean that is a half rounds up, where its sum in the order of events falls short; SQL meets the rows in another order."""
    import duckdb

    from mnemo.plans import study_queries

    rng = random.Random(6)
    added = lambda values: reduce(lambda a, b: a + b, values, 0.0)  # noqa: E731  (sum() of floats is compensated)
    events, found = [], 0
    while found < 8:
        values = [round(rng.random() * 100, 2) for _ in range(13)]
        values[-1] = round(13 * 40.5 - sum(values[:-1]), 2)
        orders = [rng.sample(values, 13) for _ in range(40)]
        short, whole = ([o for o in orders if (added(o) / 13 < 40.5) == low] for low in (True, False))
        if short and whole:
            # the rows lie as in whole, their numbers count as in short
            at = {v: k for k, v in enumerate(short[0])}
            events += [(100 * found + at[v], found, "view", v) for v in whole[0]] + [(100 * found + 50, found, "click", 41.0)]
            found += 1
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp_ntz'2024-01-01' AS ts").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.answer, r["rank"], r.n) for r in study_queries.mid_ranks(spark, str(tmp_path)).collect())
    assert got == [("click", 1.5, 8), ("view", 1.5, 8)]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(con.execute(f'SELECT answer, "rank", n FROM ({study_queries.MID_RANKS})').fetchall()) == got
    odd = [("a", 0.1), ("a", 0.9), ("b", -2.25), ("b", -2.75), ("c", 1e30), ("c", 1e30), ("d", None), (None, 1.5), (None, None), ("e", float("nan")), ("f", 0.49), ("f", 0.5)]
    means = study.rounded_means(spark.createDataFrame(odd, "g string, v double"), ["g"], "v").collect()
    assert repr(sorted(((r.g or "", r.v) for r in means), key=str)) == repr(sorted([("", 2.0), ("a", 1.0), ("b", -3.0), ("c", 1e30), ("d", None), ("e", float("nan")), ("f", 0.0)], key=str))
