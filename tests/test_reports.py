"""Reports against loops, closed forms and their edge cases."""

import bisect
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from mnemo.functions import parsing
from mnemo.operators import corpus, reports


def drawn(*parts):
    return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def blocks(n, length, rep, *by):
    """Places of n units drawn in moving blocks."""
    length = min(length, n)
    out = []
    for b in range(math.ceil(n / length)):
        start = drawn(*by, rep, b) % (n - length + 1)
        out += range(start, start + length)
    return out[:n]


def test_block_sums_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(g, u, rng.random()) for g, n in (("a", 7), ("b", 1), ("c", 4)) for u in range(n)]
    got = {(r.g, r.rep): r.v for r in reports.block_sums(spark.createDataFrame(rows, "g string, u int, v double"), "u", ["v"], 3, 5, ["g"]).collect()}
    for g in "abc":
        values = [v for h, _, v in rows if h == g]
        for rep in range(5):
            assert got[g, rep] == pytest.approx(sum(values[i] for i in blocks(len(values), 3, rep, g)))
    assert len(got) == 15


def test_half_ensemble_interval_keeps_unbounded_and_drops_undefined(spark):
    rows = [("same", i, 1.0, 1.0, 2.0, 2.0) for i in range(4)] + [("mixed", 0, 0.0, 2.0, 0.0, 4.0)] + [("mixed", i, 0.0, 1.0, 3.0, 3.0) for i in (1, 2, 3)] + [("lacking", 0, None, 1.0, 1.0, 1.0)]
    got = {r.g: r for r in reports.half_ensemble_interval(spark.createDataFrame(rows, "g string, i int, a double, b double, x double, y double"), ["g"], "i", "a", "b", "x", "y", 40).collect()}
    assert set(got) == {"same", "mixed"}
    assert got["same"].ratio is None and got["same"].dropped == 40 and got["same"].p is None and got["same"].low is None
    h, s = [4.0, 1.0, 1.0, 1.0], [16.0, 0.0, 0.0, 0.0]
    kept = []
    for rep in range(40):
        at = blocks(4, 1, rep, "mixed")
        kept.append(sum(h[i] for i in at) / sum(s[i] for i in at) if any(s[i] for i in at) else math.inf)
    assert got["mixed"].ratio == pytest.approx(7 / 16) and got["mixed"].unbounded == sum(map(math.isinf, kept)) > 1
    assert got["mixed"].high is None and got["mixed"].p == pytest.approx((1 + sum(k >= 1 for k in kept)) / 41)


def test_period_gap_shortens_blocks_and_needs_both_sides(spark):
    rows = [("x", i, int(i < 6), float(i * i % 7)) for i in range(8)] + [("one", i, 1, 1.0) for i in range(5)] + [("x", 99, 0, None)]
    got = {r.g: r for r in reports.period_gap(spark.createDataFrame(rows, "g string, m int, inside int, v double"), ["g"], "m", "inside", "v", 3, 30).collect()}
    assert got["one"].difference is None and got["one"].p is None and got["one"].n_after == 0
    inside, after = [float(i * i % 7) for i in range(6)], [float(i * i % 7) for i in (6, 7)]
    gaps = [sum(inside[i] for i in blocks(6, 1, r, "x", 1)) / 6 - sum(after[i] for i in blocks(2, 1, r, "x", 0)) / 2 for r in range(30)]
    assert got["x"].block == 1 and got["x"].difference == pytest.approx(sum(inside) / 6 - sum(after) / 2)
    assert got["x"].p == pytest.approx(min(1.0, 2 * min(sum(g <= 0 for g in gaps) + 1, sum(g >= 0 for g in gaps) + 1) / 31))


def test_cutoff_cells_give_a_reason_for_few_months(spark):
    rows = [("x", i, int(i < 3), float(i), d) for i in range(5) for d in range(2)]
    r = reports.cutoff_cells(spark.createDataFrame(rows, "g string, m int, inside int, v double, d int"), ["g"], "m", "inside", "v", 2, 10, 3).first()
    assert (r.n_inside, r.n_after, r.difference, r.p, r.passes, r.reason) == (3, 2, None, None, None, "few months")


def test_change_outcomes(spark):
    rows = [("up", q, 10.0, 20.0) for q in range(4)] + [("flat", q, 10.0, 10.0) for q in range(4)] + [("none", 0, 1.0, None)] + [("flip", 0, 1.0, -9.0)]
    got = {r.g: r for r in reports.change_outcomes(spark.createDataFrame(rows, "g string, q int, raw double, adj double"), ["g"], "q", "raw", "adj", 1.0, 2, 10).collect()}
    assert {g: r.outcome for g, r in got.items()} == {"up": "changed", "flat": "unchanged", "none": "missing", "flip": "changed"}
    assert got["none"].dropped == 10 and got["none"].mean_absolute is None and got["flip"].flips == 1 and got["up"].signed_mean == 10


def test_matched_size_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 5 == 0], rng.randint(1, 90)) for i in range(300)]
    target = 2000
    df = spark.createDataFrame(rows, "doc long, s string, t long")
    got = {r.doc for r in reports.matched_size(df, ["s"], "doc", "t", target, "salt").collect()}
    want, total = set(), sum(t for *_, t in rows)
    sizes = {s: sum(t for _, k, t in rows if k == s) for s in "ab"}
    quota = {s: int(n * target / total) for s, n in sizes.items()}
    for s in sorted(sizes, key=lambda s: (-(sizes[s] * target / total - quota[s]), s))[: target - sum(quota.values())]:
        quota[s] += 1
    for s in "ab":
        order = sorted((drawn("salt", i), i, t) for i, k, t in rows if k == s)
        prefixes = [0]
        for *_, t in order:
            prefixes.append(prefixes[-1] + t)
        n = min(range(len(prefixes)), key=lambda i: (abs(prefixes[i] - quota[s]), i))
        want |= {i for _, i, _ in order[:n]}
    assert got == want and len(got) > 10
    assert reports.matched_size(df.limit(0), ["s"], "doc", "t", target, "salt").count() == 0


def test_ordered_leaks_against_a_loop(spark):
    rng = random.Random(5)
    texts = {i: [str(rng.randint(0, 6)) for _ in range(40)] for i in range(12)} | {99: []}
    series = {100: ["1", "2", "3"], 101: ["4", "4", "4"], 102: ["5"], 103: ["77", "1"]}
    docs = spark.createDataFrame([(i, "x " + " ".join(("0" + n if k % 2 else n) for k, n in enumerate(t)) + " a7 7b") for i, t in texts.items()] + [(98, None)], "doc long, text string")
    probes = spark.createDataFrame([(s, k + 1, n) for s, ns in series.items() for k, n in enumerate(ns)], "sid long, k int, number string")
    places = reports.number_places(docs, "doc", "text")
    assert places.count() == 12 * 40
    for span in (1, 3, 50):
        got = {(r.sid, r.doc) for r in reports.ordered_leaks(places, probes, "doc", "sid", 3, span).collect()}
        want = set()
        for d, numbers in texts.items():
            at = {n: [i for i, m in enumerate(numbers) if m == n] for n in numbers}
            for s, ns in series.items():
                for last in at.get(ns[0], []):
                    for n in ns[1:]:
                        later = at.get(n, [])
                        j = bisect.bisect_right(later, last) if last is not None else len(later)
                        last = later[j] if j < len(later) and later[j] - last <= span else None
                    if last is not None:
                        want.add((s, d))
        assert got == want


def test_between_takes_nothing_without_both_marks(spark):
    rows = [(1, ["x", "Start a", "b", "Vote c", "Vote d"]), (2, ["Start Vote"]), (3, ["Vote", "Start"]), (4, []), (5, None), (6, [None, "Start", None, "Vote"]), (7, ["Vote Start"])]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, l array<string>").select("i", reports.between(F.col("l"), ("Start", "Begin"), "Vote").alias("s")).collect()}
    assert got == {1: ["Start a", "b", "Vote c"], 2: None, 3: None, 4: None, 5: None, 6: ["Start", None, "Vote"], 7: None}


def test_verdicts_are_strict():
    checks = {c: True for c in parsing.CHECKS}
    sound = {"equivalent": True, "checks": checks, "discrepancies": []}
    assert parsing.strict_verdict(json.dumps(sound)) == "passed"
    for other in ({"discrepancies": ["x"]}, {"equivalent": False}, {"checks": checks | {"dates": False}}):
        assert parsing.strict_verdict(json.dumps(sound | other)) == "rejected"
    for other in ({"discrepancies": [" "]}, {"equivalent": 1}, {"checks": {}}, {"checks": checks | {"more": True}}, {"more": 1}, {"discrepancies": None}, {"checks": checks | {"dates": 1}}):
        assert parsing.strict_verdict(json.dumps(sound | other)) == "malformed"
    for text in (None, "", "[]", "[" * 100000, json.dumps(sound)[:-1] + ', "equivalent": true}'):
        assert parsing.strict_verdict(text) == "malformed"


def test_two_sample_power_meets_the_closed_form(spark):
    designs = spark.createDataFrame([(0.5, 1.0, 64, 64), (0.0, 1.0, 30, 50), (0.5, 1.0, 10**9, 10**9), (0.5, 1.0, 1, 9), (0.5, 0.0, 9, 9)], "effect double, noise_sd double, n_a long, n_b long")
    got = {(r.n_a, r.n_b): r for r in reports.power_gate(reports.two_sample_power(designs, 20000), 0.8).collect()}
    assert got[64, 64].power == pytest.approx(0.801, abs=0.015) and got[30, 50].power == pytest.approx(0.05, abs=0.01)
    assert got[10**9, 10**9].state == "passed" and got[30, 50].state == "refused" and got[1, 9].state == got[9, 9].state == "unknown"


def test_recomputed_and_admitted(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5), (3, None, 1)], "k int, x double, y int")
    b = spark.createDataFrame([(1, 1.0, None), (2, 2.5, 5), (4, None, 1)], "k int, x double, y int")
    assert {r.column: (r.n, r.missing, r.different) for r in reports.recomputed(a, b, ["k"], ["x", "y"]).collect()} == {"x": (4, 2, 1), "y": (4, 2, 0)}
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    assert {r.k: r.state for r in reports.admitted(keys(1, 2, 2, 3, 9), keys(1, 2, 3, 3), keys(3), "k").collect()} == {1: "kept", 2: "repeated", 3: "pilot", 9: "unplanned"}


def test_dedup_first_keeps_one_of_equal_rows(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("a", "y", 2), ("b", "x", 3), (None, "z", 4), (None, None, 5)], "u string, t string, o int")
    assert sorted(r.o for r in corpus.dedup_first(rows, ["u", "t"], ["o"]).collect()) == [1, 4, 5]
    assert corpus.dedup_first(rows.limit(0), ["u"], ["o"]).columns == ["u", "t", "o"]


def test_hash_ranked_places_every_row_of_any_stratum(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 3}", "x") for i in range(500)]
    got = corpus.hash_ranked(spark.createDataFrame(rows, "k long, s string, _size_ string"), ["s"], "k", "salt").collect()
    want = {}
    for s in {r[1] for r in rows}:
        order = sorted((hashlib.md5(f"salt:{k}".encode()).hexdigest(), k) for k, t, _ in rows if t == s)
        want |= {k: (i + 1, len(order)) for i, (_, k) in enumerate(order)}
    assert {r.k: (r._rank, r._size) for r in got} == want and len(got) == 500


def test_recomputed_reads_what_is_stored(spark):
    """Both sides stand on one stored table, so no mean of doubles is computed twice."""
    from mnemo.plans import report_queries

    plan = report_queries.recomputed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_totalprice" not in plan


def test_intake_takes_the_same_rows_however_they_are_dealt(spark):
    """Arrivals of one day and address: the first title stays, from every order of the rows."""
    from mnemo.streaming import logs

    old = spark.createDataFrame([("2020-01-05", "u", "t")], "day string, url string, title string")
    rows = [("2020-01-05", f"u{k % 3}", f"t{k}") for k in range(9)]
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = logs.intake(old, spark.createDataFrame(rows, "day string, url string, title string").coalesce(1), "day", "url", "title").collect()
        assert sorted((r.url, r.title) for r in got) == [("u0", "t0"), ("u1", "t1"), ("u2", "t2")]


def test_arrivals_meet_the_whole_existing_third(spark, tmp_path):
    """Existing events beyond the first 300 keep addresses, titles and days out, in the query as in its SQL."""
    import datetime

    import duckdb

    from mnemo.plans import report_queries

    # 600 is of the existing third: 1213 has its address, 1402 its title, 1001 is of a day before it
    rows = [(600, 5), (1213, 5), (1402, 6), (1001, 4), (1000, 5), (1003, 6)]
    events = spark.createDataFrame([(k, datetime.datetime(2024, 1, day, 12)) for k, day in rows], "event_id long, ts timestamp_ntz")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, report_queries.arrivals(spark, str(tmp_path)).select("url", "title", "day").collect()))
    assert got == sorted((f"u{k * 7 % 613:06d}", f"t{k % 401}", f"2024-01-0{day}") for k, day in ((1000, 5), (1003, 6)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT url, title, day FROM ({report_queries.ARRIVALS})").fetchall()) == got


def test_catalogue_related_deals_a_group_into_blocks(spark):
    """One group of 200 in blocks of 16 gives all its pairs; a null group has none."""
    rows = spark.createDataFrame([(k, "g" if k < 200 else None) for k in range(210)] + [(7, "h"), (300, "h")], "entry int, grp string")
    asked = rows.filter("entry % 20 = 7")
    want = sorted([(a, b) for a in range(7, 200, 20) for b in range(200) if a != b] + [(7, 300)])
    assert sorted(map(tuple, reports.catalogue_related(rows, asked, block=16).collect())) == want


def test_catalogue_related_writes_little_for_a_pair_and_spreads_its_pairs(spark, tmp_path):
    """One group of 20,000 of which 100 are asked: all pairs, a fraction of a byte each in a file, made in several tasks."""
    spark.range(20000).select(F.col("id").alias("entry"), F.lit("g").alias("grp")).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    reports.catalogue_related(rows, rows.filter("entry % 200 = 0")).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    found = out.groupBy("entry").agg(F.count("*").alias("n"), F.countDistinct("other").alias("d"), F.sum("other").alias("s")).collect()
    assert sorted(r.entry for r in found) == list(range(0, 20000, 200))
    assert all((r.n, r.d, r.s) == (19999, 19999, 19999 * 10000 - r.entry) for r in found)
    files = list((tmp_path / "out").glob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < 0.3 * 100 * 19999
    assert out.groupBy(F.input_file_name()).count().count() > 1
