"""Edge cases of the operators on hand-built rows."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.functions import logits, parsing, stats, text
from mnemo.operators import calibrate, consensus, corpus, metrics, ngram, rank, reports, resample, series
from mnemo.sources import html, readers
from mnemo.streaming import logs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("reply", "direction", "confidence"),
    [
        ("Direction: 1\nConfidence: 0.7", 1, 0.7),
        ("**Direction:** -1. Later Direction: 0", 0, None),
        ("Direction: 5 but higher", 1, None),
        ('{"direction": "-1", "confidence": 0.25}', -1, 0.25),
        ("{bad} {\"Direction\": 0}", 0, None),
        ("Direction is surely 1", 1, None),
        ("Confidence: 65%", None, 0.65),
        ("Confidence: 1.5", None, None),
        ("lower, then finally higher", 1, None),
        ('{"direction": "up", "Direction": 1, "confidence": 7, "CONFIDENCE": 0.5}', 1, 0.5),
        ("no movement", 0, None),
        ("", None, None),
    ],
)
def test_replies(spark, reply, direction, confidence):
    row = spark.createDataFrame([(reply,)], "t string").select(parsing.direction(F.col("t")), parsing.confidence(F.col("t"))).first()
    assert row[0] == direction
    assert row[1] == pytest.approx(confidence) if confidence is not None else row[1] is None


@pytest.mark.parametrize(
    ("reply", "code"),
    [('{"a": 1}', None), ('```json\n{"a": 1}\n```', None), ('{"a": 1, "a": 2}', "duplicate_key"), ('{"a": NaN}', "not_json"), ('{"a": true}', "not_number"), ("[1]", "not_object"), ("x {}", "not_json"), ("", "empty"), (None, "empty"), ("{}", "not_object")],
)
def test_strict_numbers(reply, code):
    assert parsing.strict_numbers(reply)[1] == code


def test_bounds_and_answers(spark):
    rows = spark.createDataFrame([({"a": 0.5},), ({"a": 2.0},), ({"a": 0.5, "b": 1.0},), (None,)], "m map<string,double>")
    assert [r[0] for r in rows.select(parsing.within_bounds(F.col("m"), {"a": (0, 1)})).collect()] == [True, False, False, False]
    rows = spark.createDataFrame([('{"k": 1.5}',), ('{"k": null}',), ('{"k": "1"}',), (None,)], "t string")
    assert [r[0] for r in rows.select(parsing.answer_status(F.col("t"), "k")).collect()] == ["answered", "abstained", "invalid", "invalid"]


def test_wilson_and_medians(spark):
    low, high = stats.wilson(F.lit(0), F.lit(10))
    assert one(spark, low) == pytest.approx(0.0, abs=1e-12) and one(spark, high) == pytest.approx(0.27753, abs=1e-5)
    assert one(spark, stats.wilson(F.lit(0), F.lit(0))[0]) is None
    lo, _ = stats.wilson(F.lit(5), F.lit(10), continuity=True)
    assert one(spark, lo) < one(spark, stats.wilson(F.lit(5), F.lit(10))[0])
    assert one(spark, stats.lower_median(F.array(F.lit(4.0), F.lit(1.0), F.lit(2.0), F.lit(9.0)))) == 2.0
    assert one(spark, stats.lower_median(F.array().cast("array<double>"))) is None
    assert [one(spark, stats.snap(F.lit(v), "0.05")) for v in (0.125, -0.125, 0.024, -0.0)] == [0.15, -0.15, 0.0, 0.0]
    assert one(spark, stats.on_grid(F.lit(float("nan")), "0.05")) is False


def test_logits(spark):
    x = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))
    lp = [one(spark, F.get(logits.log_softmax(x), F.lit(i))) for i in range(3)]
    assert np.exp(lp).sum() == pytest.approx(1.0)
    assert one(spark, logits.rank_of(x, F.lit(2))) == 1 and one(spark, logits.rank_of(x, F.lit(0))) == 3
    assert [t["id"] for t in one(spark, logits.top_k(x, 2))] == [1, 2]
    assert one(spark, logits.log_softmax(F.array(F.lit(1.0), F.lit(float("inf"))))) is None
    assert one(spark, logits.bottom_mean(F.array(F.lit(5.0), F.lit(1.0)), 0.2)) == 1.0
    assert one(spark, logits.position_z(F.lit(-1.0), F.array(F.lit(-2.0), F.lit(-2.0)))) == pytest.approx(1e6)


def test_rank_filter_ties(spark):
    rows = spark.createDataFrame([(i, 0.5) for i in range(10)] + [(99, float("nan")), (98, None)], "pos int, p double")
    assert sorted(r["pos"] for r in rank.rank_filter(rows, "p", "pos").collect()) == list(range(8))
    ranked = rank.global_rank(spark.range(100).withColumn("v", F.col("id") % 7), ["v", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 101)) and [(r["v"], r["id"]) for r in ranked] == sorted((i % 7, i) for i in range(100))


def test_auc_and_effects(spark):
    rng = random.Random(1)
    data = [(rng.randrange(5) / 4, rng.randrange(2)) for _ in range(60)]
    got = metrics.rank_auc(spark.createDataFrame(data, "s double, y int"), "s", "y").first()["auc"]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    assert got == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    assert metrics.rank_auc(spark.createDataFrame([(1.0, 1)], "s double, y int"), "s", "y").first()["auc"] is None
    rows = spark.createDataFrame([(1.0, True), (1.0, True), (2.0, False)], "v double, i boolean")
    row = metrics.effect_size(rows, "v", "i").first()
    assert row["d"] is None and row["note"] == "insufficient samples"
    row = metrics.effect_size(spark.createDataFrame([(1.0, True), (3.0, True), (0.0, False), (2.0, False)], "v double, i boolean"), "v", "i").first()
    assert row["d"] == pytest.approx(1 / 2**0.5)


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    got = {r["k"]: r["adjusted"] for r in metrics.holm(rows, "p", "k").collect()}
    assert got["d"] is None and [got[k] for k in "abc"] == pytest.approx([0.03, 0.06, 0.06])


def brute_split(values, need=0.25, gap=3, contrast=10.0, density=1.5):
    """The split rule by trying every pair."""
    total = len(values)
    if total < 8:
        return None
    counts = sorted({v: values.count(v) for v in values}.items())
    found = []
    for i in range(len(counts)):
        for j in range(i + 1, len(counts)):
            low, high = counts[: i + 1], counts[j:]
            a, b = sum(n for _, n in low), sum(n for _, n in high)
            trough = max([n for _, n in counts[i + 1 : j]], default=0)
            peak = max(n for _, n in low + high)
            if a >= need * total and b >= need * total and counts[j][0] - counts[i][0] - 1 >= gap and (a + b) / len(low + high) >= density and peak >= contrast * trough:
                found.append((total - a - b, -(peak - contrast * trough), i, j, counts[i][0], counts[j][0]))
    return min(found)[4:] if found else ()


def test_split_search(spark):
    rng = random.Random(3)
    items = {0: [1] * 10 + [9] * 10, 1: list(range(0, 60, 3)), 2: [1, 2, 3], 3: [5] * 20}
    for k in range(4, 40):
        items[k] = [rng.choice([rng.randrange(4), rng.randrange(8, 12), rng.randrange(12)]) for _ in range(rng.randrange(5, 30))]
    rows = spark.createDataFrame([(k, float(v)) for k, vs in items.items() for v in vs], "item int, v double")
    for row in consensus.split_search(rows, ["item"], "v", "1", contrast=2.0).collect():
        want = brute_split(items[row["item"]], contrast=2.0)
        assert row["separated"] == (None if want is None else bool(want)), row
        if want:
            assert (row["gap_low"], row["gap_high"]) == want


def test_consensus(spark):
    rows = spark.createDataFrame([(1, "b", "x2"), (1, "a", "x1"), (1, "b", "x0"), (1, "a", "x3"), (2, "c", "y")], "item int, a string, t string")
    got = {r["item"]: (r["modal"], r["agreement"], r["consensus"]) for r in consensus.consensus_draw(rows, ["item"], "a", "t").collect()}
    assert got == {1: ("a", 0.5, "x1"), 2: ("c", 1.0, "y")}
    a = consensus.canonical_hash(rows, ["item"], "t").orderBy("item").first()["draws_hash"]
    assert a == consensus.canonical_hash(rows.orderBy(F.desc("t")), ["item"], "t").orderBy("item").first()["draws_hash"]
    assert a != consensus.canonical_hash(rows.union(rows), ["item"], "t").orderBy("item").first()["draws_hash"]


def test_as_of_and_months(spark):
    left = spark.createDataFrame([("a", "2020-03-05"), ("a", "2020-01-01"), ("b", "2020-03-05")], "k string, d string").withColumn("d", F.to_date("d"))
    right = spark.createDataFrame([("a", "2020-03-01", 1.0), ("a", "2020-03-05", 2.0), ("a", "2020-03-06", 3.0)], "k string, e string, v double").withColumn("e", F.to_date("e"))
    got = {(r["k"], str(r["d"])): r["as_of_value"] for r in series.as_of(left, right, ["k"], "d", "e", "v", 7).collect()}
    assert got == {("a", "2020-03-05"): 2.0, ("a", "2020-01-01"): None, ("b", "2020-03-05"): None}
    monthly = spark.createDataFrame([("s", 24240, 2.0), ("s", 24252, 3.0), ("s", 24253, 9.0)], "k string, month long, value double")
    got = {r["month"]: (r["yoy"], r["missing"]) for r in series.year_on_year(monthly, ["k"]).collect()}
    assert got[24252] == (0.5, None) and got[24253] == (None, "no base month")


def test_weights_and_performance(spark):
    rows = spark.createDataFrame([("d", "x", 1.0, 0.5, 1), ("d", "x", -1.0, 0.9, 2), ("d", "y", 1.0, 0.9, 3)], "day string, t string, dir double, c double, pos int")
    got = {r["t"]: r["weight"] for r in series.target_weights(rows, "day", "t", "dir", "c", "pos").collect()}
    assert got == pytest.approx({"x": -0.5, "y": 0.5})
    returns = spark.createDataFrame([("k", i, r) for i, r in enumerate([0.1, -0.5, 0.2])], "k string, d int, r double")
    row = series.performance(returns, ["k"], "d", "r").first()
    assert row["total_return"] == pytest.approx(1.1 * 0.5 * 1.2 - 1) and row["max_drawdown"] == pytest.approx(-0.5)


def greedy(rows):
    seen_a, seen_b, out = set(), set(), []
    for o, a, b in sorted(rows):
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            out.append(o)
    return out


def test_greedy_dedup(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(25), rng.randrange(25)) for i in range(80)]
    got = corpus.dedup_greedy(spark.createDataFrame(rows, "o int, a int, b int"), "a", "b", ["o"])
    assert sorted(r["o"] for r in got.collect()) == greedy(rows)


def test_boundaries(spark):
    day = F.lit("2020-01-01").cast("date")
    assert [one(spark, corpus.cutoff_label(day, day, day, b)) for b in ("in_sample", "dropped", "post")] == [1, None, 0]
    with pytest.raises(ValueError, match="boundary"):
        corpus.cutoff_label(day, day, day, "other")


def test_numpy_mode_equals_numpy(spark):
    x = np.arange(20.0)
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, o int, v double")
    row = resample.grouped_interval(rows, ["k"], "o", "v", n=100, seed=7).first()
    rng = np.random.default_rng(7)
    means = [x[rng.integers(0, 20, 20)].mean() for _ in range(100)]
    assert (row["low"], row["high"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    assert one(spark, resample.binomial_tail(F.lit(9), F.lit(10), 0.5)) == pytest.approx(11 / 1024)


def test_logistic_separates(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    y = (x + 0.5 * rng.normal(size=200) > 0).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "x double, y int")
    w = calibrate.fit_logistic(rows, ["x"], "y")
    n1 = y.sum()
    weight = np.where(y == 1, 200 / (2 * n1), 200 / (2 * (200 - n1)))
    p = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
    gradient = np.array([(weight * (p - y)).sum(), (weight * (p - y) * x).sum() + w[1]])
    assert np.abs(gradient).max() < 1e-6


def test_trigram_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "b c")], "id int, t string")
    one_, two, three = ngram.counts(ngram.tokens(docs, "id", "t"))
    probes = spark.createDataFrame([(i, f"a b {w}") for i, w in enumerate("abc")], "id int, t string")
    last = {r["id"]: r["log_p"] for r in ngram.score(ngram.tokens(probes, "id", "t"), one_, two, three, "id").collect()}
    head = ngram.score(ngram.tokens(spark.createDataFrame([(0, "a b")], "id int, t string"), "id", "t"), one_, two, three, "id").first()["log_p"]
    # three words and one unseen class share the mass
    assert sum(np.exp(v - head) for v in last.values()) == pytest.approx(1.0, abs=0.06)


def test_text_checks(spark):
    assert one(spark, text.published_date(F.lit("2020-02-30"))) is None
    assert str(one(spark, text.published_date(F.lit("2020-02-28T10:00:00Z")))) == "2020-02-28"
    assert one(spark, text.first_filled(F.lit(" "), F.lit(None).cast("string"), F.lit(" x "))) == "x"
    assert one(spark, text.title_like(F.lit("A line of enough words"))) is True
    lines, share = html.lines_of("<head><title>t</title></head><p>a<br>b</p><table><tr><td>cc</td></tr></table>")
    assert lines == ["a", "b", "cc"] and share == 0.5


def test_readers(spark, tmp_path):
    path = tmp_path / "eval.jsonl"
    path.write_text('{"_cutoff_date": "2024-06-30"}\n\n{"prompt": "p", "target_direction": 1, "metadata": {"a": "b"}}\n')
    rows, cutoff = readers.read_eval_set(spark, str(path))
    assert cutoff == "2024-06-30" and [(r["prompt"], r["target_direction"]) for r in rows.collect()] == [("p", 1)]
    path.write_text('{"prompt": "p", "target_direction": 7}\n')
    with pytest.raises(Exception, match="bad evaluation row"):
        readers.read_eval_set(spark, str(path))[0].collect()
    path = tmp_path / "cutoffs.yaml"
    path.write_text('models:\n  a/b: 2024-01-31  # see https://example.org/x\n  "c": "2023-05-01"\n')
    assert [(r["model"], str(r["cutoff"]), r["source"]) for r in readers.read_cutoffs(spark, str(path)).orderBy("model").collect()] == [("a/b", "2024-01-31", "https://example.org/x"), ("c", "2023-05-01", None)]
    path = tmp_path / "s.csv"
    path.write_text("DATE,X\n2020-01-01,1.5\n2020-01-02,.\n")
    assert [r["value"] for r in readers.read_snapshot(spark, str(path), "X").orderBy("day").collect()] == [1.5, None]
    body = json.dumps({"observations": [{"date": "2020-01-01", "value": "1", "realtime_start": "2020-01-02", "realtime_end": "9999-12-31"}, {"date": "2020-02-01", "value": ".", "realtime_start": "2020-01-02", "realtime_end": "9999-12-31"}]})
    got = readers.observations(spark.createDataFrame([("s", body)], "series string, body string"), "body", "2020-03-01").collect()
    assert [(str(r["day"]), r["value"]) for r in got] == [("2020-01-01", 1.0)]
    line = "8-K         ACME  HOLDINGS INC                     1000180     20200131    edgar/data/1.txt"
    got = readers.form_index(spark.createDataFrame([(line,), ("10-K  X  1 20200101 f",)], "value string"), ["8-K"]).first()
    assert (got["form"], got["company"], got["cik"], str(got["filed"]), got["file"]) == ("8-K", "ACME  HOLDINGS INC", "1000180", "2020-01-31", "edgar/data/1.txt")


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k": 1, "n": 1, "v": "x"}\n{"k": 1, "n": 2, "v": "y"}\n{"k": 2, "n": 1, "v": "z"}\n{"k": 3, "n"')
    run = lambda: logs.latest_of_log(spark, str(tmp_path / "in"), "k long, n long, v string", ["k"], ["n"], str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r["k"], r["v"]) for r in run().collect()) == [(1, "y"), (2, "z")]
    (tmp_path / "in" / "b.json").write_text('{"k": 1, "n": 3, "v": "w"}\n')
    assert sorted((r["k"], r["v"]) for r in run().collect()) == [(1, "w"), (2, "z")]


def test_intake_and_assembly(spark):
    old = spark.createDataFrame([("2020-01-05", "u1", "t1")], "day string, url string, title string")
    new = spark.createDataFrame([("2020-01-05", "u2", "t2"), ("2020-01-04", "u3", "t3"), ("2020-01-06", "u1", "t4"), ("2020-01-06", "u5", "t2")], "day string, url string, title string")
    assert [r["url"] for r in logs.intake(old, new, "day", "url", "title").collect()] == ["u2"]
    parts = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 2, "c")], "reply_id int, part int, text string")
    assert sorted((r["reply_id"], r["valid"], r["text"]) for r in logs.assemble_replies(parts).collect()) == [(1, True, "ab"), (2, False, None)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a\nb</p>", ["a", "b"]),
        ("<tr><td>x</td><td>y</td></tr><tr><th>z</th></tr>", ["x y", "z"]),
        ("<section>a</section><nav>b</nav>", ["ab"]),
        ("<blockquote>a</blockquote><dl><dt>b<dd>c</dl>d<hr>e<center>f</center>", ["a", "b", "c", "d", "e", "f"]),
        ("<head><title>t</title></head>x<script>if (a<b) '</p>'</script>y<!-- <p> -->z", ["xyz"]),
        ("a &amp; b&nbsp;c &lt;p&gt; 1 < 2", ["a & b c <p> 1 < 2"]),
        ("<P CLASS='a>b'>one</P><![foo[bar]]>two", ["one", "two"]),
        (None, []),
        ("<td>open", ["open"]),
    ],
)
def test_lines_of_pages(page, want):
    assert html.lines_of(page)[0] == want


def test_share_of_text_in_cells():
    assert html.lines_of("<p>ab</p><table><tr><td>c d</td><th>e</th></tr></table></td>fg")[1] == pytest.approx(3 / 7)
    assert html.lines_of("") == ([], 0.0)


def test_latest_of_a_log_run_again(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    (source / "a.jsonl").write_text('{"k": "x", "seq": 1, "v": 1}\n{"k": "y", "seq": 2, "v": 2}\n')
    run = lambda: sorted((r["k"], r["v"]) for r in logs.latest_of_log(spark, str(source), "k string, seq long, v long", ["k"], ["seq"], str(tmp_path / "out"), str(tmp_path / "check")).collect())
    assert run() == [("x", 1), ("y", 2)]
    assert run() == [("x", 1), ("y", 2)]
    (source / "b.jsonl").write_text('{"k": "x", "seq": 3, "v": 9}\n')
    assert run() == [("x", 9), ("y", 2)]


def test_greedy_acceptance_of_a_long_chain(spark):
    """Row i shares a value with row i + 1 alone, so that a round decides two rows; every second one stays."""
    rows = spark.createDataFrame([(i, (i + 1) // 2, i // 2) for i in range(100)], "i int, a int, b int")
    assert sorted(r.i for r in corpus.dedup_greedy(rows, "a", "b", ["i"]).collect()) == list(range(0, 100, 2))


def test_exhibits(spark):
    listing = '{"directory": {"item": [{"type": "ex-99.1", "name": "a.jpg"}, {"type": "EX-99.01", "name": "B.HTM"}]}}'
    page = '<TR><td>x<a href="/i.htm"></td></tr><tr><td>EX-99.2</td><td><a href="/c.htm">c</a></td></tr><tr><td><b>EX-99.1</b>&nbsp;</td><td><a class=x href=\'/ix?doc=/d.txt\'>d</a></td></tr>'
    rows = spark.createDataFrame([(listing, page), ("{}", "<tr><td>EX-99.1</td></tr>"), ("no json", ""), (None, None)], "l string, p string")
    got = rows.select(readers.listed_exhibit(F.col("l"), F.lit("f")), readers.linked_exhibit(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("f/B.HTM", "https://www.sec.gov/d.txt"), (None, None), (None, None), (None, None)]


def test_shortlist_of_first_candidates(spark):
    rows = [("a", 0, 1, "ok", True), ("a", 0, 2, "ok", True), ("b", 1, 1, "ok", False), ("b", 1, 2, "timeout", None), ("c", 2, 1, "ok", None), ("d", 3, 1, "ok", True), ("e", 4, 1, "ok", True), ("f", 5, 1, None, True)]
    df = spark.createDataFrame(rows, "m string, place int, k int, status string, parsed boolean")
    got = {r.m: (r.passed, r.reason, r.selected) for r in reports.shortlist(df, "m", "place", "k", "status", F.col("parsed"), 2).collect()}
    assert got == {"a": (True, None, True), "b": (False, "timeout", False), "c": (False, "parse_failure", False), "d": (True, None, True), "e": (True, None, False), "f": (False, "error", False)}
    assert reports.shortlist(df.limit(0), "m", "place", "k", "status", F.col("parsed")).count() == 0


def test_binomial_tail_of_large_n(spark):
    """Against a sum of all terms, around the mean, in both tails and at the ends."""
    cases = [(n, k) for n in (1, 19, 21, 400, 30000) for k in sorted({0, 1, int(0.8 * n), int(0.8 * n + n**0.5), int(0.9 * n), n, n + 1})]
    got = spark.createDataFrame(cases, "n long, k long").select("n", "k", resample.binomial_tail(F.col("k"), F.col("n"), 0.8).alias("p")).collect()
    for r in got:
        terms = (math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.8) + (r.n - i) * math.log(0.2) for i in range(r.k, r.n + 1))
        assert r.p == pytest.approx(min(1.0, math.fsum(map(math.exp, terms))), rel=1e-8, abs=1e-300)
    big = spark.createDataFrame([(10_000_000, 8_000_500)], "n long, k long").select(resample.binomial_tail(F.col("k"), F.col("n"), 0.8).alias("p")).first().p
    assert big == pytest.approx(0.5 * math.erfc((500 - 0.5) / (1.6e6 * 2) ** 0.5), abs=1e-4)


def test_trigram_totals_read_the_texts_once(spark):
    from mnemo.plans import text_queries

    plan = text_queries.trigram_totals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_trigram_scores_count_each_order_once(spark):
    """The counts that are asked for are kept, so what is scored reads no text of the model again."""
    docs = spark.createDataFrame([(0, "a b c a b"), (1, None), (2, "")], "id int, t string")
    items = spark.createDataFrame([(0, "a b c")], "id int, u string")
    out = ngram.score(ngram.tokens(items, "id", "u"), *ngram.counts(ngram.tokens(docs, "id", "t")), "id")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(t#" not in plan and "lower(coalesce(t#" not in plan
    assert out.first()["n_tokens"] == 3
