"""Replies with state over batches and restarts, and the log's account, refusal and compaction."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException

from mnemo.streaming import logs, replies

RNG = random.Random(4)
T0 = datetime(2024, 1, 1)
SCHEMA = "reply_id long, part long, text string, final boolean, ts timestamp"


def reply_parts():
    """Parts of replies with every outcome, and which outcome."""
    rows, want = [], {}
    for k in range(60):
        n = RNG.randrange(1, 7)
        parts = [(k, p, f"r{k}p{p} ", p == n - 1, T0 + timedelta(seconds=k * 10 + p)) for p in range(n)]
        kind = k % 5
        if kind == 1 and n > 1:
            parts.append(parts[0])
            want[k] = "repeated"
        elif kind == 2 and n > 2:
            del parts[1]
            want[k] = "gap"
        elif kind == 3:
            parts[-1] = (*parts[-1][:3], False, parts[-1][4])
            want[k] = "unfinished"
        elif kind == 4 and n > 1:
            parts[0] = (*parts[0][:2], "x" * 200, *parts[0][3:])
            want[k] = "too_long"
        else:
            want[k] = ""
        # the repeated part may not come after the end
        head, tail = parts[:-1], parts[-1:]
        if kind == 1 and n > 1:
            head, tail = [p for p in parts if not p[3]], [p for p in parts if p[3]]
        RNG.shuffle(head)
        rows.append(head + tail if kind == 1 else RNG.sample(parts, len(parts)))
    return rows, want


def write(folder, rows, name):
    (folder / name).write_text("".join(json.dumps({"reply_id": r, "part": p, "text": t, "final": f, "ts": ts.isoformat()}) + "\n" for r, p, t, f, ts in rows))


def test_parts_over_batches_and_restarts_match_the_table(spark, tmp_path):
    per_reply, want = reply_parts()
    source = tmp_path / "in"
    source.mkdir()
    flat = [p for rows in per_reply for p in rows]
    last = [(10_000, 0, "late", True, T0 + timedelta(days=2)), (10_001, 0, "open", False, T0 + timedelta(days=2))]

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        return replies.drained(replies.assembled_stream(stream, "1 hour", "1 hour", limit=150), str(tmp_path / "out"), str(tmp_path / "check"))

    third = len(flat) // 3
    write(source, flat[:third], "a.json")
    write(source, flat[third : 2 * third], "b.json")
    early = run().collect()
    assert 0 < len(early) < 60 and all(r["reason"] in ("", "repeated", "too_long") for r in early)
    write(source, flat[2 * third :], "c.json")
    write(source, last, "d.json")
    got = sorted(map(tuple, run().collect()))
    table = replies.assembled(spark.createDataFrame(flat + last[:1], SCHEMA), limit=150).drop("latest")
    assert got == sorted(map(tuple, table.collect()))
    assert {r[0]: r[3] for r in got if r[0] < 100} == want


def test_what_comes_after_the_end_is_ignored_and_more_than_the_end_is_told(spark):
    rows = [(1, 0, "a", True, T0), (1, 1, "b", False, T0), (2, 0, None, True, T0), (3, None, "x", True, T0), (4, 1, "z", True, T0)]
    got = sorted(map(tuple, replies.assembled(spark.createDataFrame(rows, SCHEMA)).drop("latest").collect()))
    assert got == [(1, 2, False, "continued", None), (2, 1, True, "", ""), (4, 1, False, "gap", None)]
    assert replies.assembled(spark.createDataFrame([], SCHEMA)).collect() == []


LOG = "plan_hash string, k string, seq long, v long"


def line(k, seq, v, plan="p"):
    return json.dumps({"plan_hash": plan, "k": k, "seq": seq, "v": v})


def test_account_and_compaction(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()

    def drain(refuse=False):
        logs.drain_log(spark, str(source), LOG, ["k"], ["seq"], out, check, "p", refuse)
        return logs.account(spark, out, ["k"], ["seq"]).first().asDict()

    (source / "a.json").write_text("\n".join([line("a", 1, 1), line("b", 1, 2), line("a", 2, 3), line("x", 1, 9, "other"), '{"plan_hash": "p", "k": "to']))
    assert drain() == {"lines": 5, "torn": 1, "foreign": 1, "draws": 3, "keys": 2, "superseded": 1}
    assert logs.compact(spark, out, ["k"], ["seq"]) == 0
    assert logs.compact(spark, out, ["k"], ["seq"]) == 0
    (source / "b.json").write_text(line("b", 5, 7) + "\n" + line("c", 1, 1))
    assert drain() == {"lines": 7, "torn": 1, "foreign": 1, "draws": 5, "keys": 3, "superseded": 2}
    latest = lambda: sorted((r["k"], r["v"]) for r in logs.latest_of_table(spark, out, ["k"], ["seq"]).collect())
    assert latest() == [("a", 3), ("b", 7), ("c", 1)]
    base, batches, upto = logs._since_base(spark, out)
    assert (upto, base.count(), batches.count()) == (0, 2, 2)
    assert logs.compact(spark, out, ["k"], ["seq"]) == 1 and latest() == [("a", 3), ("b", 7), ("c", 1)]
    assert logs._since_base(spark, out)[1].count() == 0


def test_lines_of_another_plan_stop_the_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(line("a", 1, 1) + "\n" + line("b", 1, 1, "other"))
    with pytest.raises(StreamingQueryException, match="another plan"):
        logs.drain_log(spark, str(source), LOG, ["k"], ["seq"], str(tmp_path / "out"), str(tmp_path / "check"), "p")
    (source / "a.json").write_text(line("a", 1, 1) + "\n" + line("b", 1, 1))
    with pytest.raises(ValueError, match="empty"):
        logs.latest_of_table(spark, str(tmp_path / "none"), ["k"], ["seq"])


def test_replies_of_a_block_share_a_call(spark, tmp_path):
    """Two files of 600 replies, negative and null numbers, the later times first: what the watermark has passed is closed in its batch, at patience itself too."""
    source = tmp_path / "in"
    source.mkdir()
    numbers = [None, -1, -300, *range(600), (1 << 53) + 1]
    early = [(k, p, f"{k}.{p};", p == 2, T0 + timedelta(seconds=60 + p)) for k in numbers for p in ((0, 1, 2) if k is None or k % 3 else (0, 2))]
    later = [(10_000, 0, "at", False, T0 + timedelta(hours=9)), (10_001, 0, "short", False, T0 + timedelta(hours=9, milliseconds=1)), (10_002, 0, "end", False, T0 + timedelta(hours=10))]
    for name, rows, second in (("a.json", later, 1), ("b.json", early, 2)):
        write(source, rows, name)
        os.utime(source / name, (second, second))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    closed = replies.assembled_stream(stream, "1 hour", "0 seconds")
    assert closed.isStreaming
    got = replies.drained(closed, str(tmp_path / "out"), str(tmp_path / "check")).collect()
    table = replies.assembled(spark.createDataFrame(early + later[:1], SCHEMA)).drop("latest")
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got) == order(table.collect())
    # the state has few keys: one for a block of reply numbers
    assert spark.read.format("statestore").load(str(tmp_path / "check"), batchId=0).count() <= 2
