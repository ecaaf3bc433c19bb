"""Hard negatives, conversation repair and packing against brute force, and token ids against the library on odd letters."""

import functools
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("mnemo.llm.queries")

from mnemo.llm import conversations, negatives, packing, queries, tokens  # noqa: E402

RNG = random.Random(5)


# ---- op 10


def test_token_ids_of_letters_marks_and_punctuation():
    from tokenizers import Tokenizer

    library, encode = Tokenizer.from_file(queries.TOKENIZER), tokens.word_encoder(queries.TOKENIZER)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    letters = [c for c in every if unicodedata.category(c)[0] == "L" and (ord(c) < 0x3000 or RNG.random() < 0.02)]
    marks, punctuation = [c for c in every if unicodedata.category(c) == "Mn"], list("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")
    texts = [x for c in letters for x in (c + RNG.choice(punctuation), c + RNG.choice(marks) + RNG.choice(punctuation), "A" + c + "..")]
    texts += [c + m + RNG.choice(punctuation) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in marks[:100]]
    ids, first = encode(pa.array(texts, pa.string()))
    wrong = [t for k, (t, e) in enumerate(zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True)) if ids[first[k] : first[k + 1]].tolist() != e.ids]
    assert len(texts) > 20_000 and wrong == []


# ---- op 11


def brute_negatives(rows, positives=5, negatives=3):
    known = []
    for place, (vec_id, x, label) in enumerate(rows):
        if vec_id is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        known.append((place, vec_id, label, [int(np.floor(256 * v)) for v in x]))
    out = []
    for place, anchor, label, q in known:
        if anchor % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(q, r, strict=False)), v, lab == label) for p, v, lab, r in known if p != place]
        for score, positive, _ in sorted(s for s in scored if s[2])[:positives]:
            inside = sorted(s for s in scored if not s[2] and 50 * -score <= 100 * -s[0] <= 95 * -score)[:negatives]
            out += [(anchor, positive, k + 1, s[1], -score, -s[0]) for k, s in enumerate(inside)]
    return sorted(out)


def vectors_table(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "clash") for r in rows], "vec_id long, embedding array<float>, label int, score double, block string")


def random_vectors(n, width=9):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, width))
    rows = []
    for k in range(n):
        label = int(rng.integers(0, 4)) if k % 3 else 0
        rows.append((k, [float(np.float32(v)) for v in centres[label] * 0.2 + rng.normal(size=width) * 0.2], label))
    return rows


def mined(spark, rows, **sizes):
    found = negatives.hard_negatives(negatives.integer_vectors(vectors_table(spark, rows)), F.col("vec_id") % 50 == 0, **sizes)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def test_hard_negatives_match_brute_force(spark):
    rows = random_vectors(400)
    same = [0.25] * 9
    rows += [(450, None, 1), (500, [float("nan")] * 9, 1), (550, same, None), (None, same, 2), (600, [None] * 9, 1), (650, [float("inf")] + same[1:], 1), (700, [], 1), (750, [0.5, -0.5], 2)]
    rows += [(800 + k, same, k % 2) for k in range(60)] + [(50, same, 1), (50, same, 1)]  # one vector many times; a repeated anchor
    want = brute_negatives(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, rows_of_block=70, anchors_of_block=3) == want


def test_hard_negatives_of_large_components_and_empty_tables(spark):
    rows = [(k, [float(np.float32(v * 200)) for v in x], label) for k, x, label in random_vectors(120)]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [0.5], 1)]) == [] and mined(spark, [(50, [0.5], 1)]) == []


def test_bounds_hold_and_rule_rows_out(spark):
    rows = [(k, x, label) for k, x, label in random_vectors(3000, 32)]
    share = negatives.passing_share(negatives.integer_vectors(vectors_table(spark, rows)).cache(), F.col("vec_id") % 50 == 0)
    assert 0 < share < 0.5
    q = np.array([[int(np.floor(256 * v)) for v in x] for _, x, _ in rows[:300]])
    books = negatives.fit_codebook(q)
    codes, lengths, units = negatives._quantised(q, books)
    for m in range(16):
        rest = np.sqrt(((q[:, 2 * m : 2 * m + 2] - books[m][codes[:, m]]) ** 2).sum(1))
        assert (lengths[:, m] * units[m] >= rest - 1e-9).all()


# ---- op 12


def brute_damage(rows):
    out, convs = {}, set()
    for conv, turn, role, text in rows:
        convs.add(conv)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * (2 if kind == 3 else 1))
    return convs, {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute_repair(rows):
    """All edits with up to two inserts at a place, by recursion over the rows: the least (cost, audit, text)."""
    faults = faults_of(rows)

    @functools.cache
    def best(k, state, inserted):
        found = []
        if k == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        steps = []
        if inserted < 2:
            role = "assistant" if state == "u" else "user"
            steps.append((3, "I", role, "", k, inserted + 1))
        if k < len(rows):
            _, role, text = rows[k]
            steps.append((4, "D", None, None, k + 1, 0))
            if faults[k] not in ("blank", "duplicate"):
                more = 3 if faults[k] == "truncated" else 0
                steps.append((more, "K", role, text, k + 1, 0))
                steps += [(3 + more, "R", r, text, k + 1, 0) for r in ("user", "assistant")]
        for cost, name, role, text, then, ins in steps:
            to = state
            if role is not None:
                pair = state + role[:1]
                if not role or pair not in ("s", "u", "su", "ua", "au"):
                    continue
                to = role[:1]
            rest = best(then, to, ins)
            if rest is not None:
                found.append((cost + rest[0], name + rest[1], ((role, text), *rest[2]) if role is not None else rest[2]))
        return min(found) if found else None

    cost, audit, turns = best(0, "", 0)
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(), turns


def brute_conversations(rows):
    convs, kept = brute_damage(rows)
    out = []
    for conv in convs:
        mine = kept.get(conv, [])
        faults, turns = faults_of(mine), {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out.append((str(conv), gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *brute_repair(mine)[:3]))
    return sorted(out)


def random_conversations(n):
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "agent"], ["Hi.", "Yes!", "No?", "cut off", " ", "", None, "a. \n", "é漢.", "x\x1c"]
    rows = []
    for conv in range(n):
        for turn in range(RNG.randrange(0, 9)):
            rows.append((conv if conv else None, RNG.choice([turn, turn, turn, None, turn + 3]), RNG.choice(roles) if conv % 2 else ("user", "assistant")[turn % 2], RNG.choice(texts)))
    return rows


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, fault string")
    found = conversations.repair_structure(conversations.damage(df))
    return sorted((str(r[0]), *r[1:]) for r in found.collect())


def test_repair_matches_brute_force(spark):
    rows = random_conversations(300)
    want = brute_conversations(rows)
    assert repaired(spark, rows) == want
    assert {len(r[7]) for r in want} > {0, 1, 2} and sum(r[5] for r in want) > 50


def test_strings_in_parts_are_compared_as_whole(monkeypatch):
    roles, texts = ["user", "assistant", "system", "tool"], ["Hi.", "cut", "", "No?"]
    for _ in range(400):
        rows = [(k, RNG.choice(roles), RNG.choice(texts) + RNG.choice(["", " "])) for k in range(RNG.randrange(0, 14))]
        faults, results = faults_of(rows), []
        for size in (1, 2, 3, 1024):
            monkeypatch.setattr(conversations, "PART_ROWS", size)
            repair = conversations._Repair()
            for (_, role, text), fault in zip(rows, faults, strict=True):
                repair.row(role, text, fault)
            results.append(repair.result())
        assert results == [brute_repair(rows)[:3]] * 4


def test_a_long_conversation_is_a_stream(spark):
    rows = [(7, k, ("user", "assistant")[k % 2] if k % 11 else "tool", f"Turn {k}.") for k in range(20_000)]
    (found,) = repaired(spark, rows)
    assert len(found[7]) >= 19_000 and found[6] > 0
    short = rows[:300]
    assert repaired(spark, short) == brute_conversations(short)


def test_edited_turns_give_the_hash(spark):
    rows = [r for r in random_conversations(80) if r[0] is not None]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    damaged = conversations.damage(df)
    audits = conversations.repair_structure(damaged)
    want = {r["conv_id"]: r["repaired_sha256"] for r in audits.collect()}
    turns: dict = {}
    for r in conversations.edited(damaged, audits).orderBy("conv_id", "place").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in want} == want


def test_no_conversations(spark):
    assert repaired(spark, []) == []


# ---- op 13


def test_packing_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.TOKENIZER)
    words = ["alpha", "Beta,", "gamma.", "été", "漢字", "12"]
    texts = [None, "", " ", "one", "two words", " ".join(RNG.choice(words) for _ in range(9000))] + [" ".join(RNG.choice(words) for _ in range(RNG.randrange(1, 3000))) for _ in range(40)]
    rows = [(k, t, 1, "clash") for k, t in enumerate(texts)] + [(3, "one", 1, "clash"), (None, "no id", 1, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, start string").repartition(3)
    found = packing.pack_documents(docs, queries.TOKENIZER, folder=str(tmp_path / "packed")).collect()
    want = []
    for doc_id, text, _, _ in rows:
        ids, start = [*library.encode(text or "", add_special_tokens=False).ids, 1], 0
        lengths = [2048] * (len(ids) // 2048) + [1 << b for b in range(10, -1, -1) if (len(ids) % 2048) >> b & 1]
        for n in lengths:
            want.append((str(doc_id), start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids), 0))
            start += n
        assert start == len(ids)
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["offset"]) for r in found) == sorted(want)
    assert len({r["sequence_id"] for r in found}) == len(found)
    buckets = {p.name for p in (tmp_path / "packed").iterdir() if p.name.startswith("bucket=")}
    assert "bucket=2048" in buckets and all(int(b[7:]) & int(b[7:]) - 1 == 0 for b in buckets)


def test_packing_of_nothing_and_of_other_lengths(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, queries.TOKENIZER).collect() == []
    docs = spark.createDataFrame([(1, "word " * 50)], "doc_id long, text string")
    assert sorted(r["length"] for r in packing.pack_documents(docs, queries.TOKENIZER, longest=8).collect())[-1] == 8
    with pytest.raises(ValueError):
        packing.pieces(docs, queries.TOKENIZER, longest=6)
