"""Conversation structure repair: a forward Viterbi pass over the four states of a grammar of roles.

The roles of a repaired conversation, by their initials, are `(s?(ua)+)?`. The states are what was written last: nothing,
`s`, `u` or `a`; the first and the last of these may end a conversation. A row is kept (cost 0), given the one role of user
and assistant that its state allows (3) or deleted (4); blank and repeated rows must be deleted, and a truncated row that
stays costs 3 more. An empty turn of the role that the state allows may be inserted anywhere (3). The cheapest edits win, and
among these the ones whose initials (D, I, K, R) are least in ASCII.

The pass reads a conversation's rows in order and carries, for each state, the least (cost, audit string) and a running
SHA-256 of the text repaired so far; no row is kept once it is read. Each turn's layer is closed by at most two inserts from
a state, since a third would come back to a state at a higher cost. Two strings of one state and cost that come from the same
rows differ before either ends, as an insert has a cost; so the least prefix stays the least. Of a long conversation the
strings are held as linked parts, and strings of different parts are compared by an order kept for their common end.

Rows are marked in Spark: repeats by a window over (conversation, role, digest of the text), which divides a large
conversation among many tasks; then rows are dealt by conversation and sorted. A hash over a conversation's whole text has
to see it in one order, so a conversation is read by one task, as a stream: a task's memory is an audit string, not a group.

Defined cases: a null role or text is one space, and a null conv_id or turn is one space in the damage's key. Rows of one turn
stand in the order of role and text (by code point); null turns stand first. A null conv_id is a conversation of its own. A
role whose initial is not s, u or a (an empty role too) can not be kept as it is. Repeated rows are duplicates. Long texts
pass through the hash once for each state. An empty table gives no rows. Only conv_id, turn, role and text are read, so
further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of the contract: blank, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States by what was written last; the role that each allows next besides system; where that leads; which may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (USER, USER, ASSISTANT, USER)
ENDS = (NOTHING, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")
#: Rows after which a conversation's strings begin a new part.
PART_ROWS = 1024


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `gone` after the damage that a hash of conversation and turn decides.

    Of a row that is dropped a marker stays (`gone`), so that its conversation is still there.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDINGS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text and optionally gone) with `fault`: blank, duplicate, truncated or null, the first that holds."""
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.withColumn("gone", gone)
    inner = F.rtrim(F.col("text"), F.lit(SPACE))
    order = Window.partitionBy("conv_id", "gone", "role", F.sha2(F.col("text").cast("binary"), 256)).orderBy(F.col("turn").asc_nulls_first())
    repeated = F.row_number().over(order) > 1
    fault: Column = F.when(inner == "", "blank").when(repeated, "duplicate").when(~F.substring(inner, -1, 1).isin(*ENDINGS), "truncated")
    return rows.withColumn("fault", F.when(~F.col("gone"), fault))


class _Repair:
    """The pass over one conversation. A state is (cost, node, tail, hash): its audit string is the node's and the tail."""

    def __init__(self) -> None:
        self.states: list[tuple | None] = [(0, 0, "", hashlib.sha256()), None, None, None]
        self.parts: list[tuple[int, str]] = [(-1, "")]  # parent node and text of every node
        self.ends = {(0, 0): ("", "")}  # of two nodes: what each has after their common beginning, as far as it can matter
        self.rows = 0
        self.close()

    def less(self, a: tuple, b: tuple) -> bool:
        if a[0] != b[0]:
            return a[0] < b[0]
        mine, other = self.ends[a[1], b[1]]
        return mine + a[2] < other + b[2]

    def row(self, role: str, text: str, fault: str | None) -> None:
        best: list[tuple | None] = [None] * 4
        may_stay = fault not in ("blank", "duplicate")
        extra = TRUNCATED if fault == "truncated" else 0
        for state, at in enumerate(self.states):
            if at is None:
                continue
            cost, node, tail, digest = at
            offers = [(state, (cost + DELETE, node, tail + "D", digest, None))]
            if may_stay:
                goes, to = NEXT_ROLE[state], NEXT_STATE[state]
                lead = "\n" if state else ""
                offers.append((to, (cost + REROLE + extra, node, tail + "R", digest, lead + goes)))
                if role[:1] == goes[0]:
                    offers.append((to, (cost + extra, node, tail + "K", digest, lead + role)))
                elif role[:1] == "s" and state == NOTHING:
                    offers.append((SYSTEM, (cost + extra, node, tail + "K", digest, role)))
            for to, offer in offers:
                if best[to] is None or self.less(offer, best[to]):
                    best[to] = offer
        body = (":" + text).encode("utf-8", "surrogatepass")
        for state, offer in enumerate(best):
            if offer is not None:
                *kept, digest, line = offer
                if line is not None:
                    digest = digest.copy()
                    digest.update(line.encode("utf-8", "surrogatepass") + body)
                best[state] = (*kept, digest)
        self.states = best
        self.close()
        self.rows += 1
        if self.rows % PART_ROWS == 0:
            self.settle()

    def close(self) -> None:
        """Inserts after a row: two at most from any state."""
        for _ in range(2):
            for state in range(4):
                at = self.states[state]
                if at is None:
                    continue
                to = NEXT_STATE[state]
                offer = (at[0] + INSERT, at[1], at[2] + "I")
                if self.states[to] is None or self.less(offer, self.states[to]):
                    digest = at[3].copy()
                    digest.update((("\n" if state else "") + NEXT_ROLE[state] + ":").encode())
                    self.states[to] = (*offer, digest)

    def settle(self) -> None:
        """Turn the tails into nodes, so that strings stay short."""
        first = len(self.parts)
        alive = [k for k, at in enumerate(self.states) if at is not None]
        ends = {}
        for i, a in enumerate(alive):
            for j, b in enumerate(alive):
                mine, other = self.ends[self.states[a][1], self.states[b][1]]
                mine, other = mine + self.states[a][2], other + self.states[b][2]
                same = len(os.path.commonprefix([mine, other]))
                mine, other = mine[same:], other[same:]
                ends[first + i, first + j] = (mine[:1], other[:1]) if mine and other else (mine, other)
        for i, a in enumerate(alive):
            cost, node, tail, digest = self.states[a]
            self.parts.append((node, tail))
            self.states[a] = (cost, first + i, "", digest)
        self.ends = ends

    def result(self) -> tuple[int, str, str]:
        """Cost, audit string and hash of the cheapest way to an end."""
        best = None
        for state in ENDS:
            at = self.states[state]
            if at is not None and (best is None or self.less(at, best)):
                best = at
        text, node = [best[2]], best[1]
        while node >= 0:
            node, part = self.parts[node]
            text.append(part)
        return best[0], "".join(reversed(text)), best[3].hexdigest()


class _Counts:
    """What is counted of a conversation's rows after the damage."""

    def __init__(self) -> None:
        self.least = self.last = None
        self.turns = self.illegal = 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.initial: str | None = None

    def row(self, turn: int | None, role: str, fault: str | None) -> None:
        if turn is not None:
            if self.least is None:
                self.least = turn
            if turn != self.last:
                self.last, self.turns = turn, self.turns + 1
        if fault is not None:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.initial = role[:1]

    def result(self) -> list[int]:
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return [gaps, *self.faults.values(), self.illegal]


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.string() if c.endswith(" string") else pa.int64() for c in RESULT.split(", ")]
    started, conv = False, None
    repair, counts = _Repair(), _Counts()
    done: list[list] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        done.clear()
        return out

    for batch in batches:
        for conv_id, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not started or conv_id != conv:
                if started:
                    done.append([conv, *counts.result(), *repair.result()])
                started, conv, repair, counts = True, conv_id, _Repair(), _Counts()
            if not gone:
                counts.row(turn, role, fault)
                repair.row(role, text, fault)
        if len(done) >= 5_000:
            yield flush()
    if started:
        done.append([conv, *counts.result(), *repair.result()])
        yield flush()


def repair_structure(rows: DataFrame) -> DataFrame:
    """One row for a conversation of `rows` (conv_id, turn, role, text; see with_faults): its counts, the cheapest edits and the hash of what they leave."""
    marked = with_faults(rows)
    # of rows alike in all, the one that is no duplicate stands first
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.coalesce(F.col("fault") == "duplicate", F.lit(False))]
    ordered = marked.repartition("conv_id").sortWithinPartitions(*order)
    return ordered.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(_run, RESULT)


def edited(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, place, role, text, edit) of `rows`, as the audit strings of repair_structure say.

    Deleted rows are left out and inserted ones are there with an empty text. Rows are numbered by a window in their order, and
    a row's edit is found by the number of the letter in the audit string that is not an insert.
    """
    letters = audits.select("conv_id", F.posexplode(F.split("audit", "")).alias("place", "edit")).filter(F.col("edit") != "")
    upto = Window.partitionBy("conv_id").orderBy("place")
    letters = letters.withColumn("n", F.when(F.col("edit") != "I", F.sum((F.col("edit") != "I").cast("int")).over(upto)))
    plain = rows.filter(~F.col("gone")) if "gone" in rows.columns else rows
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = plain.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order))
    both = letters.join(numbered.withColumnRenamed("conv_id", "of"), letters["conv_id"].eqNullSafe(F.col("of")) & (letters["n"] == numbered["n"]), "left").filter("edit <> 'D'")
    # after s, and at the beginning, comes a user; then the two take turns
    system = (F.col("edit") == "K") & F.col("role").startswith("s")
    count = F.sum((~F.coalesce(system, F.lit(False))).cast("int")).over(upto)
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(F.when(count % 2 == 1, "user").otherwise("assistant"))
    return both.select(letters["conv_id"], "place", role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit")
