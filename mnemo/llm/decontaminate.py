"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted shingles.

A benchmark item of L words is looked for in all windows of L words. Similarity is the sum of minima over the sum of
maxima of the weighted three-word shingle multisets; a shingle weighs more the fewer items have it. Weights are counted over
the whole benchmark before anything else, so that the blocks it is cut into do not matter: what less than one in FREQUENT
items has (of FREQUENT items or fewer: what none has) weighs as much as what none has, and of the rest there are at most
FREQUENT times as many as a mean item's shingles, which every block is told.

Which windows: an item's rarest shingles, of more than 1 - SIMILARITY of its weight together, are its anchors. A window
without any of them is not similar enough, so a text without any has none. Of the other texts every window is weighed: what
it can share with the item at most, from running sums, must reach the bound too. What remains is fingerprinted. 64 bits
make RADIUS + 1 blocks, and fingerprints within RADIUS bits agree in one block at least, so no window within the radius
is missed. It is verified by the complete distance and then by the exact similarity.

RADIUS is taken from measured distances: pairs of windows at a similarity of 0.75 to 0.80 differ in 11 bits on average, and
about three in a thousand in more than RADIUS.

Texts are compared by their words: runs of ASCII digits and letters (case folded) and of characters beyond ASCII.

The items go to the executors as flat arrays (pickled with the driver), in blocks of at most BLOCK_CHARS characters however
many items there are; each block is one pass over the texts. Documents are never shuffled.

Defined cases: null texts and items are empty. An item without words matches nothing; one of fewer than SHINGLE_WORDS words
matches only a text that is exactly its words. A text shorter than an item is one window. Texts of any length are looked
through whole. Of equally similar windows the first counts. Repeated rows of documents or items give repeated matches; a
null item_id or doc_id stands as it is. Without items nothing is contaminated; an empty table gives no rows. find_leaks
reads doc_id and text alone, and drop_contaminated returns the columns of docs, so no further column can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE_WORDS = 3
SIMILARITY = 0.75
RADIUS = 22
#: Items of which one more or less changes a weight: rarer shingles all weigh the same.
FREQUENT = 1000
#: Characters of the items that are held at once: about four bytes of arrays for each.
BLOCK_CHARS = 8 << 20
GATE_BITS = 22
#: Weights are whole numbers, so that running sums are exact.
UNIT = 1024
#: Windows whose bits are summed at once.
RUN_WINDOWS = 4096


def _blocks() -> list[tuple[int, int]]:
    bounds = [round(64 * b / (RADIUS + 1)) for b in range(RADIUS + 2)]
    return [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(bounds, bounds[1:], strict=False)]


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])


@dataclass(frozen=True)
class Weights:
    """The weights of the shingles that a share of all items has, in order, and of all the others."""

    items: int
    shingles: np.ndarray
    weights: np.ndarray
    rarest: int

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(shingles), self.rarest, np.int64)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingles, self.weights[at], self.rarest)


def item_weights(benchmark: DataFrame) -> Weights:
    """The weights of the whole benchmark: one count of items for a shingle, of which the frequent ones come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in common.text_passes(batch.column(0)):
                words, first = common.word_hashes(data, offsets)
                shingles, begin = common.shingle_hashes(words, first, SHINGLE_WORDS)
                own = np.concatenate([*(np.unique(shingles[begin[i] : begin[i + 1]]) for i in range(end - row)), np.zeros(0, np.uint64)]).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["shingle"])

    n = benchmark.count()
    seen = benchmark.select(F.col("text").cast("string")).mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    found = seen.filter(F.col("n") * FREQUENT >= n).toArrow()
    shingles, counts = found["shingle"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(shingles)
    scale = min(n, FREQUENT)
    shared = counts[order] * (scale / max(n, 1))
    return Weights(n, shingles[order], np.rint(UNIT * (1.0 + np.log((1 + scale) / (1 + shared)))).astype(np.int64), round(UNIT * (1.0 + math.log(1 + scale))))


class Items:
    """A block of benchmark items as flat arrays: each item's different shingles and their counts, weights, anchors, fingerprints."""

    def __init__(self, item_ids: list, texts: list[str], weights: Weights | None = None) -> None:
        self.ids, self.weigh = item_ids, (weights or Weights(0, np.zeros(0, np.uint64), np.zeros(0, np.int64), UNIT)).of
        lengths, hashes, counts, sizes = [], [], [], []
        for row, end, data, offsets in common.text_passes(pa.array(texts, pa.string())):
            words, first = common.word_hashes(data, offsets)
            shingles, begin = common.shingle_hashes(words, first, SHINGLE_WORDS)
            lengths += np.diff(first).tolist()
            for i in range(end - row):
                h, n = np.unique(shingles[begin[i] : begin[i + 1]], return_counts=True)
                hashes.append(h)
                counts.append(n)
                sizes.append(len(h))
        self.lengths = np.array(lengths, np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.hashes = np.concatenate([*hashes, np.zeros(0, np.uint64)]).astype(np.uint64)
        self.counts = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
        self.totals = np.zeros(len(texts), np.int64)
        self.prints = np.zeros(len(texts), np.uint64)
        anchors: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(len(texts)):
            h, n = self.shingles(i)
            w = self.weigh(h) * n
            self.totals[i] = w.sum()
            self.prints[i] = self.fingerprints(np.repeat(h, n), np.repeat(self.weigh(h), n), np.zeros(1, np.int64), int(n.sum()))[0] if len(h) else 0
            order = np.lexsort((h, -self.weigh(h)))
            need = int(np.searchsorted(np.cumsum(w[order]), (1 - SIMILARITY) * self.totals[i], "right")) + 1
            anchors.append((h[order[:need]], np.full(min(need, len(h)), i)))
        anchor, item = (np.concatenate([*(a[k] for a in anchors), np.zeros(0, kind)]) for k, kind in ((0, np.uint64), (1, np.int64)))
        order = np.lexsort((item, anchor))
        self.anchor, self.anchor_item = anchor[order], item[order]

    @cached_property
    def gate(self) -> np.ndarray:
        """Whether an anchor begins with these bits; made where it is used."""
        gate = np.zeros(1 << GATE_BITS, bool)
        gate[self.anchor >> np.uint64(64 - GATE_BITS)] = True
        return gate

    def shingles(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.first[item], self.first[item + 1])
        return self.hashes[part], self.counts[part]

    @staticmethod
    def fingerprints(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """The weighted SimHash of the windows of `size` shingles at starts (ascending), repeats included."""
        out = np.zeros(len(starts), np.uint64)
        runs = np.flatnonzero(np.diff(starts, prepend=starts[:1] - size - 1) > size)
        bounds = sorted({*runs.tolist(), *range(0, len(starts), RUN_WINDOWS), len(starts)})
        for a, b in zip(bounds, bounds[1:], strict=False):
            part = slice(starts[a], starts[b - 1] + size)
            bits = np.unpackbits(shingles[part].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            at = starts[a:b] - starts[a]
            sums, all_ = _running(bits * weights[part][:, None]), _running(weights[part])
            over = (sums[at + size] - sums[at]) * 2 > (all_[at + size] - all_[at])[:, None]
            out[a:b] = np.packbits(over, axis=1).view(">u8").reshape(-1)
        return out

    def anchored(self, shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The pairs of a text and an item whose anchor stands in it, each once; begin: each text's first shingle."""
        there = np.flatnonzero(self.gate[shingles >> np.uint64(64 - GATE_BITS)])
        lo = np.searchsorted(self.anchor, shingles[there], "left")
        n = np.searchsorted(self.anchor, shingles[there], "right") - lo
        text = np.searchsorted(begin, np.repeat(there, n), "right") - 1
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.unique(np.stack([text, self.anchor_item[entry]], 1), axis=0)

    def best_window(self, item: int, shingles: np.ndarray, weights: np.ndarray, n_words: int) -> tuple[int, int, int, float] | None:
        """start, words, distance and similarity of the window of a text that is most like an item, if one is enough like it."""
        own, n = self.shingles(item)
        size = min(int(n.sum()), len(shingles))
        at = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
        common_ = own[at] == shingles
        shared, every = _running(np.where(common_, weights, 0)), _running(weights)
        shared, every = shared[size:] - shared[:-size], every[size:] - every[:-size]
        either = self.totals[item] + every
        starts = np.flatnonzero(shared * (1 + SIMILARITY) >= SIMILARITY * either)
        fps = self.fingerprints(shingles, weights, starts, size)
        apart = fps ^ self.prints[item]
        met = np.zeros(len(starts), bool)
        for lo, mask in _blocks():
            met |= (apart >> np.uint64(lo)) & np.uint64(mask) == 0
        distance = np.bitwise_count(apart)
        best = None
        own_weights = self.weigh(own)
        for k in np.flatnonzero(met & (distance <= RADIUS)):
            start = int(starts[k])
            part = slice(start, start + size)
            both = int((np.minimum(np.bincount(at[part][common_[part]], minlength=len(own)), n) * own_weights).sum())
            s = both / (int(either[start]) - both)
            if s >= SIMILARITY and (best is None or s > best[3]):
                best = (start, min(int(self.lengths[item]), n_words), int(distance[k]), s)
        return best


def _found(items: Items, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int, int, float]]]]:
    """The rows of a text column that have matches, with these: (item, start, words, distance, similarity)."""
    for row, _, data, offsets in common.text_passes(column):
        words, first = common.word_hashes(data, offsets)
        shingles, begin = common.shingle_hashes(words, first, SHINGLE_WORDS)
        pairs = items.anchored(shingles, begin)
        for part in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else ():
            i = int(part[0, 0])
            mine = shingles[begin[i] : begin[i + 1]]
            weights = items.weigh(mine)
            found = [(int(k), *best) for k in part[:, 1] if (best := items.best_window(int(k), mine, weights, int(first[i + 1] - first[i])))]
            if found:
                yield row + i, found


def item_blocks(benchmark: DataFrame, block_chars: int | None = None) -> Iterator[Items]:
    """The benchmark in blocks whose size is bounded, one after another."""
    block_chars = block_chars or BLOCK_CHARS
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(2 * total / block_chars)) if total > block_chars else 1
    weights = item_weights(rows)
    for k in range(n):
        block = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        got = block.orderBy("item_id", "text").collect()
        if got:
            yield Items([r[0] for r in got], [r[1] for r in got], weights)


MATCH_SCHEMA = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item found in it: the best window's place, size, distance and similarity."""
    spark = docs.sparkSession
    parts = []
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                doc_ids = batch.column(0)
                rows = [(doc_ids[row].as_py(), items.ids[i], start, size, distance, s) for row, found in _found(items, batch.column(1)) for i, start, size, distance, s in found]
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in MATCH_SCHEMA.split(", ")])

        parts.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, MATCH_SCHEMA))
    if not parts:
        return spark.createDataFrame([], MATCH_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in whose text no item is found, with all their columns."""
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, _ in _found(shared.value, batch.column(batch.schema.get_field_index("text"))):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
