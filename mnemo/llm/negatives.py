"""Hard-negative mining: product quantisation with stored residual norms.

Vectors are integers, `floor(256 * x)` of every component. Pairs of components are quantised by a codebook of up to 256
integer centroids each, fitted on at most SAMPLE rows; every row is indexed. A row keeps its codes, and for each pair the
length of what the centroid leaves over, rounded up to a byte. A table of an anchor's products with all centroids then gives
a score, and the lengths give a bound that the true score cannot leave. The bound alone decides which rows can be among the
first of their kind; the exact integer product of those ranks them. Nothing is approximate in the result.

Rows stand in blocks of ROWS_OF_BLOCK, anchors in blocks of ANCHORS_OF_BLOCK, and each pair of blocks is one cell of the
work: the anchors are a stated query set against all rows, so the work grows with their product, and a cell gives a few rows
for each of its anchors. Every block has a bounded size whatever a label's share of the rows; a frequent label or vector
makes no larger cell.

Two passes: the first finds each anchor's positives (the first rows of its label), the second, for each positive, the first
rows of other labels whose score lies in the window of that positive's score. A window is empty where the positive's score
is below zero.

Defined cases: rows with a null label, a null vector, a null or non-finite component, or a null vec_id take no part. Each
row counts for itself: repeated rows are positives and negatives of each other, and a repeated anchor's results repeat.
Vectors of unequal length are continued with zeros; an empty vector scores zero. Integers beyond 2 ** 24 are held there.
Ties go by the smaller vec_id. A very long vector needs room for its block. An empty table, or one without anchors, gives no
rows. Only vec_id, embedding and label are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows that the codebook is fitted on; components of a subspace; centroids of a subspace; rounds of the fit.
SAMPLE = 8192
PAIR = 2
CENTROIDS = 256
ROUNDS = 8
ROWS_OF_BLOCK = 8192
ANCHORS_OF_BLOCK = 16384
#: Anchors that one step scores together.
STEP_ANCHORS = 256
LARGEST = 1 << 24


def integer_vectors(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label and `q` (array of long) of the rows that take part; `label` may replace the table's own."""
    known = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    known = known.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = F.transform("x", lambda v: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), v * 256))).cast("long"))
    return known.filter(finite).select("vec_id", (F.col("label") if label is None else label).alias("label"), held.alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of int64; shorter lists are continued with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(1)[None, :] - 2 * x @ book.T).argmin(1)


def fit_codebook(sample: np.ndarray) -> np.ndarray:
    """Integer centroids, (subspace, centroid, component), by k-means from a spread start. Fewer distinct values repeat."""
    rows, width = sample.shape
    books = np.zeros((width // PAIR, CENTROIDS, PAIR))
    for m in range(len(books)):
        x = sample[:, m * PAIR : (m + 1) * PAIR].astype(np.float64)
        values = np.unique(x, axis=0) if rows else np.zeros((1, PAIR))
        book = values[np.linspace(0, len(values) - 1, CENTROIDS).astype(np.int64)]
        for _ in range(ROUNDS if len(values) > CENTROIDS else 0):
            at = _nearest(x, book)
            n = np.bincount(at, minlength=CENTROIDS)
            sums = np.stack([np.bincount(at, x[:, k], CENTROIDS) for k in range(PAIR)], 1)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        books[m] = np.round(book)
    return books.astype(np.int64)


def _quantised(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, bytes of the residuals' lengths, and each subspace's unit of these bytes. A byte never understates a length."""
    codes = np.zeros((len(q), len(books)), np.uint8)
    lengths = np.zeros((len(q), len(books)))
    for m, book in enumerate(books):
        x = q[:, m * PAIR : (m + 1) * PAIR]
        codes[:, m] = at = _nearest(x.astype(np.float64), book.astype(np.float64))
        lengths[:, m] = np.sqrt(((x - book[at]).astype(np.float64) ** 2).sum(1))
    unit = np.maximum(lengths.max(0, initial=0) / 255, 1e-9) * (1 + 1e-9)
    return codes, np.ceil(lengths / unit).clip(0, 255).astype(np.uint8), unit


def _kind(top: int) -> str:
    return "<i2" if top < 1 << 15 else "<i4"


BLOCK = "block long, n long, top long, keys binary, ids binary, labels binary, q binary, codes binary, lengths binary, units binary"


def pack(rows: DataFrame, books: np.ndarray, blocks: int) -> DataFrame:
    """Rows (key, vec_id, label, q; already stored) dealt into blocks of equal size: one row for a block, sorted by label within."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # 256 centroids for two components
    width = len(books) * PAIR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        held = pa.Table.from_batches(found).combine_chunks()
        key, ids, label = (held[c].to_numpy().astype("<i8") for c in ("key", "vec_id", "label"))
        at = np.lexsort((ids, label))
        q = _matrix(held["q"].combine_chunks().take(pa.array(at)), width)
        top = int(np.abs(q).max(initial=0))
        packed = [key[at], ids[at], label[at], q.astype(_kind(top)), *_quantised(q, shared.value)]
        row = [TaskContext.get().partitionId(), len(at), top, *(x.tobytes() for x in packed)]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], [c.split()[0] for c in BLOCK.split(", ")])

    return rows.select("key", "vec_id", "label", "q").repartition(blocks).mapInArrow(run, BLOCK)


class _Block:
    """One packed block as arrays."""

    def __init__(self, row: dict) -> None:
        n, self.top = row["n"], row["top"]
        self.keys, self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("keys", "ids", "labels"))
        self.q = np.frombuffer(row["q"], _kind(self.top)).reshape(n, -1)
        self.codes, self.lengths = (np.frombuffer(row[c], np.uint8).reshape(n, -1) for c in ("codes", "lengths"))
        self.units = np.frombuffer(row["units"], "<f8")

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def steps(self) -> Iterator[tuple[int, np.ndarray]]:
        """Labels, each with places of up to STEP_ANCHORS of its rows."""
        for label in np.unique(self.labels):
            begin, end = self.of_label(label)
            for at in range(begin, end, STEP_ANCHORS):
                yield label, np.arange(at, min(end, at + STEP_ANCHORS))


class _Scorer:
    """Scores of some anchors with the rows of a block: bounded by tables, or exact."""

    def __init__(self, rows: _Block, anchors: _Block, at: np.ndarray, books: np.ndarray) -> None:
        self.rows, q = rows, anchors.q[at].astype(np.int64)
        most = (rows.top + 1) * (anchors.top + 1) * q.shape[1]
        self.small = most < 1 << 29
        kind = np.int32 if self.small else np.float64
        parts = q.reshape(len(at), -1, PAIR)
        self.tables = np.einsum("amk,mck->mca", parts, books).astype(kind)
        self.norms = np.ascontiguousarray((np.sqrt((parts.astype(np.float64) ** 2).sum(2)) * rows.units).T.astype(np.float32))
        self.rest = 1.0 if self.small else 1.0 + most * 1e-10  # what rounding can lose
        self.q = q.astype(np.int32 if self.small else np.int64)

    def bounds(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of the rows from `begin` to `end`, (row, anchor)."""
        codes = self.rows.codes[begin:end]
        score = self.tables[0][codes[:, 0]]
        for m in range(1, codes.shape[1]):
            score += self.tables[m][codes[:, m]]
        slack = self.rows.lengths[begin:end].astype(np.float32) @ self.norms
        slack = np.ceil(slack * np.float32(1.0001) + np.float32(self.rest)).astype(score.dtype)
        return score - slack, score + slack

    def exact(self, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row), np.int64)
        for k in range(0, len(row), 1 << 15):
            part = slice(k, k + (1 << 15))
            out[part] = np.einsum("ij,ij->i", self.rows.q[row[part]].astype(self.q.dtype), self.q[anchor[part]])
        return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each column; less than all where there are fewer."""
    if len(values) < k:
        return np.full(values.shape[1], _least(values.dtype), values.dtype)
    return np.partition(values, len(values) - k, axis=0)[len(values) - k]


def _least(kind: np.dtype) -> float:
    return np.iinfo(kind).min if kind.kind == "i" else -np.inf


def _first(group: np.ndarray, keep: int) -> np.ndarray:
    """Which places are among the first `keep` of their group; groups stand together, in ascending order."""
    return np.arange(len(group)) - np.searchsorted(group, group) < keep


def _ranked(scorer: _Scorer, candidates: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and exact score of the candidates, by anchor, then the higher score, then the smaller id."""
    row, anchor = np.nonzero(candidates)
    row += begin
    score = scorer.exact(row, anchor)
    order = np.lexsort((scorer.rows.ids[row], -score, anchor))
    return anchor[order], row[order], score[order]


def _positives_of_cell(rows: _Block, anchors: _Block, books: np.ndarray, keep: int) -> Iterator[list]:
    """anchor_key, anchor_id, positive_id, score: the first `keep` rows of each anchor's label in this block, itself left out."""
    for label, at in anchors.steps():
        begin, end = rows.of_label(label)
        if begin == end:
            continue
        scorer = _Scorer(rows, anchors, at, books)
        low, high = scorer.bounds(begin, end)
        anchor, row, score = _ranked(scorer, high >= _kth(low, keep + 1), begin)  # one more: the anchor may be among them
        other = rows.keys[row] != anchors.keys[at[anchor]]
        anchor, row, score = anchor[other], row[other], score[other]
        ok = _first(anchor, keep)
        mine = at[anchor[ok]]
        yield [anchors.keys[mine], anchors.ids[mine], rows.ids[row[ok]], score[ok]]


def window_of(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest negative score between `low` and `high` hundredths of the positive's."""
    return -(-low * score // 100), high * score // 100


def _negatives_of_cell(rows: _Block, anchors: _Block, books: np.ndarray, keep: int, share: tuple[int, int], windows: list[dict]) -> Iterator[list]:
    """anchor_key, place of the positive, its id and score, negative's id and score: the first `keep` of each window in this block."""
    place = {int(k): i for i, k in enumerate(anchors.keys)}
    most = max((w["place"] for w in windows), default=0)
    positive, there = np.zeros((most, len(place)), np.int64), np.zeros((most, len(place)), bool)
    names = np.zeros((most, len(place)), np.int64)
    for w in windows:
        k = w["place"] - 1, place[w["anchor_key"]]
        positive[k], names[k], there[k] = w["positive_score"], w["positive_id"], True
    least, largest = window_of(positive, *share)
    there &= least <= largest
    for label, at in anchors.steps():
        scorer = _Scorer(rows, anchors, at, books)
        begin, end = rows.of_label(label)
        for a, b in ((0, begin), (end, len(rows.ids))):
            if a == b or not there[:, at].any():
                continue
            low, high = scorer.bounds(a, b)
            found = np.zeros(low.shape, bool)
            for w in range(most):
                lo, hi, on = least[w, at].astype(low.dtype), largest[w, at].astype(low.dtype), there[w, at]
                # what is surely inside sets how high the others must reach
                bar = np.maximum(_kth(np.where((low >= lo) & (high <= hi), low, _least(low.dtype)), keep), lo)
                found |= (high >= bar) & (low <= hi) & on
            anchor, row, score = _ranked(scorer, found, a)
            for w in range(most):
                mine = at[anchor]
                inside = np.flatnonzero(there[w, mine] & (score >= least[w, mine]) & (score <= largest[w, mine]))
                inside = inside[_first(anchor[inside], keep)]
                mine = at[anchor[inside]]
                yield [anchors.keys[mine], np.full(len(mine), w + 1), anchors.ids[mine], names[w, mine], positive[w, mine], rows.ids[row[inside]], score[inside]]


def _cells(rows: DataFrame, anchors: DataFrame, shape: tuple[int, int], run, schema: str) -> DataFrame:
    """`run` over every pair of a block of rows and a block of anchors."""
    cells = min(shape[0] * shape[1], 20_000)
    keys = ("row_block", "anchor_block")
    every = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in shape]
    left = rows.withColumnRenamed("block", keys[0]).withColumn(keys[1], every[1]).repartition(cells, *keys)
    right = anchors.withColumnRenamed("block", keys[1]).withColumn(keys[0], every[0]).repartition(cells, *keys)
    names = [c.split()[0] for c in schema.split(", ")]

    def cell(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        parts = list(run(rows.to_pylist()[0], anchors.to_pylist()[0])) if rows.num_rows and anchors.num_rows else []
        columns = [np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in range(len(names))]
        return pa.table(columns, names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def _best(found: DataFrame, group: list[str], name: str, keep: int, place: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col(f"{name}_score").desc(), f"{name}_id")
    return found.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= keep)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), rows_of_block: int = ROWS_OF_BLOCK, anchors_of_block: int = ANCHORS_OF_BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows of `vectors` (see integer_vectors).

    An anchor is a row for which `is_anchor` holds. `share` is the window in hundredths of the positive's score.
    """
    spark: SparkSession = vectors.sparkSession
    rows = common.stored(vectors.withColumn("key", F.monotonically_increasing_id()), "vectors")
    anchors = rows.filter(is_anchor)
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(is_anchor.cast("long")), F.lit(0)).alias("anchors"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("width")).first()
    width = max(PAIR, sizes["width"] + sizes["width"] % PAIR)
    sample = rows.select("q").orderBy(F.xxhash64("key")).limit(SAMPLE).toArrow()
    books = fit_codebook(_matrix(sample["q"].combine_chunks(), width) if sample.num_rows else np.zeros((0, width), np.int64))
    shape = max(1, -(-sizes["n"] // rows_of_block)), max(1, -(-sizes["anchors"] // anchors_of_block))
    row_blocks, anchor_blocks = common.stored(pack(rows, books, shape[0]), "rows"), common.stored(pack(anchors, books, shape[1]), "anchors")
    shared = spark.sparkContext.broadcast(books)

    first = _cells(
        row_blocks, anchor_blocks, shape, lambda r, a: _positives_of_cell(_Block(r), _Block(a), shared.value, positives), "anchor_key long, anchor_id long, positive_id long, positive_score long"
    )
    windows = _best(first, ["anchor_key"], "positive", positives, "place")
    # an anchor's block: its keys, one row for each anchor
    keys = anchor_blocks.select("block", "keys").mapInArrow(_unpacked_keys, "block long, anchor_key long")
    packed = windows.join(keys, "anchor_key").groupBy("block").agg(F.collect_list(F.struct("anchor_key", "place", "positive_id", "positive_score")).alias("windows"))
    with_windows = common.stored(anchor_blocks.join(packed, "block"), "windows")
    second = _cells(
        row_blocks,
        with_windows,
        shape,
        lambda r, a: _negatives_of_cell(_Block(r), _Block(a), shared.value, negatives, share, a["windows"]),
        "anchor_key long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    best = _best(second, ["anchor_key", "place"], "negative", negatives, "rank")
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _unpacked_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys = np.frombuffer(keys, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(keys)], ["block", "anchor_key"])


def passing_share(vectors: DataFrame, is_anchor: Column) -> float:
    """The share of (anchor, row of its label) pairs that the bound lets pass to the exact product, over one block of each."""
    rows = vectors.withColumn("key", F.monotonically_increasing_id())
    width = rows.agg(F.max(F.size("q"))).first()[0]
    table = rows.select("q").limit(SAMPLE).toArrow()
    books = fit_codebook(_matrix(table["q"].combine_chunks(), width + width % PAIR))
    r, a = (_Block(pack(x.limit(ROWS_OF_BLOCK), books, 1).first().asDict()) for x in (rows, rows.filter(is_anchor)))
    passed = seen = 0
    for label, at in a.steps():
        begin, end = r.of_label(label)
        if begin < end:
            low, high = _Scorer(r, a, at, books).bounds(begin, end)
            passed, seen = passed + int((high >= _kth(low, 6)).sum()), seen + low.size
    return passed / max(seen, 1)
