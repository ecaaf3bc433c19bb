"""LM scoring by cross-entropy difference.

Two bigram models, of a target and of a background corpus, share one vocabulary (the words of both, and one class for all
others), one order and one smoothing. A document's score is its mean loss per token under the target model less that under
the background model, in nats: the lower, the nearer to the target. The background is all documents, and a document is
scored by models without it: its own words are taken off the background's counts, and off the target's if it is part of that.

    P(w) = (c(w) + 1) / (N + V)
    P(w | v) = (c(v, w) + STRENGTH * P(w)) / (c(v) + STRENGTH)

Words are runs of ASCII digits and letters (case folded) and of characters beyond ASCII. A text with words begins after a
boundary and ends with one, which counts as a token, so a word is a context as often as it is a token and both
distributions sum to 1.

Words and bigrams are counted one by one over every token of both corpora. Their counts grow with the corpus, so they are
never gathered or broadcast. Documents are dealt into blocks of about BLOCK_BYTES. A block asks for the counts of its different
words and bigrams: a row for each bucket of keys, with the keys and the block's own counts as packed arrays. A bucket adds
up what all blocks say of its keys and answers each in the order of its keys. The most frequent word has one entry a block,
and blocks grow in number with the corpus, so a bucket is added up in a tree: FAN neighbouring blocks first, then as many of
their sums, and so on; the answers come down the same way. No group has more than FAN rows (a corpus of FAN blocks is one
step). A key is 40 bits within its bucket, and buckets grow in number with the corpus: of a million bigrams about two share
a count with another, at every size.

Defined cases: a null text is empty; a text without words has no tokens and score, target_loss and background_loss 0. With an
empty target both models still have a distribution (the uniform one). Repeated rows count as often as they stand, and
each is left out of its own score alone; all rows of a doc_id in target are part of it. A null doc_id is in no target. A long
text makes its block longer and is never cut. An empty table gives no rows. Only doc_id and text are read, so further
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

STRENGTH = 16.0
#: Bytes of text of a block and of a bucket on average.
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 6 << 20
#: Rows of a bucket that are added up at once.
FAN = 1024
#: Bytes of text whose words are hashed at once.
HASH_BYTES = 1 << 19
KEY_BITS = 40
MAX_BUCKETS = 1 << 24
WORD, PAIR, TARGET = range(3)
BOUNDARY = np.uint64(0x5851F42D4C957F2D)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Whole numbers as little-endian bytes, all lowest bytes first: high bytes are alike and shrink on the way."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplaned(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1).astype(np.int64)


class Block:
    """The tokens of a block's documents: keys of its different words and bigrams, and for each token which these are."""

    def __init__(self, texts: pa.Array, n_buckets: int) -> None:
        words, contexts, sizes = [], [], []
        for _, _, data, offsets in common.text_passes(texts, HASH_BYTES):
            w, first = common.word_hashes(data, offsets)
            there = np.diff(first) > 0
            words.append(np.insert(w, first[1:][there], BOUNDARY))
            contexts.append(np.insert(w, first[:-1][there], BOUNDARY))
            sizes.append(np.diff(first) + there)
        event, context, self.sizes = (np.concatenate([*x, np.zeros(0, k)]).astype(k) for x, k in ((words, np.uint64), (contexts, np.uint64), (sizes, np.int64)))
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        with np.errstate(over="ignore"):
            pair = common.mix(context * np.uint64(0x9E3779B97F4A7C15) + event)
        self.keys, self.at = [], []
        for hashes in (event, pair):
            keys, at = np.unique(_keys(hashes, n_buckets), return_inverse=True)
            self.keys.append(keys)
            self.at.append(at.astype(np.int32))
        # a context is a token of its text too, so its key is among those of words
        self.context = np.searchsorted(self.keys[WORD], _keys(context, n_buckets)).astype(np.int32)

    def own(self, kind: int) -> np.ndarray:
        """How often each token's word or bigram stands in its own text."""
        _, place, n = np.unique(self.text * max(1, len(self.keys[kind])) + self.at[kind], return_inverse=True, return_counts=True)
        return n[place].astype(np.int32)


def _keys(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and, in the lowest KEY_BITS, key within it."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    # of the mixed hash, so that the key does not follow from the bucket
    return (bucket << np.uint64(KEY_BITS)) | (common.mix(hashes) & np.uint64((1 << KEY_BITS) - 1))


def _texts(docs: pa.Table) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(z.as_buffer()) for z in docs.column("packed")], pa.large_binary()).cast(pa.large_string())


def _packed(docs: DataFrame, n_blocks: int) -> DataFrame:
    """block, doc_id and the text, compressed, since it is dealt twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = pa.array([pack((t.as_py() or "").encode()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["block", "doc_id", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.coalesce("doc_id", F.xxhash64("text"))
    return rows.select(_block(key, n_blocks), "doc_id", "text").mapInArrow(run, "block long, doc_id long, packed binary")


def _block(key: F.Column, n_blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("long").alias("block")


def _marked(docs: pa.Table, ids: list) -> np.ndarray:
    wanted = set(ids) - {None}
    return np.array([x in wanted for x in docs.column("doc_id").to_pylist()], bool)


ASKED = "block long, kind int, bucket long, keys binary, target binary, background binary"
ANSWERED = "block long, kind int, bucket long, target binary, background binary, n_keys long, n_target long, n_background long"


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in text.split(", "))])


def _table(rows: list[tuple], schema: str) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_schema(schema))
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _schema(schema), strict=True)], schema=_schema(schema))


def ask(packed: DataFrame, wanted: DataFrame, n_buckets: int) -> DataFrame:
    """The different words and bigrams of each block by bucket, with their counts in the block. wanted: block and doc_id of the target."""

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(docs):
            return _table([], ASKED)
        block = Block(_texts(docs), n_buckets)
        in_target = _marked(docs, wanted.column("doc_id").to_pylist())[block.text]
        name, rows = docs.column("block")[0].as_py(), []
        for kind in (WORD, PAIR):
            keys, at = block.keys[kind], block.at[kind]
            counts = [np.bincount(x, minlength=len(keys)) for x in (at[in_target], at)]
            buckets, first = np.unique(keys >> np.uint64(KEY_BITS), return_index=True)
            for bucket, a, b in zip(buckets.tolist(), first, [*first[1:], len(keys)], strict=True):
                low = keys[a:b] & np.uint64((1 << KEY_BITS) - 1)
                rows.append((name, kind, bucket, _planes(low, 5), *(_planes(n[a:b], 4) for n in counts)))
        return _table(rows, ASKED)

    return packed.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, ASKED)


def _added(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of rows of one bucket: the different keys, the place of each row's keys among them, their counts added up, and where each row's begin."""
    parts = [_unplaned(x.as_buffer(), 5) for x in rows.column("keys")]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    # a block's own counts have 4 bytes, sums have 8
    counts = (np.concatenate([_unplaned(x.as_buffer(), len(x.as_buffer()) // max(1, len(p))) for x, p in zip(rows.column(name), parts, strict=True)]) for name in ("target", "background"))
    return keys, at, [np.bincount(at, n, len(keys)).astype(np.int64) for n in counts], np.cumsum([0, *map(len, parts)])


def _dealt(rows: pa.Table, at: np.ndarray, first: np.ndarray, sums: list[np.ndarray], once: tuple[int, int, int]) -> pa.Table:
    """Each row's keys answered in their order; what is said once a bucket is said in its first row."""
    out = []
    for k, (block, kind, bucket) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("block", "kind", "bucket")), strict=True)):
        mine = at[first[k] : first[k + 1]]
        out.append((block, kind, bucket, *(_planes(s[mine], 8) for s in sums), *(once if k == 0 else (0, 0, 0))))
    return _table(out, ANSWERED)


def merge(asked: DataFrame, fan: int) -> DataFrame:
    """Of each bucket the rows of fan neighbouring blocks as one row, whose block is the number of that neighbourhood."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        keys, _, sums, _ = _added(rows)
        kind, bucket, block = (k.as_py() for k in key)
        return _table([(block, kind, bucket, _planes(keys.astype(np.uint64), 5), *(_planes(n, 8) for n in sums))], ASKED)

    return asked.groupBy("kind", "bucket", F.floor(F.col("block") / fan).cast("long").alias("parent")).applyInArrow(run, ASKED)


def answer(asked: DataFrame) -> DataFrame:
    """The counts over all rows of each row's keys, and once a bucket its number of keys and tokens of both corpora."""

    def run(rows: pa.Table) -> pa.Table:
        keys, at, sums, first = _added(rows)
        return _dealt(rows, at, first, sums, (len(keys), int(sums[0].sum()), int(sums[1].sum())))

    return asked.groupBy("kind", "bucket").applyInArrow(run, ANSWERED)


def spread(asked: DataFrame, answers: DataFrame, fan: int) -> DataFrame:
    """The answers to rows that merge put together, from those to what it made of them."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        _, at, _, first = _added(rows)
        sums = [_unplaned(answers.column(name)[0].as_buffer(), 8) for name in ("target", "background")]
        return _dealt(rows, at, first, sums, tuple(answers.column(name)[0].as_py() for name in ("n_keys", "n_target", "n_background")))

    below = asked.withColumn("parent", F.floor(F.col("block") / fan).cast("long")).groupBy("kind", "bucket", "parent")
    return below.cogroup(answers.withColumn("parent", F.col("block")).groupBy("kind", "bucket", "parent")).applyInArrow(run, ANSWERED)


def counted(asked: DataFrame, n_blocks: int, fan: int) -> DataFrame:
    """answer, by a tree in which no group has more than fan rows: merged upwards, answered at the top, and spread downwards."""
    levels = [asked]
    while n_blocks > fan:
        levels[-1] = common.stored(levels[-1], "asked")
        levels.append(merge(levels[-1], fan))
        n_blocks = -(-n_blocks // fan)
    answers = common.stored(answer(levels.pop()), "answers")
    while levels:
        answers = common.stored(spread(levels.pop(), answers, fan), "answers")
    return answers


SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def score(packed: DataFrame, answers: DataFrame, tokens: tuple[int, int], vocabulary: int, n_buckets: int) -> DataFrame:
    """doc_id, n_tokens (words), target_loss, background_loss and score. answers: of answer, and the target's doc_ids as kind TARGET."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return _table([], SCORED)
        block = Block(_texts(docs), n_buckets)
        kinds, buckets = answers.column("kind").to_numpy(), answers.column("bucket").to_numpy()
        marked = _marked(docs, buckets[kinds == TARGET].tolist())
        own = [block.own(kind) for kind in (WORD, PAIR)]
        counts = []
        for kind in (WORD, PAIR):
            mine = answers.take(np.flatnonzero(kinds == kind)[np.argsort(buckets[kinds == kind])])
            counts.append([np.concatenate([np.zeros(0, np.int64), *(_unplaned(x.as_buffer(), 8) for x in mine.column(c))]) for c in ("target", "background")])
            if len(counts[-1][0]) != len(block.keys[kind]):
                raise ValueError("a block's documents are not those that asked for its counts")
        # a context stands in its text as often as the token it is
        _, place, n = np.unique(block.text * max(1, len(block.keys[WORD])) + block.context, return_inverse=True, return_counts=True)
        of_context = n[place]
        losses = []
        for m, without in enumerate((marked[block.text], np.ones(len(block.text), bool))):
            one = counts[WORD][m][block.at[WORD]] - own[WORD] * without
            two = counts[PAIR][m][block.at[PAIR]] - own[PAIR] * without
            context = counts[WORD][m][block.context] - of_context * without
            single = (one + 1.0) / (tokens[m] - block.sizes[block.text] * without + vocabulary)
            loss = -np.log((two + STRENGTH * single) / (context + STRENGTH))
            losses.append(np.bincount(block.text, loss, len(docs)) / np.maximum(block.sizes, 1))
        columns = [docs.column("doc_id"), pa.array(np.maximum(block.sizes - 1, 0)), *map(pa.array, (*losses, losses[0] - losses[1]))]
        return pa.table(columns, schema=_schema(SCORED))

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORED)


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Score every document of docs against the target corpus, the documents whose doc_id is in target."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    n_blocks, n_buckets = max(1, -(-size // BLOCK_BYTES)), min(MAX_BUCKETS, max(1, -(-size // BUCKET_BYTES)))
    packed = _packed(docs, n_blocks)
    wanted = target.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    wanted = wanted.select(_block(F.col("doc_id"), n_blocks), "doc_id")
    answers = counted(ask(packed, wanted, n_buckets), n_blocks, FAN)
    words = answers.filter(F.col("kind") == WORD).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_keys", "n_target", "n_background"))).first()
    ids = wanted.select("block", F.lit(TARGET).alias("kind"), F.col("doc_id").alias("bucket"), *(F.lit(None).cast("binary").alias(c) for c in ("target", "background")))
    rows = answers.select("block", "kind", "bucket", "target", "background").union(ids)
    return score(packed, rows, (words[1], words[2]), words[0] + 1, n_buckets)
