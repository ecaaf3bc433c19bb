"""Token-ID / binary output: static range asymmetric numeral system (rANS).

Texts become token ids; ids become blocks of compressed bytes in the order of doc_id. All blocks share one static
frequency table, counted over the whole corpus. A block holds whole documents and decodes on its own; inside it many
rANS lanes are interleaved over one word stream, and checkpoints let the parts of a block be decoded in parallel.

The archive is two Parquet tables in one folder:

* `blocks`: shard, block, start (ids of the shard before it), n_docs, n_ids, data. A shard is a contiguous range of
  doc_id; shards and blocks are numbered in ascending order of doc_id.
* `table`: id, freq: the shared table, whose sum is 2 ** SCALE_BITS.

A block's data: magic, counts, CRC-32 of the body and of the ids; document ids and lengths; the lanes' first states;
checkpoints (step, word offset, lane states); 32-bit words.

Defined cases: a null text is empty, and an empty text is the end id alone. Rows of equal doc_id (or null, which comes
first) stand in the order of a hash of their ids, so that many of them are dealt to many tasks. Every row is kept. An empty table makes an archive without blocks. Only doc_id
and text are read, so further columns cannot clash. A text of any length is one document of one block.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
#: Ids of a block before it ends (a longer document makes a longer block), lanes of a block, steps between checkpoints.
BLOCK_IDS = 1 << 17
LANES = 1024
#: Ids of a shard, about, if the session's number of shuffle partitions would make larger ones.
SHARD_IDS = 1 << 26
CHECKPOINT_STEPS = 64
#: Words whose ids a Python worker remembers.
REMEMBERED = 250_000
MAGIC = 0x314E4152


# ---- tokens

_encoders: dict[str, Callable] = {}

#: What a tokenizer's file says if its pieces can be encoded one by one: nothing is merged over white space, and text is
#: normalized character by character. Texts of other tokenizers are encoded whole.
SPLIT_NORMALIZERS = ("NFC", "Replace", "Lowercase")
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: What keeps a piece whole: a letter whose lower case is more than a letter, and all from U+0300 on, where marks begin that
#: NFC may join to a letter before it is lower-cased, and letters that NFC takes apart. Below, NFC changes nothing.
WHOLE_PIECE = "[\u0130\u0300-\U0010ffff]"


def _splits(spec: dict) -> bool:
    """Whether the tokenizer that `spec` describes lets white-space separated pieces be encoded one by one."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    spaces = [s for s in steps if s["type"] == "Replace"]
    return (
        tuple(s["type"] for s in steps) == SPLIT_NORMALIZERS
        and all(s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in spaces)
        and first.get("type") == "Split"
        and first.get("pattern") == {"Regex": SPLIT_PATTERN}
        and first.get("invert") is True
        and spec["model"].get("end_of_word_suffix") == "</w>"
        and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    )


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum())), sizes


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class _Pieces:
    """The ids of pieces, remembered by a number for each piece."""

    def __init__(self, tokenizer, ends: np.ndarray) -> None:
        self.tokenizer, self.ends = tokenizer, ends
        self.numbers: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def encode(self, pieces: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each piece's number of them. Words (letters alone) are one pre-token each, so they are encoded many at a time."""
        if words and pieces:
            groups = [" ".join(pieces[at : at + 200]) for at in range(0, len(pieces), 200)]
            flat, _ = _flat([e.ids for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)])
            stops = np.flatnonzero(self.ends[flat]) + 1
            if len(stops) == len(pieces) and stops[-1] == len(flat):
                return flat, np.diff(stops, prepend=0)
        parts = [_flat([e.ids for e in self.tokenizer.encode_batch_fast(pieces[at : at + 5_000], add_special_tokens=False)]) for at in range(0, len(pieces), 5_000)]
        return (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, ("<u4", np.int64)[k]) for k in (0, 1))

    def look_up(self, pieces: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids that are needed, and for each piece where its own begin and how many they are."""
        names = _strings(pieces)
        at = np.fromiter(map(self.numbers.get, names, repeat(-1)), np.int64, len(names))
        ids, sizes = [self.ids], [self.sizes]
        held = len(self.sizes)
        new_names: list[str] = []
        for kind in (True, False):
            new = np.flatnonzero((at < 0) & (words == kind))
            part = [names[k] for k in new]
            got, size = self.encode(part, kind)
            at[new] = held + len(new_names) + np.arange(len(new))
            new_names += part
            ids.append(got)
            sizes.append(size)
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        if held < REMEMBERED:
            self.numbers.update(zip(new_names, range(held, held + len(new_names)), strict=True))
            self.ids, self.sizes = ids, sizes
        first = np.cumsum(sizes) - sizes
        return ids, first[at], sizes[at]


def word_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from a string column to all ids (uint32) and each text's first id, for the tokenizer file at `path`.

    A tokenizer that never merges over white space has each white-space separated piece encoded once and remembered. There,
    a piece of letters with trailing ASCII punctuation is two pre-tokens: the letters, the rest. Any other tokenizer
    encodes texts whole.
    """
    from tokenizers import Tokenizer

    if path in _encoders:
        return _encoders[path]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(tokenizer.to_str())
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
    known = _Pieces(tokenizer, ends)

    def encode_whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = known.encode(_strings(texts), False)
        return ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # \s of the tokenizer holds these four and more; a piece with another white space in it is encoded whole
        split = pc.split_pattern_regex(texts, r"[ \t\n\r]+") if _odd_space(texts) else pc.ascii_split_whitespace(texts)
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        offsets = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        n = len(words.dictionary)
        # a special token's string counts in its own case only; what NFC may change goes to the tokenizer as it stands
        whole = pc.match_substring_regex(words.dictionary, WHOLE_PIECE)
        lower = pc.if_else(pc.or_(whole, pc.match_substring(words.dictionary, "<|")), words.dictionary, pc.ascii_lower(words.dictionary))
        core = pc.ascii_rtrim(lower, PUNCTUATION)
        letters = pc.and_(pc.utf8_is_alpha(core), pc.invert(whole))
        core = pc.if_else(letters, core, lower)
        cut = np.flatnonzero(pc.not_equal(core, lower).to_numpy(zero_copy_only=False))
        tails = np.full(n, "", object)
        tails[cut] = [x[k:] for x, k in zip(_strings(lower.take(cut)), pc.utf8_length(core.take(cut)).to_numpy(), strict=True)]
        tail = pa.array(tails, pa.string())
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        alone = np.zeros(len(both.dictionary), bool)
        place = both.indices.to_numpy()
        alone[place[:n][letters.to_numpy(zero_copy_only=False)]] = True
        flat, begin, lengths = known.look_up(both.dictionary, alone)
        code = words.indices.to_numpy()
        pair = np.empty((len(code), 2), np.int64)
        if len(code):
            pair[:, 0], pair[:, 1] = place[:n][code], place[n:][code]
        pair = pair.reshape(-1)
        size = lengths[pair]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = flat[np.repeat(begin[pair] - (ends - size), size) + np.arange(total)]
        word_end = np.concatenate([[0], ends[1::2]]).astype(np.int64)
        return out, word_end[offsets - offsets[0]]

    _encoders[path] = encode if _splits(spec) else encode_whole
    return _encoders[path]


def _odd_space(texts: pa.Array) -> bool:
    """Whether ASCII white space beyond blank, tab and line ends occurs."""
    return bool(pc.any(pc.match_substring_regex(texts, "[\x0b\x0c\x1c-\x1f\x85]")).as_py())


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """doc_id and `ids`: the text's ids and the end id, as little-endian 16-bit (or, for larger ids, 32-bit) integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        for batch in batches:
            column = batch.column(1).fill_null("")
            for row, end, _, _ in common.text_passes(column):
                ids, first = encode(column.slice(row, end - row))
                n = end - row
                at = first[1:] + np.arange(n)
                out = np.empty(len(ids) + n, "<u4")
                keep = np.ones(len(out), bool)
                keep[at] = False
                out[keep], out[at] = ids, end_id
                ends = (at + 1).astype(np.int64)
                wide = len(out) and out.max() > 0xFFFF
                out = out if wide else out.astype("<u2")
                size = out.itemsize
                offsets = (np.concatenate([[0], ends]) * size).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), data, pa.array(np.full(n, size, np.int8))], ["doc_id", "ids", "width"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, width byte")


def _widen(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if width == 2 else "<u4").astype(np.int64)


# ---- the shared table


def count_ids(tokens: DataFrame) -> DataFrame:
    """id and n: how often each id stands in the whole corpus. Each task sends one row for an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            widths = batch.column(1).to_numpy()
            for width in np.unique(widths):
                got = np.bincount(_widen(b"".join(batch.column(0).filter(pa.array(widths == width)).to_numpy(zero_copy_only=False)), width))
                if len(got) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(got) - len(counts), np.int64)])
                counts[: len(got)] += got
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], ["id", "n"])

    return tokens.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def scaled_table(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts as frequencies that sum to 2 ** bits; an id that occurs has 1 at least."""
    total, target = int(counts.sum()), 1 << bits
    if total == 0:
        return np.zeros(len(counts), np.int64)
    there = counts > 0
    if int(there.sum()) > target:
        raise ValueError(f"{int(there.sum())} different ids do not fit a table of 2 ** {bits}")
    freq = np.where(there, np.maximum(1, counts * (target / total)).astype(np.int64), 0)
    order = np.argsort(-freq, kind="stable")
    excess = int(freq.sum()) - target
    if excess < 0:
        freq[order[0]] -= excess
    for i in order:
        if excess <= 0:
            break
        take = min(excess, int(freq[i]) - 1)
        freq[i] -= take
        excess -= take
    return freq


# ---- blocks


def encode_block(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> bytes:
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    padded = np.zeros(steps * lanes, np.int64)
    padded[:n] = ids
    active_last = n - (steps - 1) * lanes
    grid = padded.reshape(steps, lanes)
    f_all, c_all = freq[grid].astype(np.uint64), cum[grid].astype(np.uint64)
    state = np.full(lanes, LOW, np.uint64)
    shift, words, points = np.uint64(63 - SCALE_BITS), [], []
    down, bits = np.uint64(32), np.uint64(SCALE_BITS)
    count = 0
    for t in range(steps - 1, -1, -1):
        k = active_last if t == steps - 1 else lanes
        x, f = state[:k], f_all[t, :k]
        full = x >= (f << shift)
        out = x[full]
        if len(out):
            words.append(out.astype("<u4"))
            count += len(out)
            x[full] = out >> down
        q = x // f
        state[:k] = (q << bits) + (x - q * f) + c_all[t, :k]
        if t and t % CHECKPOINT_STEPS == 0:
            points.append((t, count, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    no_id = np.array([d is None for d in doc_ids], np.uint8)
    body = b"".join(
        [
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            no_id.tobytes(),
            lengths.astype("<u4").tobytes(),
            state.astype("<u8").tobytes(),
            *(np.array([t, count - c], "<u4").tobytes() + s.astype("<u8").tobytes() for t, c, s in points[::-1]),
            stream.tobytes(),
        ]
    )
    crc_ids = zlib.crc32(ids.astype("<u4").tobytes())
    return np.array([MAGIC, len(doc_ids), n, lanes, len(points), len(stream), crc_ids, zlib.crc32(body)], "<u4").tobytes() + body


def decode_block(data: bytes, freq: np.ndarray, cum: np.ndarray, slots: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a block. The stretches between checkpoints are decoded side by side."""
    magic, n_docs, n, lanes, n_points, n_words, crc_ids, crc_body = (int(x) for x in np.frombuffer(data, "<u4", 8))
    body = data[32:]
    if magic != MAGIC or zlib.crc32(body) != crc_body:
        raise ValueError("damaged block")
    at = 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, no_id, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    states, begins, pointers = [take("<u8", lanes)], [0], [0]
    for _ in range(n_points):
        t, pointer = (int(x) for x in take("<u4", 2))
        begins.append(t)
        pointers.append(pointer)
        states.append(take("<u8", lanes))
    words = take("<u4", n_words).astype(np.uint64)
    steps = -(-n // lanes)
    active_last = n - (steps - 1) * lanes
    parts = len(begins)
    ends = [*begins[1:], steps]
    state = np.stack(states).astype(np.uint64)
    pointer = np.array(pointers, np.int64)
    out = np.zeros((steps, lanes), np.int64)
    mask, bits, down = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    for r in range(max(e - b for b, e in zip(begins, ends, strict=True))):
        live = [p for p in range(parts) if begins[p] + r < ends[p]]
        x = state if len(live) == parts else state[live]
        slot = x & mask
        sym = slots[slot]
        x = freq[sym] * (x >> bits) + slot - cum[sym]
        low = x < LOW
        rows = [begins[p] + r for p in live]
        if rows[-1] == steps - 1:
            low[-1, active_last:] = False
        need = low.sum(1)
        where = np.repeat(pointer[live] - (np.cumsum(need) - need), need) + np.arange(int(need.sum()))
        x[low] = (x[low] << down) | words[where]
        pointer[live] += need
        if rows[-1] == steps - 1:
            x[-1, active_last:] = state[live[-1], active_last:]
        state[live] = x
        out[rows] = sym
    ids = out.reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc_ids or (n and not (state[-1] == LOW).all()):
        raise ValueError("a block's ids do not match their checksum")
    return [None if z else int(d) for d, z in zip(doc_ids, no_id, strict=True)], lengths, ids


# ---- the archive


def write_archive(tokens: DataFrame, folder: str) -> None:
    """Write the token table (see token_ids, already stored) as an archive into `folder`."""
    spark = tokens.sparkSession
    rows = count_ids(tokens).toPandas()  # one row for an id of the vocabulary at most
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    freq = scaled_table(counts)
    ids = np.flatnonzero(freq)
    spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "freq": pa.array(freq[ids], pa.int64())})).coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq)  # 8 bytes for an id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        cum = np.concatenate([[0], np.cumsum(freq)])[:-1]
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            lengths = np.array([len(p) for p in parts], np.int64)
            data = encode_block(np.concatenate(parts), docs, lengths, freq, cum)
            row = [shard, block, start, len(docs), int(lengths.sum()), data]
            block, start, held = block + 1, start + int(lengths.sum()), 0
            docs.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["shard", "block", "start", "n_docs", "n_ids", "data"])

        for batch in batches:
            for d, data, width in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_numpy(), strict=True):
                ids = _widen(data.as_buffer(), width)
                docs.append(d)
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield flush()
        if docs:
            yield flush()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // SHARD_IDS))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    (
        tokens.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order, "ids")
        .mapInArrow(run, "shard long, block long, start long, n_docs long, n_ids long, data binary")
        .write.parquet(f"{folder}/blocks")
    )


def read_archive(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (with_ids) ids as little-endian 32-bit integers, of every document of an archive."""
    stored = spark.read.parquet(f"{folder}/table").toPandas()  # the vocabulary's table
    freq = np.zeros(int(stored["id"].max()) + 1 if len(stored) else 1, np.int64)
    freq[stored["id"].to_numpy(np.int64)] = stored["freq"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(freq)
    names = ["ids"] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value.astype(np.uint64)
        cum = np.concatenate([[np.uint64(0)], np.cumsum(freq)])[:-1].astype(np.uint64)
        slots = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))
        for batch in batches:
            for shard, start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs, lengths, ids = decode_block(data.as_buffer().to_pybytes(), freq, cum, slots)
                ends = np.cumsum(lengths.astype(np.int64))
                raw = [ids[e - n : e].tobytes() for n, e in zip(lengths.astype(np.int64), ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(docs), pa.int64()),
                        pa.array(docs, pa.int64()),
                        pa.array(start + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                        *([pa.array(raw, pa.binary())] if with_ids else []),
                    ],
                    ["shard", "doc_id", "at", "n_tokens", "ids_crc32", *names],
                )

    blocks = spark.read.parquet(f"{folder}/blocks")
    docs = blocks.select("shard", "start", "data").mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    # one row for a shard, and so for a task of the writer
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *names)


def token_archive(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """Encode every text of docs (doc_id, text), write the archive and read its documents back."""
    spark = docs.sparkSession
    folder = folder or common.new_folder(spark, "tokens")
    tokens = common.stored(token_ids(docs, tokenizer, end_id), "ids")
    write_archive(tokens, folder)
    return read_archive(spark, folder, with_ids)
