"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass takes; a longer text makes a pass of its own.
PASS_BYTES = 4 << 20

_PRIME = 0x100000001B3
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    A local session without one gets a temporary folder; on a cluster that folder would not be shared, so one must be set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mnemo-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that later scans prune columns."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_passes(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column of about `limit` bytes: first row, end row, UTF-8 bytes, row offsets into them.

    Null counts as the empty text. A text longer than `limit` is a slice of its own, never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n + (1 << 16), 2 * len(_powers))
        with np.errstate(over="ignore"):
            for name, base in (("_powers", _PRIME), ("_inverses", pow(_PRIME, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                globals()[name] = np.multiply.accumulate(steps)
    return _powers, _inverses


_byte = np.arange(256)
#: Bytes of words: digits, letters, everything beyond ASCII; upper case of ASCII counts as lower case.
WORD_BYTE = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
LOWER_BYTE = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts, in order, and each text's first word.

    Words are runs of ASCII digits and letters (case folded) and of characters beyond ASCII. The second result
    has one entry more than there are texts: text i has words first[i] to first[i + 1].
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    powers, inverses = _power_tables(n + 1)
    inside = WORD_BYTE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((LOWER_BYTE[data] + np.uint64(1)) * powers[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverses[starts]
    return mix(h), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `size` words, in order, and each text's first run.

    A text of fewer words has one run, all its words; a text without words has none.
    """
    n = len(words)
    counts = np.diff(first)
    full = np.maximum(counts - size + 1, 0)
    out_first = np.concatenate([[0], np.cumsum(np.where(counts == 0, 0, np.maximum(full, 1)))])
    with np.errstate(over="ignore"):
        h = np.zeros(max(n - size + 1, 0), np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k] if n >= size else h
        out = np.zeros(out_first[-1], np.uint64)
        where = np.repeat(first[:-1], full) + np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
        out[np.repeat(out_first[:-1], full) + np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)] = h[where]
        for i in np.flatnonzero((counts > 0) & (counts < size)):
            x = np.uint64(counts[i])
            for w in words[first[i] : first[i + 1]]:
                x = x * np.uint64(0x9E3779B97F4A7C15) + w
            out[out_first[i]] = x
    return mix(out), out_first
