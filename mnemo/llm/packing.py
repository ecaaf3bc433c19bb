"""Packing: documents are cut into pieces whose lengths are powers of two, and pieces of one length make one bucket.

A document of n tokens gives n // most pieces of `most` tokens (itself a power of two), then one piece for each binary digit
of the rest, the largest first. Each piece is a sequence of its own, so no sequence crosses documents and none is padded.
Batches of one bucket have one shape.

Pieces are cut where texts are encoded; no row is shuffled, and a document of any length leaves as pieces one after the
other. A sequence's number is made of its bucket, the task that wrote it and its place there, so it needs no count over all
tasks; within a bucket, numbers ascend. The result is a folder of Parquet files, one subfolder for each length.

Defined cases: a null text is empty, and an empty text is the end id alone, a sequence of one token. Every row is kept;
repeated rows and rows without a doc_id give their own pieces. A very long text is encoded as one row. An empty table makes
an empty folder with the table's columns. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

LONGEST = 2048
#: Of a sequence's number: bits of its place in the task's bucket, and of the task.
PLACE_BITS, TASK_BITS = 30, 28
#: Bytes of ids that leave a task in one batch.
BATCH_BYTES = 8 << 20
SCHEMA = "sequence_id long, length long, doc_id long, start long, doc_tokens long, ids binary, width byte"


def piece_lengths(n: int, longest: int = LONGEST) -> np.ndarray:
    """Lengths of the pieces of n tokens, the largest first."""
    rest = n % longest
    return np.array([longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = LONGEST) -> DataFrame:
    """One row for a piece: sequence_id, length, doc_id, start (ids of its document before it), doc_tokens, ids, width (bytes of an id)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence is no power of two")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.int8()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        if task >> TASK_BITS:
            raise ValueError("more tasks than a sequence's number has room for")
        written = np.zeros(longest.bit_length(), np.int64)
        rows: list[list] = [[] for _ in names]
        held = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)
            for c in rows:
                c.clear()
            return out

        for batch in batches:
            for doc_id, ids, width in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = ids.as_buffer().to_pybytes()
                n = len(data) // width
                start = 0
                for length in piece_lengths(n, longest).tolist():
                    bucket = length.bit_length() - 1
                    number = (bucket << TASK_BITS | task) << PLACE_BITS | int(written[bucket])
                    written[bucket] += 1
                    for column, value in zip(rows, (number, length, doc_id, start, n, data[start * width : (start + length) * width], width), strict=True):
                        column.append(value)
                    start += length
                    held += length * width
                    if held >= BATCH_BYTES:
                        yield flush()
                        held = 0
        if rows[0]:
            yield flush()

    return tokens.token_ids(docs, tokenizer, end_id).mapInArrow(run, SCHEMA)


def write_packed(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, longest: int = LONGEST) -> None:
    """Write the pieces of all documents into `folder`, one subfolder for each length."""
    pieces(docs, tokenizer, end_id, longest).withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(folder)


def read_packed(docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of a folder; `docs` gives the session."""
    return docs.sparkSession.read.schema(SCHEMA + ", bucket long").parquet(folder).drop("bucket")


def with_checksum(packed: DataFrame) -> DataFrame:
    """Pieces with `ids_crc32`, of their ids as little-endian unsigned 32-bit integers."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for ids, width in zip(batch["ids"], batch["width"].to_pylist(), strict=True):
                data = ids.as_buffer()
                sums.append(zlib.crc32(data if width == 4 else np.frombuffer(data, "<u2").astype("<u4")))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(sums, pa.int64())], [*kept, "ids_crc32"])

    kept = ["sequence_id", "length", "doc_id", "start", "doc_tokens"]
    return packed.select(*kept, "ids", "width").mapInArrow(run, ", ".join(f"{c} long" for c in [*kept, "ids_crc32"]))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = LONGEST, folder: str | None = None) -> DataFrame:
    """Write the pieces and read them back: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    folder = folder or common.new_folder(docs.sparkSession, "packed")
    write_packed(docs, tokenizer, folder, end_id, longest)
    found = with_checksum(read_packed(docs, folder))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
