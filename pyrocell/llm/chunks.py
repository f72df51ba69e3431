"""Chunks of whole rows, and the exchange of packed keys between chunks and buckets.

Operators that look every word run of a corpus up in every other text would shuffle a row for each word. Here a
chunk (whole rows, about CHUNK bytes of text, one row of a table) sends each bucket its distinct keys as one
packed array, and gets one packed answer back. A key that a third of all rows share costs a chunk one entry,
so no group is hot, and numpy does the work on a chunk's or bucket's arrays at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CHUNK, BUCKET = 4 << 20, 8 << 20


def bucket_count(df: DataFrame, size: int = 0) -> int:
    """Buckets for chunks of size bytes: a bucket's share is bounded whatever the session shuffles to, and every core
    has one."""
    return max(1, df.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET))


def to_ipc(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(rows)
    return out.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Runs of consecutive rows of about size bytes; one row at least."""
    held, held_bytes = [], 0
    for batch in batches:
        at = 0
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        while at < batch.num_rows:
            n = max(1, min(batch.num_rows - at, (size - held_bytes) // per_row))
            part = batch.slice(at, n)
            at += n
            held.append(part)
            held_bytes += n * per_row
            if held_bytes >= size:
                yield pa.Table.from_batches(held)
                held, held_bytes = [], 0
    if held:
        yield pa.Table.from_batches(held)


def ranged(df: DataFrame, order_by: str) -> DataFrame:
    """The rows range-partitioned and sorted by a column, nulls first."""
    n = max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(n, order_by).sortWithinPartitions(order_by)


def chunked(df: DataFrame, order_by: str | None = None, size: int = CHUNK) -> DataFrame:
    """(chunk, rows, payload): payload is the rows as a compressed Arrow stream. With order_by the rows are
    range-partitioned and sorted by it, nulls first, and chunk numbers ascend with it."""
    if order_by:
        df = ranged(df, order_by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        for k, rows in enumerate(cut(batches, size)):
            whole = rows.combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([pa.array([first + k], pa.int64()), pa.array([whole.num_rows], pa.int64()), pa.array([to_ipc(whole)], pa.binary())], ["chunk", "rows", "payload"])

    return df.mapInArrow(run, "chunk bigint, rows bigint, payload binary")
