"""Rows packed into batches of bounded bytes, written once: later stages address a row as (batch, place)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from . import shared

BATCH_TEXT = 4 << 20


def packed(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_array(a: np.ndarray, delta: bool = False) -> bytes:
    """An array of whole numbers; delta: as differences, which pack well where it rises slowly."""
    return packed(np.diff(a, prepend=a.dtype.type(0)).astype(a.dtype).tobytes() if delta else np.ascontiguousarray(a).tobytes())


def unpack_array(data: bytes, dtype: str, delta: bool = False) -> np.ndarray:
    a = np.frombuffer(unpacked(data), dtype)
    return np.cumsum(a, dtype=a.dtype) if delta else a


def _ipc(batch: pa.RecordBatch) -> pa.Buffer:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue()


def rows_of(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(unpacked(data)).read_all().combine_chunks()
    if table.num_rows == 0:
        return pa.RecordBatch.from_pylist([], schema=table.schema)
    return table.to_batches()[0]


def batched(df: DataFrame, text: str, label: str, limit: int = BATCH_TEXT) -> DataFrame:
    """(batch, rows): the rows of df in Arrow streams of about ``limit`` bytes of text each, as a table in the shared folder.

    A longer text stands alone. The table is what later stages read, so a batch's number and its rows'
    places hold whatever executors are lost.
    """
    at = df.columns.index(text)
    schema = to_arrow_schema(df.schema)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            number = (task << 24) + seq
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([packed(_ipc(table.to_batches()[0]), 3)], pa.binary())], names=["batch", "rows"])

        for b in found:
            b = pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(b.columns, schema, strict=True)], schema=schema)
            sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
            start = 0
            for i, n in enumerate(sizes.tolist()):
                if size and size + n > limit:
                    if i > start:
                        held.append(b.slice(start, i - start))
                    yield flush()
                    held, size, start, seq = [], 0, i, seq + 1
                size += n + 16
            if start < b.num_rows:
                held.append(b.slice(start))
        if held:
            yield flush()

    return shared.written(df.mapInArrow(shared.frugal(run), "batch long, rows binary"), label)


def text_bytes(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one array of bytes, and their offsets; a null text is empty."""
    texts = pc.fill_null(batch.column(at), "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
