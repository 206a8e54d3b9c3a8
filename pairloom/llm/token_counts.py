"""Token counts: lengths only, from Arrow functions, with batches balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import shared, tokens


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; no special tokens are added, nothing is cut off.

    Null and empty texts have 0 bytes and 0 tokens. Ids may be null or repeated: each row gives a row.
    Texts beyond a batch's bytes are cut at safe spaces, which no token crosses, and their counts added.
    Nothing is shuffled; a worker holds one batch and the pieces that it remembers.
    """
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in batches:
            t = pc.fill_null(b.column(1), "")
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(t).cast(pa.int64()), pa.array(enc.counts(t))], names=[id_col, "n_bytes", "n_tokens"])

    return df.select(id_col, text).mapInArrow(shared.frugal(run), f"`{id_col}` {kind.simpleString()}, n_bytes long, n_tokens long")
