"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.plans.tables import dropped, folder, fresh, scope, written  # noqa: F401


#: A key that more than one in so many rows has is joined by broadcast: there are fewer than so many of them.
HOT_KEYS = 1000


def joined_by_key(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows with the columns of table, which has one row for each key; rows whose key it lacks get nulls.

    weight: table's column that counts a key's rows. Rows of a frequent key stay where they are, so a key with a
    third of all rows is no single task's. table is written: it is read several times.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where(F.col(weight) * HOT_KEYS > total)
    often = rows.join(F.broadcast(hot.drop(weight)), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.drop(weight), key, "left")
    return often.unionByName(rest)


#: Bytes of a batch of rows on its way to a worker, unless the session says something else.
ARROW_BYTES = 4 << 20
_BYTES, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function whose worker gives freed memory back when its task ends: workers live on, and so would the memory.

    Rows reach it in batches of bounded bytes: texts have any length, so a count of rows bounds nothing.
    """
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get(_BYTES, _DEFAULT) == _DEFAULT:
        session.conf.set(_BYTES, str(ARROW_BYTES))

    @wraps(run)
    def tidied(found: Iterator) -> Iterator:
        try:
            yield from run(found)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied
