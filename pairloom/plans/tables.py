"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The paths of the tables that the open scopes' operators have written.
_scopes: list[list[str]] = []
#: The folder of each local application that names none.
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, as in tests, a folder of its own. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = "file://" + tempfile.mkdtemp(prefix="pairloom-")
        found = _own[application]
    return found.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, kept: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: later stages read it, whatever executors are lost. kept: beyond the open ``scope``."""
    spark = df.sparkSession
    path = fresh(spark, label)
    if _scopes and not kept:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _deleted(df.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were written within it. What is made of them must be written ``kept``, or used up, by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _deleted(spark, path)
