"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


#: Bytes of an Arrow batch, about, for all operators of the engine: texts can be long.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def folder(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``; on a local master without that setting, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="semlake-"))
    return f"{root.rstrip('/')}/engine/{label}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a statement go with its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files: what they wrote is read from its table, never from their exchanges."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table and read back: cuts lineage, and later reads don't compute it again."""
    path = folder(df.sparkSession, label)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """The files of tables that ``stored`` gave are deleted; what reads them must be through."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
