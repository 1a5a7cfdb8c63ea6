"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Where intermediate tables go when the session names no shared folder (local master only), by application.
_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary folder on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="semlake-")
    return _own_roots[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/semlake/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage and avoids recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._semlake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that no later plan reads."""
    path = getattr(df, "_semlake_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def respread(df: DataFrame) -> DataFrame:
    """Round-robin exchange over an aggregated side, so that a join above it sees two plain shuffles and AQE may
    split hot partitions (it can't when the aggregate's own exchange feeds the join)."""
    return df.repartition(shuffle_width(df.sparkSession))


#: Bytes of an Arrow batch, about: documents can be long, and a Python worker holds a batch whole.
BATCH_BYTES = 8 << 20
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; every operator asks for the same bound, so plans built earlier keep theirs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_text_columns(df: DataFrame, make: Callable[[], Callable[[list], Sequence]], new: dict[str, str], text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with new columns, ``name -> type``, made of its texts in Arrow batches.

    ``make`` gives a function of a batch's texts for each task, which returns a sequence of values for each column.  All
    other columns pass as they are; one named like a new column is replaced.
    """
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in new and (keep_text or c != text)]
    chosen = df.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = StructType([f for f in chosen.schema if f.name != "__text"])
    for name, kind in new.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            made = of(b.column(len(kept)).to_pylist())
            columns = [b.column(i) for i in range(len(kept))] + [pa.array(v, _ARROW[k]) for v, k in zip(made, new.values())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return chosen.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the column as text, modulo n: the fold of a row."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))
