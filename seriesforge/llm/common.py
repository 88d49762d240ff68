"""Shared helpers: reading tables, cutting lineage, Arrow batches of bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of a batch that a function works on at once; a longer row is a batch of its own.
BATCH_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one in the warehouse, unless that is a local folder on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), spark.sparkContext.master
    if warehouse.startswith(("file:", "/")) and master != "local" and not master.startswith(("local[", "local-")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_stash"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the running tasks, not the rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete the files of tables that ``stash`` wrote, when all that reads them is written itself."""
    for df in stashed:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_batches(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of a few megabytes.

    Spark's default of 64 MB a batch, held by the JVM and the worker of each
    task, is too much beside their other memory. The session's bound on bytes
    is lowered for that (rows are not bounded: batches of small rows stay as
    they are); a lower one is left.
    """
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, "64m")
    if not now.isdigit() or int(now) > 2 * BATCH_BYTES:
        conf.set(name, str(2 * BATCH_BYTES))
    return df.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes, without copies.

    The Python forms of texts are several times as large as their bytes.
    """
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
