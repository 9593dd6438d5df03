"""What the corpus operators share: input columns, folds, tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text``: other columns, whatever their names, never reach an operator."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` whole texts, so that a Python worker's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which a Python worker gives back what it has freed: it lives on, idle, beside the stages that follow."""

    def whole(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where none is named, a local one, if Spark itself is local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sylva-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


#: Folders of stored tables and how to delete each; what no operator has deleted before goes when the driver ends.
LEFT: dict[str, object] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sylva_path = path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    LEFT[path] = (where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of ``stored`` tables that no plan needs any more."""
    for df in tables:
        fs, where = LEFT.pop(getattr(df, "_sylva_path", None), (None, None))
        if fs is not None:
            fs.delete(where, True)


@atexit.register
def forget_all() -> None:
    """Tables that results still stood on."""
    for fs, where in LEFT.values():
        with contextlib.suppress(Exception):  # the JVM may have ended
            fs.delete(where, True)
    LEFT.clear()
