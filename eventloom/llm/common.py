"""Helpers shared by the training-data operators: tables, written intermediates, Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that spark.checkpoint.dir names.

    Where none is named, a session in one process (local mode) gets a temporary one, which is then set for it; on a cluster that is
    an error, as executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="eventloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/eventloom-{uuid.uuid4().hex}"


#: paths of tables written while a scratch() is open, innermost last
_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialise() writes inside go at the end: for a job whose result is written elsewhere by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def registered(spark: SparkSession) -> str:
    """A new shared folder that goes with the scratch() that is open, if one is."""
    path = shared_dir(spark)
    if _scratch:
        _scratch[-1].append(path)
    return path


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts the lineage.

    The shuffle files of the job go as soon as its table is written: a lost executor then costs nothing, as the
    table is what later jobs read.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    if _scratch:
        _scratch[-1].append(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a batch needs in Python stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _release() -> None:
    """Give memory that the allocators hold back to the system: Python workers live on, and their peaks would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with small Arrow batches and with its memory released at the end of each task.

    Texts may be long, so the session's Arrow batches are cut to 1000 rows, and stay so: the plan reads that setting when it runs.
    """
    spark = SparkSession.getActiveSession()
    if spark and int(spark.conf.get(BATCH_ROWS)) > 1000:
        spark.conf.set(BATCH_ROWS, "1000")

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()

    return tidied


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 1024) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            yield work(batch)

    return df.mapInArrow(tidy(run), schema)


def bucket_of(doc_id: str, parts: int):
    """crc32 of an id as text, modulo parts: the split into folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts
