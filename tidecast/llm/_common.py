"""Shared helpers of the training-data operators: scratch tables and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver see, from ``spark.checkpoint.dir``.

    Only a session in one process (``local``) may name none: a temporary folder is
    then made and set as the context's checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        own = tempfile.mkdtemp(prefix="tidecast-scratch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(f"file://{own}")
    return context.getCheckpointDir().rstrip("/")


#: Folders made in this process and not deleted yet.
_SCRATCH: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tidecast/{label}-{uuid.uuid4().hex}"
    _SCRATCH.add(path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` cut from its lineage: written once to the shared folder and read again.

    What the write has shuffled is not read again, so Spark may delete it at once.
    """
    conf, path = df.sparkSession.conf, scratch_path(df.sparkSession, label)
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _SCRATCH.discard(path)


def drop(*tables: DataFrame) -> None:
    """Delete ``written`` tables of which nothing is read any more."""
    for t in tables:
        _delete(t.sparkSession, t.scratch)


def clear_scratch(docs: DataFrame) -> None:
    """Delete what earlier operators of this process left, but for tables that ``docs`` still reads."""
    names = {p.rsplit("/", 1)[1]: p for p in _SCRATCH}
    read = {part for f in docs.inputFiles() for part in f.split("/")} if names else set()
    for name, path in names.items():
        if name not in read:
            _delete(docs.sparkSession, path)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Rows here hold whole texts: batches to Python workers of some megabytes, unless the session has set a size."""
    if spark.conf.get(_BATCH_BYTES, None) in (None, "64MB", "67108864b", "67108864"):
        spark.conf.set(_BATCH_BYTES, size)


def give_back() -> None:
    """Free memory of this Python worker goes back to the system; a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over the batches of a task, after which its memory is given back."""

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def map_rows(
    df: DataFrame,
    schema: T.StructType | str,
    work: Callable[[dict[str, list]], dict[str, list]],
) -> DataFrame:
    """``mapInArrow`` on plain lists: ``work`` gets and returns one list per column."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                out = work({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in ((out[f.name], f) for f in arrow)],
                    schema=arrow,
                )

    return df.mapInArrow(batches, kind)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bucket_count(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session says."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
