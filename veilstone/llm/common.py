"""Shared folder, saved tables and table readers used by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset a session on one machine takes a new temporary folder; on a cluster
    that is an error, since executors can't see the driver's folders.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="veilstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths that ``save`` wrote, by the ``passing`` blocks that are open, the innermost last.
_PASSING: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("passing", default=())


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at the end, but for those saved with ``lasting``. Nothing that is still
    to be computed may read them then, so a result must be saved itself."""
    held: list[str] = []
    token = _PASSING.set((*_PASSING.get(), held))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for name in held:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, name: str, codec: str | None = None, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that reads it: it cuts the lineage,
    and a lost executor costs no more than reading it again. ``codec`` is for tables of whole texts, which zstd
    holds in about three quarters of the session's default. A ``lasting`` table outlives the innermost block of
    ``passing``."""
    path = new_path(df.sparkSession, name)
    scopes = _PASSING.get()[: -1 if lasting else None]
    if scopes:
        scopes[-1].append(path)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_for(total: float, per_block: float, most: int) -> int:
    """How many blocks of about ``per_block`` hold ``total``: at least 1, at most ``most``."""
    return max(1, min(most, math.ceil(total / per_block)))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column over the whole table (one narrow aggregate)."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def files(uri: str):
    """(file system, path) of a folder, for any store that Arrow can reach; plain paths are local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def byte_texts(column, part: int = 256):
    """The UTF-8 bytes of each value of an Arrow string column (None for null), a few at a time."""
    import pyarrow as pa

    for i in range(0, len(column), part):
        yield from column.slice(i, part).cast(pa.binary()).to_pylist()


def slices(batch, rows: int = 256):
    """A batch as (first column, UTF-8 bytes of the second), a few rows at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.column(0).slice(i, rows), list(byte_texts(batch.column(1).slice(i, rows)))


_STEADY: list[bool] = []
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3  # fixed values of the C library's mallopt


def steady_heap() -> None:
    """Make a Python worker give back what it frees, once for its life: Arrow takes its buffers from the C
    library, and blocks of 512 kB or more, such as arrays, are mapped for themselves. Workers live on from
    task to task, so what one kind of task leaves behind would add to the next."""
    import pyarrow as pa

    if not _STEADY:
        _STEADY.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        tune = getattr(ctypes.CDLL(None), "mallopt", None)
        if tune:
            tune(M_MMAP_THRESHOLD, 512 * 1024)
            tune(M_TRIM_THRESHOLD, 1024 * 1024)


def release_memory() -> None:
    """Give memory that a task has freed back to the system: what lies free in the middle of the C library's
    heap, where it has a call for it."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
