"""What the operators of this subpackage share: input tables, the shared folder, small SQL helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, one
    machine) a folder is made here and becomes the session's checkpoint folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_RECORDS: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _RECORDS:
        made.append(path)
    return path


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are given out meanwhile."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it again: cuts the lineage, outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound(expr: Column, use) -> Column:
    """``use(x)`` with ``x`` bound to the value of ``expr``, evaluated once even inside lambdas."""
    return F.transform(F.array(expr), use)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def join_small(left: DataFrame, right: DataFrame, on: Column, how: str, rows: int, limit: int = 100_000) -> DataFrame:
    """Broadcasts ``right`` only if its counted ``rows`` are at most ``limit``; else both sides are shuffled."""
    return left.join(F.broadcast(right) if rows <= limit else right.hint("merge"), on, how)


_HELD: dict[str, dict] = {}


def held(operator: str) -> dict:
    """What a Python worker keeps between the tasks of an operator. Spark uses workers again, so what another operator
    kept in this one goes, or its memory would be missing for as long as the worker lives."""
    others = [x for x in _HELD if x != operator]
    for x in others:
        _HELD.pop(x).clear()
    if others:
        trimmed()
    return _HELD.setdefault(operator, {})


def trimmed() -> None:
    """Gives memory that this process has freed back to the machine, which the allocators would keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of rows that Spark sends to a Python worker at a time, 64 MB by itself. JVM and worker both hold a batch, outside the
#: JVM's heap, for each task.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's bytes of a batch, unless it has a value. No operator's results depend on how rows are batched."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH)
