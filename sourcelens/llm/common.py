"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that a written table's job hands to Python; a buffer of these stands in both processes of every task.
ARROW_BYTES = "8m"
#: The white space that separates words, in code-point order.
SPACE = "\t\n\x0b\x0c\r "

_open: ContextVar[Tables | None] = ContextVar("open_tables", default=None)
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, path: str):
    """A folder and its file system, in the driver's JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver's JVM ends, if nothing has deleted it before."""
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="shared-"))
            delete_at_exit(spark, _own_dir[0])
        found = _own_dir[0]
    return found.rstrip("/")


class Tables:
    """The tables that one run writes for itself; release() deletes these and no others."""

    def __init__(self) -> None:
        self.held: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Tables:
        self._outer = _open.set(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _open.reset(self._outer)
        if kind:
            self.release()

    def add(self, spark: SparkSession, path: str) -> None:
        self.held.append((spark, path))

    def drop(self, path: str) -> None:
        for item in [x for x in self.held if x[1] == path]:
            delete(*item)
            self.held.remove(item)

    def release(self) -> None:
        while self.held:
            delete(*self.held.pop())


def tracked(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, whose result carries the tables it is read from; release(result) deletes them.

    Tables of nested calls belong to the outermost one.
    """

    @functools.wraps(f)
    def run(*args, **named) -> DataFrame:
        if _open.get() is not None:
            return f(*args, **named)
        with Tables() as own:
            out = f(*args, **named)
        out._tables = own
        return out

    return run


def release(df: DataFrame) -> None:
    """Delete the tables that a result of a tracked() function is read from; call it once its readers are done."""
    df._tables.release()


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session option for the time of a block."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, owner: Tables | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again; the shuffle files of the job go when it ends.

    Cuts the lineage so that a lost executor costs the lost tasks only, and
    lets several consumers share one computation. The table belongs to owner, or
    the open Tables; whatever is left of it goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    owner = owner or _open.get()
    if owner is not None:
        owner.add(spark, path)
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path, out._owner = path, owner
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of written() that no later step reads."""
    if df._owner is not None:
        df._owner.drop(df._written_path)
    else:
        delete(df.sparkSession, df._written_path)


def let(value: Column, body) -> Column:
    """body(x) with x bound to value once, where a lambda would compute value again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, [^\\x20\\x09-\\x0D]+, as an array; null has none."""
    trimmed = F.btrim(text_or_empty(text), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x09-\\x0D\\x20]+"))


def word_count(text: Column) -> Column:
    """How many words() a text has."""
    trimmed = F.btrim(text_or_empty(text), F.lit(SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x09-\\x0D\\x20]+"))).cast("long")
