"""Tables in the folder that the driver and all executors share, and small SQL expressions used by several operators.

Intermediate tables are Parquet files below ``spark.checkpoint.dir``. They cut the lineage,
so a lost executor only costs the tasks it ran, and they never live on one machine's disk.
"""

from __future__ import annotations

import contextlib
import contextvars
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expressions of the contracts' two kinds of words.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The tables that the innermost tidy() call has written so far.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)
#: With it, Spark removes the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one is set only where it is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "docweave-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/docweave-{name}-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    return path


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back. Its shuffle files go at once, the table at the latest with the driver."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    where, files = _found(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _found(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    where, files = _found(spark, path)
    files.delete(where, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator, after which the tables that it has written and its rows don't read are gone.

    Those behind its rows stay until release(), or until the driver ends.
    """

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        around, own = _written.get(), []
        token = _written.set(own)
        try:
            out = operator(*args, **kwargs)
        finally:
            _written.reset(token)
        behind = {os.path.basename(root) for root in roots(out)}
        for path in own:
            if os.path.basename(path) not in behind:
                remove(out.sparkSession, path)
            elif around is not None:
                around.append(path)
        return out

    return run


def release(df: DataFrame) -> None:
    """Remove the tables of the shared folder that df reads, once its rows have been written or used."""
    for root in roots(df):
        if os.path.basename(root).startswith("docweave-"):
            remove(df.sparkSession, root)


def roots(df: DataFrame) -> list[str]:
    """Folders and files that the plan of df reads."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            paths = leaf.relation().location().rootPaths()
            out += [paths.apply(n).toString() for n in range(paths.size())]
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is (``lower`` itself would change other alphabets)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def row_key(*columns: Column) -> Column:
    """Tells rows apart that share an id but not their text."""
    return F.xxhash64(*columns)
