"""Tables that several parts of a job read, written once to the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The names of the tables staged in the innermost scope of this thread.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a session whose tasks all run in
    the driver's process gets one of its own; a cluster must name one, as a folder of one machine
    would be lost with it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, tag: str, *partitions: str) -> DataFrame:
    """The rows, written to the shared folder and read back: the lineage ends at files that outlive any
    executor, and a result used twice is computed once. ``partitions``: columns that become folders."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    if (made := _scope.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def exchanged(df: DataFrame) -> DataFrame:
    """The rows, which grow with the input, for a join that exchanges both sides. What Spark broadcasts for
    being small as a file passes through the driver, many times larger in its memory."""
    return df.hint("merge")


def release(spark: SparkSession, names: Iterable[str]) -> None:
    """Delete tables by name, once nothing reads them any more."""
    for path in names:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession, keep: int = 1) -> Iterator[list[str]]:
    """The names of the tables that this thread stages inside. At the end the last ``keep``, the result,
    pass to the enclosing scope, and the others are deleted; names taken out of the list stay."""
    outer, made = _scope.get(), []
    token = _scope.set(made)
    try:
        yield made
    except BaseException:
        release(spark, made)
        raise
    finally:
        _scope.reset(token)
    cut = max(len(made) - keep, 0)
    release(spark, made[:cut])
    if outer is not None:
        outer.extend(made[cut:])


def release_all_but_last(spark: SparkSession, made: list[str], keep: int = 1) -> None:
    """In a loop whose every round reads only the last tables of the round before."""
    release(spark, made[:-keep])
    del made[:-keep]
