"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; on a cluster that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_lexquarry_shared", None)
    if found:
        return found
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context._lexquarry_shared = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return context._lexquarry_shared


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: made once however often it is used, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/lexquarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def in_one_step(spark: SparkSession, path: str, mode: str = "errorifexists") -> Iterator[str]:
    """A folder to write several tables to, which takes the place of path when all are written. If the writing stops, what
    stood at path stands there still."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if mode == "errorifexists" and files.exists(place(path)):
        raise FileExistsError(f"{path} exists already")
    stem = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        yield f"{stem}.new"
    except BaseException:
        files.delete(place(f"{stem}.new"), True)
        raise
    if there := files.exists(place(path)):
        files.rename(place(path), place(f"{stem}.old"))
    if not files.rename(place(f"{stem}.new"), place(path)):
        raise OSError(f"{stem}.new could not be moved to {path}")
    if there:
        files.delete(place(f"{stem}.old"), True)
