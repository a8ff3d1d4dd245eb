"""Small intermediate tables in the shared folder, for plans that read one relation many times."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, a folder of this machine serves a session that runs on this machine alone; on a cluster, whose
    executors couldn't see it, that is an error. (A running session's setting can't be changed, so it stays unset.)
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own_folder()
    return found.rstrip("/")


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def place(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in that folder."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> int:
    """Delete tables of place() and written() that no later plan reads, such as those of a result that is stored by now; how many were there.

    Paths outside the shared folder aren't touched. `tables()` lists what a DataFrame reads from there.
    """
    home, gone = folder(spark) + "/", 0
    for path in sorted(set(paths)):
        if path.startswith(home) and ".." not in path and path.rstrip("/") != home.rstrip("/"):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            gone += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return gone


def tables(df: DataFrame) -> list[str]:
    """The tables in the shared folder that df reads: what release() may take once df's rows are stored elsewhere."""
    home = folder(df.sparkSession)
    own = "/" + re.sub(r"^[a-z]+:/+", "", home).strip("/") + "/"
    found = set()
    for file in df.inputFiles():
        path = "/" + re.sub(r"^[a-z]+:/+", "", file).lstrip("/")
        if path.startswith(own):
            found.add(f"{home}/{path[len(own):].split('/')[0]}")
    return sorted(found)
