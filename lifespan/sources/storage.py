"""Shared folder for intermediate results."""

from __future__ import annotations

import fnmatch
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names, else a local one in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="lifespan-")
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and go on from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """Like ``cut_lineage`` in columns, so that later reads take only the columns they need."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def opened(url: str):
    """A file system and the path in it; any that pyarrow knows by its address, else local."""
    from pyarrow import fs

    if "://" in url or url.startswith("file:"):
        return fs.FileSystem.from_uri(url if "://" in url else "file://" + url.removeprefix("file:"))
    return fs.LocalFileSystem(), url


def listed(path: str):
    """The file system of a path and the files that it names."""
    from pyarrow import fs

    store, pattern = opened(path)
    folder = posixpath.dirname(pattern) if any(c in pattern for c in "*?[") else pattern
    info = store.get_file_info(folder)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(folder))
    chosen = [i for i in found if i.type == fs.FileType.File and (folder == pattern or fnmatch.fnmatchcase(i.path, pattern))]
    return store, sorted(i.path for i in chosen if not i.base_name.startswith((".", "_")))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, in whatever file system it is."""
    jvm, context = spark._jvm, spark.sparkContext
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
