"""Small text files that say what is current, replaced by one rename, under any path that Spark's file systems know."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = _path(spark, path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, path: str) -> str | None:
    """The file's text, None without the file."""
    at = _path(spark, path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, text: str) -> None:
    """Replaces the file by one rename, so that a reader sees the old text or the new one."""
    at, draft = _path(spark, path), _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    conf = spark._jsc.hadoopConfiguration()
    stream = draft.getFileSystem(conf).create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    kinds = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(draft, at, options)
