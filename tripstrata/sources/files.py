"""Folder operations through the Hadoop file system, so any lake location works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    system, location = _at(spark, path)
    return system.exists(location)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder, sorted; none when it does not exist."""
    system, location = _at(spark, path)
    if not system.exists(location):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(location))


def delete(spark: SparkSession, path: str) -> bool:
    system, location = _at(spark, path)
    return system.delete(location, True)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Move one file; false when the source is gone or the target exists."""
    system, location = _at(spark, source)
    return system.rename(location, spark._jvm.org.apache.hadoop.fs.Path(target))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, complete or absent: written under another name and renamed."""
    system, location = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(location, False)
    if not system.rename(beside, location):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    system, location = _at(spark, path)
    stream = system.open(location)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
