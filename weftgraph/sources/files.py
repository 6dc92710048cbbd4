"""Small files of any file system that Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def read_text(spark: SparkSession, path: str) -> str:
    system, place = _at(spark, path)
    stream = system.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed, so that a reader sees the old text or the new."""
    system, place = _at(spark, path)
    _, beside = _at(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(beside)
    stream.write(bytearray(text.encode()))
    stream.close()
    system.delete(place, False)
    if not system.rename(beside, place):
        raise OSError(f"{path} can't be written")


def delete(spark: SparkSession, path: str) -> None:
    system, place = _at(spark, path)
    system.delete(place, True)
