"""Small files and folders on any file system Spark knows, through the driver's Hadoop client."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.setVerifyChecksum(False)
    system.setWriteChecksum(False)
    return system, where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def make_folder(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.mkdirs(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    system, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def size(spark: SparkSession, path: str) -> int:
    system, where = _at(spark, path)
    return system.getContentSummary(where).getLength() if system.exists(where) else 0


def delete(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where) and system.rename(where, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to))


def read_json(spark: SparkSession, path: str):
    """The content of a JSON file; None if there is none."""
    system, where = _at(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    """Write a JSON file and put it in place in one step: readers see the old one or the new one."""
    jvm = spark.sparkContext._jvm
    system, new = _at(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(new, True)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    place = system.makeQualified(jvm.org.apache.hadoop.fs.Path(path))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(system.makeQualified(new), place, options)
