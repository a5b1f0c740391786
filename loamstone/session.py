"""Session access, table reading and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone import files


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting (tests, a laptop) gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = tempfile.mkdtemp(prefix="loamstone-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data when the driver ends."""

    def remove() -> None:
        if path.startswith("file://"):
            shutil.rmtree(path[len("file://") :], ignore_errors=True)
            return
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the gateway may be gone already
            pass

    atexit.register(remove)


_kept: list[tuple[SparkSession, str]] = []


def release() -> int:
    """Delete the tables written by :func:`materialise` so far; gives their number. For long sessions, once
    the results made from them are written."""
    n = len(_kept)
    while _kept:
        files.delete(*_kept.pop())
    return n


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at files that outlive
    any executor, the planner knows the size, and later reads prune columns. They go when the driver ends or
    with :func:`release`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loamstone-{os.getpid()}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    _kept.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row for each value of ``key`` (nulls dropped).

    Reads the key column alone to see whether any value repeats; only rows with a repeated key are
    shuffled, and of those the smallest in the order of the remaining orderable columns is kept.
    """
    df = df.filter(F.col(key).isNotNull())
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    if repeated.isEmpty():
        return df
    repeated = materialise(repeated)
    rest = [c for c in df.columns if c != key]
    sortable = [c for c in rest if not any(x in df.schema[c].dataType.simpleString() for x in ("map", "variant"))]
    twice = df.join(repeated, key, "left_semi")
    one = twice.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in sortable] or [F.lit(1)])).alias("kept"))
    one = one.select(key, *[F.col(f"kept.{c}").alias(c) for c in rest]).select(*df.columns)
    return df.join(repeated, key, "left_anti").unionByName(one)
