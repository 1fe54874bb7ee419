"""Session helpers shared by all operators: table loading, spreading of work and cutting of lineage."""

from __future__ import annotations

import os
import site
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, unless their search path has it already.

    Functions that run in Python workers are pickled by reference, so workers must be able to import the package;
    where it isn't installed and no search path leads to it, it travels as an archive with the application.
    """
    sc = spark.sparkContext
    if getattr(sc, "_evograph_shipped", False):
        return
    sc._evograph_shipped = True
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.path.abspath(p) for p in site.getsitepackages()]
    if root in known:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="evograph-"), "evograph.zip")  # on the driver, which serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table of a data directory (one Parquet file or directory per table)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Tasks for work that is heavy per row: at least the shuffle width, and a few waves of all cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str | Column, n: int | None = None) -> DataFrame:
    """Hash-partition rows for work that is heavy per row (parsing, alignment).

    A large input already arrives in enough scan partitions; a small one with long texts does not, and one
    shuffle of it is far cheaper than leaving most cores idle. With a deterministic key, so that recomputed
    tasks yield the same rows.
    """
    return df.repartition(n or width(df.sparkSession), *keys)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a local one only in a session of one process that names none."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="evograph-")  # driver and executors are one process
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; never a local one, so a lost executor does no harm."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for tables written between stages."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def number_rows(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Number rows from 0 in an order, without a window over the whole table in one task.

    The rows are sorted by ranges and kept (a checkpoint); the sizes of the ranges, one row per partition, give
    each range its first number.
    """
    kept = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = {r["_part"]: (r["first"], r["n"]) for r in kept.groupBy("_part").agg(F.min("_row").alias("first"), F.count("*").alias("n")).collect()}
    start, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, start - sizes[part][0]))
        start += sizes[part][1]
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _shift bigint")  # one row per partition
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")
