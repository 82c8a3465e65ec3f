"""Session helpers shared by every operator: tables, the shared work folder, written intermediates, package shipping."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset a local session takes a temporary folder of this machine; on
    a cluster, whose executors would not see it, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the application's own in the shared folder; nobody else uses it."""
    return f"{work_root(spark)}/codeloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Removes all the application has written to the shared folder; results that were not saved elsewhere cannot be read after."""
    _remove(spark, f"{work_root(spark)}/codeloom/{spark.sparkContext.applicationId}")


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread writes to the shared folder inside the block is removed at its end, however it ends."""
    outer, _scratch.folders = getattr(_scratch, "folders", None), []
    try:
        yield
    finally:
        for folder in _scratch.folders:
            _remove(spark, folder)
        _scratch.folders = outer


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """The rows of df, computed once and read back from the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    if (held := getattr(_scratch, "folders", None)) is not None:
        held.append(path)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over as many partitions as the session's setting spark.codeloom.spread says; where it is unset, rows stay where they are
    read. To be set where inputs are so small that a scan is not cut into a split for each core."""
    n = df.sparkSession.conf.get("spark.codeloom.spread", None)
    return df.repartition(int(n)) if n else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="codeloom-zip-"), "codeloom_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
