"""Session settings and the shared folder used for checkpoints and scratch tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8, scratch: str | None = None) -> SparkSession:
    """Session for tests and the bench, with ``scratch`` as its checkpoint folder; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabfeat")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    return (builder.config("spark.checkpoint.dir", scratch) if scratch else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, else one of this application under the warehouse."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local") and sc.getConf().get("spark.sql.warehouse.dir") is None:
            raise RuntimeError("set spark.checkpoint.dir or spark.sql.warehouse.dir to a folder all executors share")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{sc.applicationId}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to its own folder under the warehouse; a configured folder is left alone."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and sc.getCheckpointDir() is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        path.getParent().getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of each row in ``_row``, written once, so that every scan of it finds the same numbers."""
    path = scratch_path(df.sparkSession, name)
    df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application; for runs without --py-files."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tabfeat-package-"), "tabfeat")
    root, name = os.path.split(package)
    sc.addPyFile(shutil.make_archive(target, "zip", root, name))
    _shipped.add(sc.applicationId)
