"""Session helpers: shared scratch folder, package shipping, table loading."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local_folders: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset on
    one machine (tests) does a fresh local folder stand in for it; on a cluster,
    whose executors would each write to their own disk, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-ledgerloom-")
    return _local_folders[app]


def materialise(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that ran on it, and the
    reread plan starts from files instead of recomputing what lies before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerloom-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._ledgerloom_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that ``materialise`` returned."""
    path = getattr(df, "_ledgerloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most so many rows, unless the session set its own number.

    Rows are whole texts, so Spark's default of 10,000 would hold tens of MB,
    several times over, in each task's JVM and Python worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(rows))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    The archive goes through Spark's own file server, so executors need no
    folder in common with the driver.
    """
    bound_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "ledgerloom_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
