"""Session settings shared by the command line, the tests and the bench."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Per-session settings that keep results equal on any cluster. Sizing
# (partitions, memory) is left to the cluster and to adaptive execution.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(
    app_name: str = "sqlgauge",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session. ``master`` is for local runs only."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A local temporary folder is used only by local sessions, where the setting
    is usually absent; a cluster session without it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_sqlgauge_folder", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    # Spark does not let a running session change the setting itself
    folder = context._sqlgauge_folder = tempfile.mkdtemp(prefix="sqlgauge-checkpoints-")
    return folder


def widen(scan: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """Spread a scan of fewer splits than cores over all cores.

    For work that is heavy per row. A large input has more splits than cores and
    is left alone, unless ``task_bytes`` bounds what one task gets of the files. ``scan`` is a plain
    file scan, whose splits are known before anything runs.
    """
    tasks = scan.sparkSession.sparkContext.defaultParallelism
    if task_bytes:
        tasks = max(tasks, -(-file_bytes(scan) // task_bytes))
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan


def file_bytes(scan: DataFrame) -> int:
    """Bytes of the files of a scan, as the file system lists them."""
    context = scan.sparkSession.sparkContext
    places = [context._jvm.org.apache.hadoop.fs.Path(name) for name in scan.inputFiles()]
    return sum(p.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in places)


def task_count(spark: SparkSession) -> int:
    """Number of tasks for an explicit repartitioning before per-row Python work."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of a frame that several later jobs read, and survives the
    loss of any executor because the rows live in the shared folder. The files go when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, whose frames nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    context = spark.sparkContext
    if getattr(context, "_sqlgauge_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="sqlgauge-code-"), "sqlgauge.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    context._sqlgauge_shipped = True
