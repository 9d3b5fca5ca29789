"""Session helpers shared by every operator: scratch tables, parallelism, table access."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session settings for local runs; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("strandwork")
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset, and only on a local
    master (tests, a laptop), a temporary folder is made and installed as the checkpoint folder; a cluster
    must name one, as its executors share no machine-local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandwork-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder below :func:`scratch_dir`; it is dropped when the driver's Python ends."""
    root = f"{scratch_dir(spark).rstrip('/')}/strandwork/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_drop_at_exit, spark)
    return root


def _drop_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        drop_scratch(spark)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the written tables of this application. Call it once the results that read them are out."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is None or spark.sparkContext._jsc is None:
        return
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_roots: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    This cuts the lineage durably: a lost executor costs at most the re-read of a file,
    and a table used by several branches is computed once. With ``partition_by`` a filter on that
    column reads its files only. The tables live until :func:`drop_scratch`, or the end of the driver.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy Python stage at least as many tasks as there are cores.

    For scans. A no-op on inputs that already have enough splits; a small single-file table is
    redistributed round-robin. Behind a shuffle use :func:`fan_out`.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows, by ``keys`` or round-robin, over a fixed number of tasks before CPU-heavy Python work.

    After a shuffle AQE sizes tasks by bytes, and would give a small but costly table to one
    task. A repartition with a number is left as it is.
    """
    spark = df.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder: ``<sf_dir>/<name>.parquet`` (a file or a folder of files)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
