"""Session helpers: a local session for tests and benches, and the checkpoint folder policy."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ecospark") -> SparkSession:
    """A local session configured like a small cluster: AQE on, UI off, UTC clock."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ECOSPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    The cluster names it in ``spark.checkpoint.dir``; we only read it. A private folder is created
    only when nothing is set and the master is local (tests, benches on one machine).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return conf
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="ecospark-ckpt-")
        sc.setCheckpointDir(path)
        return path
    raise RuntimeError("spark.checkpoint.dir is not set: iterative operators need a shared checkpoint folder")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the shared checkpoint folder (survives executor loss, truncates lineage)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: folders this process made under the shared checkpoint folder, by session
_MADE: list[str] = []


def new_folder(spark: SparkSession, prefix: str = "ecospark") -> str:
    """Path of a fresh folder under the shared checkpoint folder for written intermediates; :func:`cleanup` removes it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Remove the folders that :func:`new_folder` gave out in this process, and nothing else. To be called when no
    DataFrame that reads them is needed any more; returns how many were removed. (Spark removes its own checkpoints
    when ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.)"""
    jvm, conf, removed = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed
