"""Session helpers. Operators never open a session themselves."""

from __future__ import annotations

import os
import tempfile

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tastemill", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TASTEMILL_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tastemill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give the session a checkpoint folder if it has none yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any store that Spark reads."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _checkpointed(df: DataFrame) -> JavaObject | None:
    """The JVM's option of the folder of ``df``, if it is what ``checkpoint`` gave."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None


def drop_checkpoints(*frames: DataFrame) -> None:
    """Remove what ``checkpoint`` wrote for ``frames``, which nothing may read any more.

    Spark keeps these files for good, and files of shuffles until the driver collects its garbage; so it
    is asked to, and iterations don't add up on disk.
    """
    for df in frames:
        found = _checkpointed(df)
        if found is not None and found.isDefined():
            delete_path(df.sparkSession, found.get())
    if frames:
        frames[0].sparkSession.sparkContext._jvm.System.gc()
