"""Session helpers: a tuned local session for tests and the shared folder of a cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "sievora", **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent and the master is local (tests) a temporary folder is made
    and set as the checkpoint directory; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sievora-")
        context.setCheckpointDir(named)
    return named


def work_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/sievora/{spark.sparkContext.applicationId}"


_cleaned: set[str] = set()


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under the shared folder and read again.

    What follows reads the files, column by column, instead of computing df once more, and a
    lost executor costs none of them. remove_materialized, or the end of the driver's interpreter, removes
    them; were the driver killed, they would be left under the application's id.
    """
    spark = df.sparkSession
    root = work_folder(spark)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_remove, spark, root, True)
    return spark.read.schema(df.schema).parquet(path)


def remove_materialized(spark: SparkSession) -> None:
    """Remove every intermediate table of the session; DataFrames built on them can't be read any more."""
    _remove(spark, work_folder(spark), False)


def _remove(spark: SparkSession, path: str, at_exit: bool) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001
        if not at_exit:  # at exit the session may be over already
            raise
