"""Session helpers shared by all modules."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, bool] = {}


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cavitas")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors of ``spark``; once a context."""
    context = spark.sparkContext
    if _shipped.get(context.applicationId):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="cavitas-"), "cavitas.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    context.addPyFile(path)
    _shipped[context.applicationId] = True


def checkpoint_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which a cluster shares between its machines.

    Where it is unset a local session gets a temporary folder; on a cluster, where that would be
    each machine's own disk, this raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir: a cluster needs a folder that all its machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cavitas-checkpoint-"))
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new name in `checkpoint_folder`; what is written there goes when the session's JVM ends."""
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by an eager checkpoint in `checkpoint_folder`."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def list_folder(spark: SparkSession, folder: str) -> list[str] | None:
    """Names in a folder of any file system that Spark reads, sorted; None if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path) or not files.getFileStatus(path).isDirectory():
        return None
    return sorted(f.getPath().getName() for f in files.listStatus(path))
