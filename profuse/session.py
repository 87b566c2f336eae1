"""Session helpers: a local builder for tests, the shared folder, and the package on the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks, with a scratch folder of its own; a cluster brings its own session."""
    folder = tempfile.mkdtemp(prefix="profuse-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("profuse")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", folder)
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable on the workers, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        folder = tempfile.mkdtemp(prefix="profuse-zip-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "profuse.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(PACKAGE.rglob("*.py")):
                archive.write(file, str(file.relative_to(PACKAGE.parent)))
        context.addPyFile(path)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    A local master may leave it unset and gets a temporary folder; on a cluster
    that is an error, because executors could not read it back.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="profuse-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a table that is read back, below one folder per application; see ``clear_scratch``."""
    return f"{shared_dir(spark).rstrip('/')}/profuse-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that read them must have been used or written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/profuse-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used before a loop that scans the same rows many times: each pass is then a
    columnar scan, and losing an executor costs only its own tasks.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, label: str) -> DataFrame:
    """``stored``, dealt evenly to as many files as there are cores.

    A table that fits into one file is read by one task, whatever each row costs;
    used where the scans of a loop compute much per row.
    """
    return stored(df.repartition(df.sparkSession.sparkContext.defaultParallelism), label)
