"""Intermediate tables in the folder that driver and executors share.

An operator that needs the same rows twice writes them once and rereads them, so a lost
executor costs the tasks that ran on it and never the lineage above the staged table.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where it is unset and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own[app])
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_application_folder(spark)}/{uuid.uuid4().hex}/{name}"


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all that this application has staged: for the end of a job, when its results are written.

    A result that is read lazily needs its staged tables until then, so operators discard only
    what no later step reads.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and return the reread table."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = hadoop.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results are staged.

    It acts when the driver collects its garbage, which a large heap may put off for long.
    """
    gc.collect()
    spark._jvm.System.gc()
