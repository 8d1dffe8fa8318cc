"""Sessions: the package on the executors, and tables written in the folder that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ARCHIVE = "dialoom_package.zip"


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once for each cluster session; operators with Python kernels call it."""
    context = spark.sparkContext
    if any(f.endswith(_ARCHIVE) for f in context.listFiles):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="dialoom-")
    shutil.make_archive(f"{folder}/{_ARCHIVE[:-4]}", "zip", os.path.dirname(here), os.path.basename(here))
    context.addPyFile(f"{folder}/{_ARCHIVE}")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the cluster; in local mode, where none is set, a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='dialoom-')}"
        context.setCheckpointDir(folder)
    return folder


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/dialoom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows as Parquet in the shared folder and reads them again.

    A lost executor then costs a reread, not a recomputation of everything before.
    """
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
