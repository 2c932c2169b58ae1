"""A folder that driver and executors share, for files that a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode one of our own where that is unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def kept(df: DataFrame) -> DataFrame:
    """``df`` materialised by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def through_files(spark: SparkSession, steps: Callable[[str], DataFrame]) -> DataFrame:
    """``steps(folder)`` materialised by a reliable checkpoint; the folder is new, lies in the shared folder, and is gone afterwards."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    try:
        return kept(steps(folder))
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
