"""Rows that must not be computed twice: what hangs on partition numbers is written once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is named and the session runs in one
    process, as in tests, a temporary folder is used."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[.*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sparkpact-')}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing stands at."""
    return f"{shared_folder(spark)}/sparkpact/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """df through a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint()
