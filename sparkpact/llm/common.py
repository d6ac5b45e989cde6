"""Shared helpers of the training-data operators: the shared work folder and written tables.

Tables that cut a plan's lineage go to the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver can read them, so a lost executor costs
the re-run of its tasks and nothing else.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_MASTER = re.compile(r"local(\[.*\])?$")


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def workspace(spark: SparkSession) -> str:
    """The shared folder of this session.

    A folder of our own is made only where ``spark.checkpoint.dir`` is unset and the master runs
    in one process, as in tests; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif LOCAL_MASTER.match(spark.sparkContext.master):
            base = f"file://{tempfile.mkdtemp(prefix='sparkpact-')}"
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base.rstrip("/")


#: Paths given out since the innermost temporary() began.
GIVEN: ContextVar[list[str] | None] = ContextVar("GIVEN", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{workspace(spark)}/sparkpact/{name}-{uuid.uuid4().hex}"
    given = GIVEN.get()
    if given is not None:
        given.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is written to fresh paths meanwhile is deleted at the end."""
    given: list[str] = []
    token = GIVEN.set(given)
    try:
        yield
    finally:
        GIVEN.reset(token)
        for path in given:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; its lineage ends there."""
    spark = session_of(df)
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the files under a table made by saved()."""
    spark = session_of(df)
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for parent in parents:
        delete(spark, parent)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as decimal text, mod folds; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def fold_of_text(key: object, folds: int = 5) -> int:
    """The same rule for one key in Python."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % folds


def lower_ascii_table() -> dict[int, int]:
    """For str.translate: A-Z to a-z and nothing else."""
    return {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


LOWER_ASCII = lower_ascii_table()
