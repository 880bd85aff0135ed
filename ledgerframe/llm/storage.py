"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

Long plans are cut by writing a Parquet table there and reading it again, so that a lost executor costs one task
and not the whole lineage. A folder of our own is set only where the session has none (tests on one machine).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        own = tempfile.mkdtemp(prefix="ledgerframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        base = sc.getCheckpointDir()
    return base


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once, with options of the Parquet writer, and read back; the plan behind the returned frame is a plain scan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerframe/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


@contextmanager
def read_once(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has ended, not when the driver's garbage is collected; frames that run here
    are not to run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Deletes a table made by :func:`materialize` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
