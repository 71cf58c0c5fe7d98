"""Cutting lineage by a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: The folder of this process under each shared folder, so that what it left can be released at once.
_OWN = f"lumenrank-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session that names none gets a folder of this machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenrank-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{_OWN}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *makers: Callable[[], DataFrame]) -> list[DataFrame]:
    """What each of the functions gives. They run at once: jobs of one are planned while those of another run."""
    with ThreadPoolExecutor(len(makers)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(make)) for make in makers]]


def release(spark: SparkSession) -> None:
    """Delete the tables that this process has cut so far; results that are still to be computed from them must be done."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{_OWN}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
