"""Tables in the folder that driver and executors share: lineage ends there, and a lost executor takes nothing along."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where that is unset and driver and executors are one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kmerloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kmerloom/{name}-{uuid.uuid4().hex}"


_CLEANED: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _own(spark: SparkSession) -> str:
    """This application's folder of intermediate tables, which goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/kmerloom/tables-{spark.sparkContext.applicationId}"
    if path not in _CLEANED:
        _CLEANED.add(path)

        def clean() -> None:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)

        atexit.register(clean)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, from a table in the shared folder."""
    spark = df.sparkSession
    path = f"{_own(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kmerloom_table = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table of a DataFrame that written() gave and that nothing reads any more."""
    _remove(df.sparkSession, df._kmerloom_table)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what is run sends Python so many rows at a time: for rows of several kilobytes, which fill memory by the default number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
