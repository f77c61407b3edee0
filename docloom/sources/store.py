"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Rows of a written file, where their number is known beforehand.
FILE_ROWS = 1 << 15


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of this process where it is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        named = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="docloom-"))
    return named.rstrip("/")


def written(df: DataFrame, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read again: lineage ends here.

    rows: about how many rows the last stage of df works on at most, where that is known. It then gets a task, and the table a file, for
    each so many rows, however many partitions it is dealt over: without Hadoop's native library a file costs several new processes.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
