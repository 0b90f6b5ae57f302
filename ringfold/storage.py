"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one, on a local master alone."""
    global _own
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    _own = _own or tempfile.mkdtemp(prefix="ringfold-")
    return f"file://{_own}"


def table_or_none(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame | None:
    """The Parquet table at path; None if nothing has been written there (without a schema: no file)."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder, if there is one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write df as Parquet, with the writer's options, into the shared folder and read it again."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ringfold/{name}-{uuid.uuid4().hex}"
