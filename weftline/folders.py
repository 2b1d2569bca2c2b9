"""Tables that an application writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="weftline-")


def application_folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir. A local session without that setting (tests) gets its own."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = found.get() if found.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base or _own_folder()}/weftline-tables-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the application."""
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a written table: its lineage ends there, and a lost executor loses nothing."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_folders(spark: SparkSession) -> None:
    """Delete the application's folders. Results of operators and streams read them: write these first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
