"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in which every row has a number of its own, and the name of its column, which no other has."""
    name, taken = "_row", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return materialize(df.withColumn(name, F.monotonically_increasing_id())), name


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 256) -> DataFrame:
    """Apply ``fn`` to small record batches inside the tasks, so that memory does not follow the batch size Spark picks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one (tests) gets its own."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(base or tempfile.mkdtemp(prefix="weftline-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder of intermediate tables within the shared one."""
    return os.path.join(shared_dir(spark), f"weftline-{spark.sparkContext.applicationId}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete the application's intermediate tables. Results of operators read them: write these first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the application's scratch folder and read it back.

    The lineage ends there and a lost executor loses nothing. Tables stay until ``clear_scratch``.
    """
    path = os.path.join(scratch_dir(df.sparkSession), uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]
