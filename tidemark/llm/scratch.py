"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir), and maps over small Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of an Arrow batch on its way to Python; a row of more bytes is a batch of its own.
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: The folders of local sessions that name none, by application id.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a folder of our own, for a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return _own[application]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read from there: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH_BYTES, which the session is set to unless it has a lower bound."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_CONF).rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)
