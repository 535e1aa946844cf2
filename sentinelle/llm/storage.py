"""Where intermediate tables go: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sentinelle.session import shared_folder

#: Bytes of an Arrow batch, so that long texts make short batches, and what a session that sets none has.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
DEFAULT_BYTES = "67108864b"
#: How rows of megabytes are written.
WIDE = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false", "maxRecordsPerFile": "8"}


def mapped(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`frame.mapInArrow` with batches bounded by bytes as well as by rows.

    The bound is a setting of the session: one that has Spark's default gets BATCH_BYTES from here on, for all its
    queries; one that says how large batches are keeps that.
    """
    name, most = BATCH_BYTES
    conf = frame.sparkSession.conf
    if conf.get(name) == DEFAULT_BYTES:
        conf.set(name, str(most))
    return frame.mapInArrow(run, schema)


def free(frame: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `frame` begins so."""
    while any(c.lower().startswith(name.lower()) for c in frame.columns):
        name = "_" + name
    return name


def written(frame: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """`frame` as a table in the shared folder: lineage ends here, and a lost executor costs no recomputation.

    Rows of megabytes (`wide`) are a row group each, and a file has few. Parquet looks at sizes every hundred rows at first,
    buffers, compresses and reads pages of as many, and holds the least and the greatest value of every row group until
    the file ends: so wide rows would take memory by the bytes of a whole task.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (frame.write.options(**WIDE) if wide else frame.write).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
