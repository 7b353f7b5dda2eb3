"""Feature extraction over a folder that grows: the batch extractor on a file stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lumenlake.functions.registry import FAMILIES
from lumenlake.operators.extract import extract


def extract_stream(spark: SparkSession, source: str, schema: T.StructType | str, keys: Sequence[str], sink: str, checkpoint: str, families: Sequence[str] = tuple(FAMILIES), files_per_batch: int = 100) -> StreamingQuery:
    """Extract the features of each new Parquet file of images once, to a Parquet table.

    Rows are independent, so the stream has no state; source offsets and the
    sink's log in ``checkpoint`` make each picture appear exactly once.  The query
    ends when all present files are done; start it again for later ones.
    """
    images = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows = extract(images, keys, families)
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
