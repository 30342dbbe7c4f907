"""Incremental execution of the row-local curation operators.

The reference is batch-only (SURVEY §2.10: no watermark, window or state anywhere), so nothing
here adds semantics: :func:`curate_stream` runs any *stateless* DataFrame -> DataFrame operator
(unit standardisation, compound filter, p-transform, status trail) over files as they arrive,
with an exactly-once file sink and a checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def curate_stream(spark: SparkSession, source_dir: str, schema: str, transform: Callable[[DataFrame], DataFrame],
                  sink_dir: str, checkpoint: str, fmt: str = "parquet", once: bool = True) -> StreamingQuery:
    """Read new ``fmt`` files from ``source_dir``, apply ``transform``, append to ``sink_dir``."""
    stream = spark.readStream.format(fmt).schema(schema).option("header", True).load(source_dir)
    writer = (transform(stream).writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()
