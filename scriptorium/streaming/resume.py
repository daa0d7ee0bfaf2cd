"""Incremental runs over a growing folder.

The checkpoint of the stream is the manifest of what was read, and each batch
is written once: a batch that is repeated after a failure finds its keys in
the target and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from ..operators.incremental import pending


def run_available(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int | None = None, fmt: str = "parquet") -> None:
    """Process every file not processed yet, then stop."""
    stream = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, _: int) -> None:
        rows = transform(batch).dropDuplicates([key])
        try:
            rows = pending(rows, batch.sparkSession.read.parquet(target), key)
        except AnalysisException:
            pass  # nothing has been written yet
        rows.write.mode("append").parquet(target)

    query = stream.load(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
