"""The stateless operators over a folder that grows: an extension, with Structured Streaming's micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, schema: str, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_a_batch: int = 100) -> StreamingQuery:
    """Runs ``plan`` on each batch of new Parquet files of ``folder``; results are Parquet files below ``out``.

    A batch is a whole table to ``plan``, so grouped operators work within it: an image's rows belong in
    one file. Each batch is written below its own number, over what a failed attempt left there.
    """

    def write(batch: DataFrame, k: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={k}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
