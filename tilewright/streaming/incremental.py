"""Resume by checkpoint: work only on sample files that have arrived since the last run.

The batch form of resuming is an anti-join against finished units (``sources.writers.unfinished``). For a folder that
keeps receiving files, a file stream with ``availableNow`` does the same without comparing anything: the checkpoint knows
which files were taken, a crash repeats at most the unfinished batch, and the sink's commit log keeps results single.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new_files(
    spark: SparkSession,
    source: str,
    schema,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Apply a row-wise transform to the Parquet files not seen before, append the results, return all results."""
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    out = transform(arriving)
    run = (
        out.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)
