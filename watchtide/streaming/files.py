"""Starting queries and writing their batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

# The writer's rhythm.
TRIGGER = "2 seconds"


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A folder as a stream of its files."""
    reader = spark.readStream.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def for_each_batch(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
    available_now: bool = False, trigger: str = TRIGGER,
) -> StreamingQuery:
    """Start a query that hands each micro-batch to ``write``.

    A batch may be handed over again after a failure, so ``write`` has to be repeatable.
    """
    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()


def write_batches(
    df: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = False, trigger: str = TRIGGER
) -> StreamingQuery:
    """Start a query whose batches land in ``batch_id=N`` folders.

    A repeated batch overwrites its own folder. In update mode the newest batch holding a key has its
    current value.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return for_each_batch(df, write, checkpoint, mode, available_now, trigger)
