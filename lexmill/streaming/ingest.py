"""Incremental loading: new dictionary files as a stream, folded into the translation table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.sources.readers import parse_dictionary, translations


def dictionary_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of the JSON files that appear in a folder, with the time they were read."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).withColumn("read_at", F.current_timestamp())


def load_translations(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the distinct translations of each batch, one directory a batch.

    A batch that is repeated after a failure overwrites its own directory, so every
    translation of a batch is there once. Runs until all present files are read.
    """

    def save(batch: DataFrame, number: int) -> None:
        translations(parse_dictionary(batch, "value")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Counts per key and window of event time; rows later than ``delay`` are left to the batch load."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("cnt"))
