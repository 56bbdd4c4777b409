"""Structured Streaming forms of the counting and gap operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The events of a folder of Parquet files as a stream with a proper timestamp."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum of value per key and tumbling window; rows later than the
    watermark are left out."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def deduplicated(events: DataFrame, at: str, key: str, late: str = "2 days") -> DataFrame:
    """Each key once within the watermark: the incremental ledger's insert-if-absent."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_starts(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value, run_no) for each change of value of a key, with the last
    value and run number kept as state between batches (W5 on a stream)."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run = state.get if state.exists else (None, 0)
        rows = []
        for row in pd.concat(list(batches)).sort_values(order).itertuples(index=False):
            now = getattr(row, value)
            if run == 0 or now != last:
                run += 1
                rows.append((k[0], getattr(row, order), now, run))
            last = now
        state.update((last, run))
        yield pd.DataFrame(rows, columns=["key", "at_id", "value", "run_no"])

    return events.groupBy(key).applyInPandasWithState(step, "key long, at_id long, value string, run_no long", "last string, run long", "append", GroupStateTimeout.NoTimeout)
