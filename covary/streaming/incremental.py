"""Counts over a folder of event shards, maintained incrementally."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from covary.operators.counts import period_counts
from covary.session import ensure_checkpoint_dir


def stream_events(spark: SparkSession, path: str, schema: StructType | str,
                  fmt: str = "json", max_files_per_trigger: int | None = None,
                  options: dict | None = None) -> DataFrame:
    """A streaming DataFrame over the shard files of one folder (typed, no
    inference). Each micro-batch reads only files not seen before."""
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return reader.load(path)


def streaming_counts(events: DataFrame, keys: Sequence[str | Column], name: str = "n") -> DataFrame:
    """The batch ``period_counts`` applied to a stream: a stateful grouped
    count whose state (one row per key) lives in the checkpoint."""
    return period_counts(events, list(keys), name)


def run_available(df: DataFrame, query_name: str, output_path: str | None = None,
                  mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Process every shard available now, then stop.

    Offsets and aggregation state go to ``<spark.checkpoint.dir>/streams/
    <query_name>``, so a rerun continues where the last one ended and a lost
    executor replays from the checkpoint. Results go to ``output_path``.
    ``fmt='memory'`` (a temp view ``query_name``, held whole on the driver) is
    for tests and small results only and must be asked for.
    """
    if fmt != "memory" and not output_path:
        raise ValueError("name an output_path")
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    writer = (df.writeStream.outputMode(mode).format(fmt).queryName(query_name)
                .option("checkpointLocation", os.path.join(base, "streams", query_name))
                .trigger(availableNow=True))
    q = writer.start(output_path) if output_path else writer.start()
    q.awaitTermination()
    return q
