"""Resumable ingest: files once each, chunks in order, write-through caches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest_files(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, per_trigger: int | None = None, fmt: str = "parquet") -> None:
    """New files of source appended to sink, then stop; a restart goes on after the last committed file."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    query = reader.format(fmt).load(source).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()


def submit_chunks(spark: SparkSession, source: str, schema: str, checkpoint: str, submit: Callable[[DataFrame, int], None], per_chunk: int = 1, fmt: str = "parquet") -> None:
    """Chunks of files given to submit one at a time, each marked done once it returned."""
    query = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_chunk).format(fmt).load(source).writeStream.foreachBatch(submit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def cache_through(cache: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends rows whose key the cache lacks; the first write of a key stays."""

    def write(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        try:
            new = new.join(batch.sparkSession.read.parquet(cache).select(*keys), keys, "left_anti")
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(cache)

    return write


def split_cached(pairs: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs the cache holds, and those that remain."""
    return pairs.join(cache, keys), pairs.join(cache.select(*keys), keys, "left_anti")


def build_index(spark: SparkSession, source: str, schema: str, index: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], per_batch: int | None = None, fmt: str = "parquet") -> None:
    """Files of source that the index lacks, prepared and added to it, then stop.

    The log of the checkpoint is the offset: a start goes on after the last committed file. A batch writes a folder of its own
    (column batch), so that one which was cut short is written over, not added twice."""

    def add(df: DataFrame, k: int) -> None:
        prepare(df).write.mode("overwrite").parquet(f"{index}/batch={k}")

    submit_chunks(spark, source, schema, checkpoint, add, per_batch or 1_000_000, fmt)


def poll(state: Callable[[], str], terminal: frozenset[str] = frozenset(("succeeded", "failed", "cancelled", "expired")), pause: float = 30.0, most: float = 86_400.0) -> str:
    """The first terminal state of a remote job, asked for every `pause` seconds; TimeoutError after `most`."""
    start = time.monotonic()
    while (now := state().lower()) not in terminal:
        if time.monotonic() - start + pause > most:
            raise TimeoutError(f"still {now}")
        time.sleep(pause)
    return now
