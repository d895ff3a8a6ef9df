"""Streaming twins of batch operators; with ``availableNow`` they replay files in batches."""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stored import shared_folder


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def unique_trades(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Trades once by id, within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def tumbling_bars(events: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Bars of complete windows only."""
    bars = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("high"), F.min("value").alias("low"))
    return bars.select(F.col("event_type").alias("symbol"), F.col("window.start").alias("start"), "n", "high", "low")


def sliding_flow(events: DataFrame, size: str = "60 seconds", slide: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Signed number of trades, and trades, of complete sliding windows."""
    signed = F.when(F.col("event_id") % 2 == 0, -1).otherwise(1)
    x = events.withWatermark("ts", delay).groupBy(F.window("ts", size, slide), "event_type").agg(F.sum(signed).alias("signed"), F.count("*").alias("n"))
    return x.select(F.col("event_type").alias("symbol"), F.col("window.start").alias("start"), "signed", "n")


def fed(parts: list[dict[str, DataFrame]], build: Callable[..., DataFrame]) -> DataFrame:
    """What ``build`` writes when tables come part by part.

    Each part is a table for every name that ``build`` takes as a stream; it is
    added to the stored tables, and the stream runs on from its checkpoint over
    what is new, as live micro-batches would.
    """
    spark = next(iter(parts[0].values())).sparkSession
    place = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    schemas = {name: rows.schema for name, rows in parts[0].items()}
    for part in parts:
        for name, rows in part.items():
            rows.write.mode("append").parquet(f"{place}/in/{name}")
        streams = {name: spark.readStream.schema(schema).parquet(f"{place}/in/{name}") for name, schema in schemas.items()}
        out = build(**streams)
        _run(out, place)
    return spark.read.parquet(f"{place}/out").select(*out.columns)


def _run(stream: DataFrame, place: str) -> None:
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    run = stream.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()


def replayed(stream: DataFrame, final: bool = True) -> DataFrame:
    """Runs the stream over all files that are there and returns what it wrote."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _run(stream, place)
    return spark.read.parquet(f"{place}/out").select(*stream.columns)
