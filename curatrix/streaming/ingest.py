"""Arriving shards as a stream (an extension; the batch operators are the same)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators.curation import base_quality, pools
from curatrix.session import shared_folder


def pool_stream(spark: SparkSession, path: str, schema, out: str, late: str = "2 hours"):
    """A query that writes arriving normalised shards to pools, each id once within ``late``; it ends when all is read.

    The checkpoint goes by ``out``, so a restart goes on where the last run ended.
    """
    rows = spark.readStream.schema(schema).parquet(path).withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["id"])
    kept = pools(rows.where(base_quality(rows)))
    return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{shared_folder(spark)}/stream-{hashlib.sha1(out.encode()).hexdigest()}").partitionBy("pool").trigger(availableNow=True).start()


def hourly(events: DataFrame, ts: str, key: str, value: str, late: str = "1 hour") -> DataFrame:
    """(hour, key, n, total) of events, batch or stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, "1 hour").alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("hour"), key, "n", "total")
