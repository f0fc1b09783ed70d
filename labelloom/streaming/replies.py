"""Taking in replies while they arrive, instead of polling until a batch has ended.

The batch operators are reused per micro-batch: successful replies join their requests and are
appended to the cache, everything else goes to a reject table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelloom.sources.cache import ResponseCache, cache_rows

REPLY_SCHEMA = "custom_id string, status string, response string"


def watch_replies(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of reply rows from JSON files that a service drops into a folder."""
    reader = spark.readStream.schema(REPLY_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def store_replies(
    replies: DataFrame,
    requests: DataFrame,
    cache: ResponseCache,
    model: str,
    rejects_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Join arriving replies to ``requests`` (``custom_id, hash_key, text``) and cache the good ones.

    Writes are named after the stream (the id in its checkpoint) and the micro-batch, so a batch
    repeated after a failure replaces its own output, nothing is stored twice, and another stream
    on the same cache adds to it. Runs until all files present have been taken in.
    """
    asked = requests.select("custom_id", "hash_key", F.col("text").alias("question"))

    def take_in(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        batch = batch.persist()
        try:
            good = batch.where(F.col("status") == "succeeded").join(asked, "custom_id")
            cache.put(cache_rows(good, model), f"{number:020d}-{stream}")
            bad = batch.where(F.coalesce(F.col("status"), F.lit("")) != "succeeded").select("custom_id", "status")
            bad.write.mode("overwrite").parquet(f"{rejects_path}/stream={stream}/batch={number}")
        finally:
            batch.unpersist()

    return (
        replies.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
