"""Structured Streaming forms of the two append-only loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.ledger import ingest
from shelfspark.sources.feeds import click_rows
from shelfspark.sources.store import new_folder


def stream_feed(items: DataFrame, variants: DataFrame, out: str, checkpoint: str):
    """ST-1: good rows and rejects in folders by batch id, so that a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = ingest(batch, variants).withColumn("errors", F.array_join("errors", "; "))
        rows.where("outcome = 'inserted'").write.mode("overwrite").parquet(f"{out}/offers/batch={batch_id}")
        rows.where("outcome <> 'inserted'").write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_clicks(clicks: DataFrame, offers: DataFrame, out: str, checkpoint: str):
    """ST-2: stream-static join with the known offers, appended as Parquet."""
    return click_rows(clicks, offers).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_feed(spark: SparkSession, items: DataFrame, variants: DataFrame) -> DataFrame:
    """Feeds a table through the stream, as JSON files, and returns what it wrote."""
    home = new_folder(spark, "stream")
    items.write.json(f"{home}/in")
    source = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 4).json(f"{home}/in")
    stream_feed(source, variants, f"{home}/out", f"{home}/state").awaitTermination()
    return spark.read.parquet(f"{home}/out/offers").select("item_id", "outcome", "variant_id", "size_ml").union(spark.read.parquet(f"{home}/out/rejects").select("item_id", "outcome", "variant_id", "size_ml"))


def replay_clicks(spark: SparkSession, clicks: DataFrame, offers: DataFrame) -> DataFrame:
    home = new_folder(spark, "stream")
    clicks.write.parquet(f"{home}/in")
    source = spark.readStream.schema(clicks.schema).parquet(f"{home}/in")
    stream_clicks(source, offers, f"{home}/out", f"{home}/state").awaitTermination()
    return spark.read.parquet(f"{home}/out")
