"""Sizes of topics from their partition offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topic_stats(offsets: DataFrame) -> DataFrame:
    """Partitions and messages per topic, by name.

    Internal topics (leading ``_``) are hidden; a partition with unknown or reversed offsets
    counts as a partition without messages.
    """
    first, last = F.col("first_offset"), F.col("last_offset")
    messages = F.when(last >= first, last - first).otherwise(0)
    return (
        offsets.where((F.col("topic") != "") & ~F.col("topic").startswith("_"))
        .groupBy("topic")
        .agg(F.count(F.lit(1)).alias("partitions"), F.sum(messages).alias("message_count"))
        .orderBy("topic")
    )


def kafka_offsets(spark: SparkSession, brokers: str, topics: str) -> DataFrame:
    """Offsets of the stored messages of some topics; needs the Kafka connector."""
    messages = (
        spark.read.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topics).load()
    )
    return messages.groupBy("topic", "partition").agg(
        F.min("offset").alias("first_offset"), (F.max("offset") + 1).alias("last_offset")
    )
