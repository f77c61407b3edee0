"""The edit-event topic: a Kafka source and sink, keyed by document, and the same events from files.

Kafka needs Spark's connector package on the class path of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topic_events(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", **options: str) -> DataFrame:
    """The topic's messages as a stream of (value); offsets are those of the stream's checkpoint."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    return reader.options(**options).load().select("value")


def messages(events: DataFrame, key: str = "document_id") -> DataFrame:
    """Events as messages (key, value: JSON without null fields), so that a document's events stay in order."""
    return events.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def send(events: DataFrame, servers: str, topic: str) -> None:
    messages(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def file_events(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The rows of Parquet files of a name in a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
