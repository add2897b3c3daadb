"""Kafka topics as sources and sinks; the connector package must be on the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# fixed values: times with all the digits they have
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType, **options: str) -> DataFrame:
    """The topic as typed rows."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", "earliest"))
    for key, value in options.items():
        reader = reader.option(key, value)
    return decode(reader.load(), schema)


def decode(records: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON bytes in `value` to columns; values that do not parse give NULL columns."""
    return records.select(F.from_json(F.col("value").cast("string"), schema, TIMES).alias("row")).select("row.*")


def encode(df: DataFrame, key: Column | None = None) -> DataFrame:
    """Columns to Kafka's `key` and `value` bytes; the value is the whole row as JSON."""
    value = F.to_json(F.struct(*df.columns), TIMES).cast("binary").alias("value")
    if key is None:
        return df.select(value)
    return df.select(key.cast("string").cast("binary").alias("key"), value)


def write_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: Column | None = None):
    """Start writing a stream to a topic."""
    return (encode(df, key).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())
