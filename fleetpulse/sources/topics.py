"""Kafka topics as streaming sources and sinks.

They need Spark's Kafka connector on the class path; the payload functions do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from fleetpulse.schemas import DECODED, FEATURE_WINDOW
from fleetpulse.sources.files import typed_events


def source_options(servers: str, topic: str, starting: str = "latest") -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
    }


#: Rows of a topic that one micro-batch takes at most; a backlog is worked off in many.
MOST_OFFSETS = 1_000_000


def topic_source(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest"
) -> DataFrame:
    """A topic as a stream of key/value rows."""
    return (
        spark.readStream.format("kafka")
        .options(**source_options(servers, topic, starting))
        .option("maxOffsetsPerTrigger", MOST_OFFSETS)
        .load()
    )


def decode_events(df: DataFrame, schema: T.StructType = DECODED, value: str = "value") -> DataFrame:
    """Typed events from JSON payloads; unreadable payloads give null fields."""
    decoded = df.select(F.from_json(F.col(value).cast("string"), schema).alias("_e"))
    return typed_events(decoded.select("_e.*"))


def decode_windows(df: DataFrame, value: str = "value") -> DataFrame:
    """Feature windows from JSON payloads. The offset of a topic row, where there is one,
    stays as ``arrival``: it orders a machine's windows, since the machine is the key.
    Payloads without a machine or an end time, unreadable ones among them, are left out;
    ``rejected_windows`` gives them."""
    arrival = [F.col("offset").alias("arrival")] if "offset" in df.columns else []
    decoded = df.select(
        F.from_json(F.col(value).cast("string"), FEATURE_WINDOW).alias("_w"), *arrival
    )
    named = decoded.where(_is_window("_w"))
    return named.select("_w.*", *[c for c in decoded.columns if c != "_w"])


def _is_window(window: str):
    return F.col(f"{window}.machine_id").isNotNull() & F.col(f"{window}.window_end").isNotNull()


def rejected_windows(df: DataFrame, value: str = "value") -> DataFrame:
    """The payloads that ``decode_windows`` leaves out, with the reason."""
    window = F.from_json(F.col(value).cast("string"), FEATURE_WINDOW)
    unnamed = df.withColumn("_w", window).where(~F.coalesce(_is_window("_w"), F.lit(False)))
    return unnamed.select(F.lit("not_a_feature_window").alias("reason"), value)


def keyed_payload(df: DataFrame, key: str = "machine_id") -> DataFrame:
    """Key and JSON value of each row. Null fields are left out of the JSON."""
    return df.select(
        F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")
    )


def topic_writer(
    df: DataFrame, servers: str, topic: str, checkpoint: str, mode: str = "append"
) -> DataStreamWriter:
    return (
        keyed_payload(df)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
    )


def topic_sink(
    df: DataFrame,
    servers: str,
    topic: str,
    checkpoint: str,
    mode: str = "append",
    name: str | None = None,
) -> StreamingQuery:
    """Publish each row as keyed JSON."""
    writer = topic_writer(df, servers, topic, checkpoint, mode)
    return (writer.queryName(name) if name else writer).start()
