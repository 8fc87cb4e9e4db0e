"""Sessions, messages and tool calls derived from the star-schema test tables, in the shape of a vault's tables.

A session is a user's day of events; conversations are sessions of messages; documents are a corpus to search.
"""

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.periods import Period

CHANNELS = {"view": "input_tokens", "purchase": "output_tokens", "signup": "cache_read_tokens", "click": "cache_write_tokens"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, when: Period | None = None) -> DataFrame:
    """Events with their session and a timestamp in UTC; given a period, those of its days. A session is within one day, so
    that leaves out whole sessions, and the condition on the stored column reaches the scan."""
    rows = table(spark, sf_dir, "events")
    if when is not None:
        kind = rows.schema["ts"].dataType.simpleString()
        rows = rows.where((F.col("ts") >= F.lit(when.start).cast(kind)) & (F.col("ts") < F.lit(when.end + timedelta(days=1)).cast(kind)))
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withColumn("session_id", F.concat_ws("@", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))


def sessions(spark: SparkSession, sf_dir: str, when: Period | None = None) -> DataFrame:
    tokens = [F.sum(F.when(F.col("event_type") == kind, F.floor("value")).otherwise(F.lit(0))).cast("long").alias(name) for kind, name in CHANNELS.items()]
    grouped = events(spark, sf_dir, when).groupBy("session_id", "user_id").agg(
        F.min("ts").alias("started_ts"), F.max("ts").alias("ended_ts"), F.count_if(F.col("event_type") == "error").alias("error_count"), *tokens
    )
    user = F.col("user_id")
    return grouped.select(
        "session_id",
        F.concat(F.lit("source"), (user % 5).cast("string")).alias("source"),
        F.when(user % 7 != 0, F.concat(F.lit("project"), (user % 20).cast("string"))).alias("project_slug"),
        F.concat(F.lit("model"), (user % 3).cast("string")).alias("model"),
        "started_ts", "ended_ts", *CHANNELS.values(), "error_count", F.lit(None).cast("double").alias("estimated_cost_usd"),
    )


def messages(spark: SparkSession, sf_dir: str, when: Period | None = None) -> DataFrame:
    return events(spark, sf_dir, when).where(F.col("event_type").isin("view", "click", "signup")).select("session_id", F.col("event_type").alias("role"))


def tool_calls(spark: SparkSession, sf_dir: str, when: Period | None = None) -> DataFrame:
    return events(spark, sf_dir, when).where(F.col("event_type").isin("purchase", "error")).select("session_id", F.col("event_type").alias("tool_name"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("source_seq"), "role", F.col("text").alias("content"),
        (F.col("conv_id") % 10).alias("project")
    )
