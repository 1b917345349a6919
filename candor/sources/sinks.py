"""Sinks: observations appended by url bucket, tables replaced as a whole, result rows as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_observations(points: DataFrame, path: str, buckets: int = 64) -> None:
    """Append (url, observed_at, price), partitioned by a hash bucket of the url (K2)."""
    points.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")).write.mode("append").partitionBy("bucket").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table's next version beside it and read that from then on: ``path`` must be new (upserts read the old one)."""
    df.write.mode("errorifexists").parquet(path)


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as the answer of an API (K6)."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))
