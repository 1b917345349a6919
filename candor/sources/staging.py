"""Tables between steps: written where driver and executors can read them, read back, so that lineage ends there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path under ``spark.checkpoint.dir``; without that setting only a local session has one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir") + "/.candor"
    return f"{found}/candor-{purpose}/{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read back. The files stay: give the folder a retention time."""
    path = f"{shared_folder(df.sparkSession, 'stage')}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` to as many tasks as the session's shuffles have, or as it has cores. For rows whose work
    outweighs their bytes: files and adaptive merging go by bytes and would leave them to one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
