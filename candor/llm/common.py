"""Shared plumbing: spooled tables, folds, and bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into numpy arrays at once.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as Spark reads it, whatever store the folder is in."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; an error without it, since a folder of
    one machine is none that executors could read."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if sc.master.startswith("local"):  # driver and executors are one machine
        from pathlib import Path

        return str(Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")).parent / "candor-checkpoint")
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing is at yet."""
    return f"{shared_dir(spark)}/candor/{uuid.uuid4().hex}/{name}"


def spool(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: str | Column) -> Column:
    """crc32(id as text) mod 5; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return (F.crc32(c.cast("string").cast("binary")) % F.lit(5)).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece add up to about ``limit``
    bytes (a single longer text stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column's texts; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def split_count(total: float, each: float) -> int:
    """How many parts of about ``each`` hold ``total``: grows with the input, no upper limit."""
    return max(1, -int(-(total or 0) // each))
