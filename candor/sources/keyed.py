"""Keyed tables in hash buckets, of which a batch rewrites only those that it touches (K1, K3, K4, K5).

A table is a folder with ``data/bucket=b/version=v`` and ``manifest/n=k``: a manifest says which version of each bucket is
the table's present one. A batch reads the touched buckets, writes their next version beside them, and ends with a new
manifest, which Spark commits as a whole. So a reader never sees half a batch, a batch that fails leaves the table as it
was, and buckets without changes are neither read nor written. One writer at a time; older versions stay until removed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.operators import labels, prices

MANIFEST = "bucket int, version int, n int"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def present(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """(number of the manifest, version of each bucket); (0, {}) before the first batch. One row a bucket: few."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    last = rows.agg(F.max("n")).first()[0] or 0
    return last, {r["bucket"]: r["version"] for r in rows.where(F.col("n") == last).collect()}


def read_keyed(spark: SparkSession, path: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """The present rows of a table, or those of some buckets; empty before the first batch."""
    _, versions = present(spark, path)
    paths = [f"{path}/data/bucket={b}/version={v}" for b, v in versions.items() if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _commit(rows: DataFrame, path: str, keys: list[str], buckets: int, touched: list[int]) -> None:
    spark = rows.sparkSession
    n, versions = present(spark, path)
    rows.withColumns({"bucket": bucket_of(keys, buckets), "version": F.lit(n + 1)}).repartition("bucket").write.mode("append").partitionBy("bucket", "version").parquet(f"{path}/data")
    now = [(b, n + 1 if b in touched else versions[b]) for b in sorted({*versions, *touched})]
    spark.createDataFrame(now, "bucket int, version int").coalesce(1).write.parquet(f"{path}/manifest/n={n + 1}")


def touched_buckets(batch: DataFrame, keys: list[str], buckets: int) -> list[int]:
    return sorted(r[0] for r in batch.select(bucket_of(keys, buckets)).distinct().collect())  # at most the number of buckets


def upsert_keyed(path: str, batch: DataFrame, schema: str, keys: list[str], order: str, keep_first: tuple[str, ...] = (), buckets: int = 64) -> None:
    """The last row of a key in ``batch`` (by ``order``) replaces the stored one, except columns of ``keep_first``: review
    observations (K1), labels (K4) and imported rows (K5) alike. Empty batches change nothing."""
    touched = touched_buckets(batch, keys, buckets)
    if touched:
        old = read_keyed(batch.sparkSession, path, schema, touched)
        _commit(labels.upsert(old, batch, keys, order, keep_first), path, keys, buckets, touched)


def append_suppressed(path: str, points: DataFrame, key: str, minutes: int = 30, buckets: int = 64) -> None:
    """Price observations (``key``, observed_at, ordinal, price) added to the stored ones, without those that repeat the last
    stored price of their key within ``minutes`` (K3). Stored ones stay as they are: suppression sees the last of each key."""
    schema = f"{key} {dict(points.dtypes)[key]}, observed_at timestamp, ordinal bigint, price double"
    touched = touched_buckets(points, [key], buckets)
    if not touched:
        return
    old = read_keyed(points.sparkSession, path, schema, touched)
    names = ["observed_at", "ordinal", "price"]
    last = old.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("observed_at", "ordinal")).alias("x")).select(key, "x.*")
    new = points.select(key, F.col("observed_at").cast("timestamp").alias("observed_at"), "ordinal", "price")
    kept = prices.debounced(last.unionByName(new), key, minutes).join(last.select(key, *names), [key, *names], "left_anti")
    _commit(old.unionByName(kept.select(key, *names)), path, [key], buckets, touched)


def import_reviews(path: str, raw: DataFrame, source: str, buckets: int = 64) -> None:
    """Rows of an imported file (text, rating, label by either name) upserted by the hash of their text under ``source``; the
    first import's rating stays, a later label wins (S12 and K5)."""
    from candor.functions.text import review_hash
    from candor.sources.files import imported_reviews

    rows = imported_reviews(raw).select(F.lit(source).alias("source"), review_hash("text").alias("review_hash"), "text", "rating", "label", F.xxhash64("text", "rating", "label").alias("ordinal"))
    upsert_keyed(path, rows, IMPORTED, ["source", "review_hash"], "ordinal", ("text", "rating"), buckets)


IMPORTED = "source string, review_hash string, text string, rating int, label string"
