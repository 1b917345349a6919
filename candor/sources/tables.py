"""Tables of the engine: readers with stated schemas and proxies of the domain on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer for each part and supplier, the earliest line: part_id, store, price, in_stock, currency, title, ordinal."""
    line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    # The earliest line by aggregation, not by a window: partial sums meet before the shuffle.
    first = line.groupBy("l_partkey", "l_suppkey").agg(
        F.min_by(F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"), F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("x")
    )
    return (
        first.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_partkey").alias("part_id"),
            F.col("s_name").alias("store"),
            (F.col("x.l_extendedprice") / F.col("x.l_quantity")).alias("price"),
            (F.col("x.l_returnflag") != "R").alias("in_stock"),
            F.when(F.col("s_nationkey") % 7 == 0, "USD").otherwise("INR").alias("currency"),
            F.col("p_name").alias("title"),
            F.lit(False).alias("is_source"),
            (F.col("x.l_orderkey") * 10 + F.col("x.l_linenumber")).alias("ordinal"),
        )
    )


def source_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part itself as the source listing."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"), F.lit("source").alias("store"), F.col("p_retailprice").alias("price"), F.lit(True).alias("in_stock"), F.lit("INR").alias("currency"), F.col("p_name").alias("title"), F.lit(True).alias("is_source"), F.lit(0).cast("long").alias("ordinal")
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews of their source: review_id, product, text, rating, verified."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("review_id"), F.col("source").alias("product"), "text", (F.col("doc_id") % 5 + 1).cast("int").alias("rating"), (F.col("doc_id") % 3 == 0).alias("verified"), "lang")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as price observations of their part: part_id, observed_at, price."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_id"), F.col("l_shipdate").alias("observed_at"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def event_prices(spark: SparkSession, sf_dir: str, bucket: float = 50.0) -> DataFrame:
    """Events as price observations of their user: user_id, observed_at, price, ordinal."""
    return table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("observed_at"), F.floor(F.col("value") / bucket).cast("double").alias("price"), F.col("event_id").alias("ordinal"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as titled products: part_id, title, brand, category, price."""
    p = table(spark, sf_dir, "part")
    title = F.concat_ws(" ", "p_brand", "p_name", "p_type", F.col("p_size").cast("string"), F.lit("cm"))
    return p.select(F.col("p_partkey").alias("part_id"), title.alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"), "p_name", "p_size")
