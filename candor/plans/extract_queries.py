"""Queries on extraction, greedy dedupe, the text model and streams.

No table holds product markup, so pages are made from parts; their SQL reads the parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import urls
from candor.operators import assembly, candidates, extract, labels, metrics, model, prices
from candor.plans.price_queries import DEBOUNCE
from candor.sources import tables as src
from candor.sources.staging import shared_folder, spread, staged
from candor.streaming import observations


def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part: JSON-LD, microdata, OpenGraph or a bare heading by its id. Parts are dealt to all tasks, as their
    pages take much more room and work than they do."""
    p = spread(src.table(spark, sf_dir, "part"), "p_partkey")
    k, name, price = F.col("p_partkey"), F.concat("p_name", F.lit(" "), "p_brand"), F.format_string("%.2f", "p_retailprice")
    ld = F.to_json(
        F.struct(
            F.lit("Product").alias("@type"), name.alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"),
            F.array(F.struct(price.alias("price"), F.lit("INR").alias("priceCurrency"), F.when(k % 8 == 0, "https://schema.org/OutOfStock").otherwise("https://schema.org/InStock").alias("availability"))).alias("offers"),
            F.array(F.struct(F.lit("Review").alias("@type"), F.concat(F.lit("Fine "), "p_name").alias("reviewBody"), F.struct(F.col("p_size").cast("string").alias("ratingValue")).alias("reviewRating"))).alias("review"),
        )
    )
    json = F.concat(F.lit('<html><head><script type="application/ld+json">'), ld, F.lit("</script></head><body></body></html>"))
    micro = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">'), name, F.lit('</span><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta itemprop="price" content="'), price, F.lit('"><meta itemprop="priceCurrency" content="INR"></div></div>'))
    meta = F.concat(F.lit('<meta property="og:title" content="'), name, F.lit('"><meta property="product:price:amount" content="'), price, F.lit('">'))
    bare = F.concat(F.lit("<h1>"), name, F.lit("</h1>"))
    return p.select(F.col("p_partkey").alias("part_id"), F.when(k % 4 == 0, json).when(k % 4 == 1, micro).when(k % 4 == 2, meta).otherwise(bare).alias("html"))


def product_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = extract.products(extract.read_pages(made_pages(spark, sf_dir)))
    return r.select("part_id", F.col("p_title").alias("title"), F.col("p_price").alias("price"), F.col("p_currency").alias("currency"), "in_stock", F.array_join("sources", ",").alias("sources"), "structured", "accepted")


PRODUCT = """
SELECT p_partkey AS part_id, p_name || ' ' || p_brand AS title, CASE WHEN p_partkey % 4 < 3 THEN CAST(printf('%.2f', p_retailprice) AS DOUBLE) END AS price, CASE WHEN p_partkey % 4 < 2 THEN 'INR' END AS currency,
       CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 8 <> 0 END AS in_stock, CASE p_partkey % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'micro' WHEN 2 THEN 'meta' ELSE 'page' END AS sources, p_partkey % 4 < 2 AS structured, p_partkey % 4 < 3 AS accepted FROM part
"""


def declared_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.declared_reviews(extract.read_pages(made_pages(spark, sf_dir)), "part_id").select("part_id", "text", "rating")


DECLARED = "SELECT p_partkey AS part_id, 'Fine ' || p_name AS text, CASE WHEN p_size BETWEEN 1 AND 5 THEN CAST(p_size AS INTEGER) END AS rating FROM part WHERE p_partkey % 4 = 0"


def provider_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a provider's JSON rows whose fields go by three names; 5 of each conversation."""
    c = src.table(spark, sf_dir, "conversations")
    name = lambda n: F.to_json(F.struct(F.col("text").alias(n), (F.col("turn") % 7).alias("rating")))
    raw = c.select("conv_id", F.col("turn").alias("ordinal"), F.when(F.col("turn") % 3 == 0, name("reviewText")).when(F.col("turn") % 3 == 1, name("text")).otherwise(name("body")).alias("json"))
    return extract.provider_reviews(raw, "conv_id", 5).select("conv_id", F.col("ordinal").alias("turn"), "rating")


PROVIDER = r"""
WITH c AS (SELECT conv_id, turn, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS t FROM conversations),
f AS (SELECT conv_id, min(turn) AS turn FROM c WHERE t IS NOT NULL GROUP BY conv_id, lower(t))
SELECT conv_id, turn, CASE WHEN turn % 7 BETWEEN 1 AND 5 THEN CAST(turn % 7 AS INTEGER) END AS rating FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5
"""


def same_listing_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of a part by the last digit of their store, titles with the price in them; greedy."""
    o = src.offers(spark, sf_dir).select("part_id", F.substring("store", -1, 1).alias("store"), F.concat("title", F.lit(" "), F.format_string("%.0f", F.col("price") / 500)).alias("title"), (-F.col("price")).alias("match_score"), "ordinal")
    return candidates.same_listing_dedupe(o, ["part_id"]).select("part_id", "store", "ordinal")


def review_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text model on the toxic label: trained on two splits of three, measured on the test split (ML1-ML4, A13)."""
    d = src.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = src.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).join(d.select("doc_id"), "doc_id", "left_semi")
    s = d.join(staged(metrics.stratified_split(marked, "doc_id", "label"), "split"), "doc_id")  # texts take no part in the ranking
    fitted = model.train(s.where("split <> 'test'").withColumn("weight", F.when(F.col("label") == 1, 5.0).otherwise(1.0)), features=1 << 14)
    p = model.probabilities(fitted, s.where("split = 'test'")).withColumn("score", F.round("probability", 6))
    return metrics.ranking(staged(p.select("label", "score"), "scored"), []).select("positives", "negatives", "roc_auc", "average_precision", "brier")


def leave_one_source_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity by language as a source that the model never saw: recall and false alarms of each (ML5)."""
    d = src.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(src.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id").where("lang is not null and label is not null")
    groups = [r[0] for r in d.select("lang").distinct().orderBy("lang").collect()]  # languages: few
    p = model.leave_one_out(d.withColumn("weight", F.when(F.col("label") == 1, 5.0).otherwise(1.0)), "lang", groups)
    return assembly.source_recall(p, "lang")


def review_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten terms that speak most for either side of the toxic label."""
    d = src.table(spark, sf_dir, "documents").select("doc_id", "text").join(src.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    fitted = model.train(d.where("label is not null"), features=1 << 14)
    return model.top_terms(model.term_weights(fitted, d)).select("side", "rank", "term", F.round("weight", 4).alias("weight"))


def second_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made pages read twice, every other second read being a bare one: the better of each two."""
    pages = made_pages(spark, sf_dir)
    late = pages.withColumn("html", F.when(F.col("part_id") % 2 == 0, F.lit("<p>wait</p>")).otherwise(F.col("html")))
    told = lambda d: extract.products(extract.read_pages(d)).select("part_id", "p_title", "p_price", "structured")  # noqa: E731  # raw layers stay behind
    best = extract.better_read(told(pages), told(late), "part_id")
    return best.select("part_id", F.col("p_title").alias("title"), F.col("p_price").alias("price"), "structured")


READS = "SELECT p_partkey AS part_id, p_name || ' ' || p_brand AS title, CASE WHEN p_partkey % 4 < 3 THEN CAST(printf('%.2f', p_retailprice) AS DOUBLE) END AS price, p_partkey % 4 < 2 AS structured FROM part"


def largest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.largest_dataset(src.table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset")))


LARGEST = "SELECT lang AS dataset, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 1"


def label_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.table(spark, sf_dir, "documents").select("doc_id", "lang").join(src.table(spark, sf_dir, "labels"), "doc_id")
    return labels.label_counts(d.withColumn("label", F.when(F.col("quality") == 1, "real").otherwise("fake")), ["lang"])


COUNTS = 'SELECT lang, count(*) FILTER (quality = 1) AS "real", count(*) FILTER (quality = 0) AS fake FROM documents JOIN labels USING (doc_id) GROUP BY lang'


def mapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with raw labels by id, of which two of three are in the mapping; one row for each text."""
    rows = src.table(spark, sf_dir, "documents").select(F.lit("docs").alias("dataset_name"), F.concat(F.lit("L"), F.col("doc_id") % 3).alias("raw_label"), "text", F.col("doc_id").alias("ordinal"))
    mapping = spark.createDataFrame([("docs", "L0", "real"), ("docs", "L1", "fake"), ("other", "L2", "real")], "dataset_name string, raw_label string, label string")
    return labels.mapped(rows, mapping).select("review_hash", "label")


MAPPED = r"""
SELECT sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS review_hash, arg_min(CASE doc_id % 3 WHEN 0 THEN 'real' ELSE 'fake' END, doc_id) AS label FROM documents WHERE doc_id % 3 < 2 GROUP BY 1
"""


def eligible_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stores of one category or one brand each; 8 for each part."""
    p = src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.concat(F.lit("s"), (F.col("p_partkey") % 100).cast("string")).alias("source_host"))
    types = F.array(*map(F.lit, ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")))
    k = F.col("s_suppkey")
    stores = src.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("store"), F.concat(F.lit("s"), k.cast("string")).alias("host"), (k % 9 != 0).alias("enabled"), F.array(F.element_at(types, (k % 6 + 1).cast("int"))).alias("categories"), F.when(k % 4 == 0, F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"))).alias("brand"), k.alias("ordinal")
    )
    return candidates.eligible_stores(p, stores).select("source_id", "store", "rank")


ELIGIBLE = """
WITH s AS (SELECT s_name AS store, 's' || s_suppkey AS host, ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'][s_suppkey % 6 + 1] AS cat, CASE WHEN s_suppkey % 4 = 0 THEN 'Brand#' || (s_suppkey % 25 + 1) END AS brand, s_suppkey FROM supplier WHERE s_suppkey % 9 <> 0),
j AS (SELECT p_partkey AS source_id, store, s_suppkey, CASE WHEN s.brand IS NULL THEN 1 ELSE 0 END AS b FROM part JOIN s ON (s.brand IS NULL AND s.cat = p_type) OR lower(s.brand) = lower(p_brand) WHERE host <> 's' || (p_partkey % 100))
SELECT source_id, store, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY b, s_suppkey) AS r FROM j) WHERE r <= 8
"""


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    files = batch.inputFiles()
    alone = len(files) == 1 and files[0].endswith("/events.parquet")  # a stream reads folders
    reader = spark.readStream.schema(batch.schema)
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if alone else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of closed days from the event stream; a day closes with the first event a watermark later (ST4)."""
    folder = shared_folder(spark, "stream")
    counts = observations.daily_counts(event_stream(spark, sf_dir), "user_id", "ts")
    counts.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/out")


def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch suppression of ``price_debounce``, on the stream (ST1)."""
    folder = shared_folder(spark, "stream")
    points = event_stream(spark, sf_dir).select("user_id", F.col("ts").alias("observed_at"), F.col("event_id").alias("ordinal"), F.floor(F.col("value") / 50.0).cast("double").alias("price"))
    kept = observations.suppressed(points, "user_id", minutes=720)
    kept.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{folder}/out")


def store_search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lit("https://shop.example/s?q={query}&n={slug}")
    return src.table(spark, sf_dir, "part").select("p_partkey", urls.search_url(t, F.concat("p_name", F.lit(" "), "p_brand")).alias("url"))


SEARCH = "SELECT p_partkey, 'https://shop.example/s?q=' || replace(replace(p_name || ' ' || p_brand, ' ', '+'), '#', '%23') || '&n=' || regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g') AS url FROM part"


def price_points_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different points of each part and how many of them are the newest 400."""
    return prices.newest_points(src.prices(spark, sf_dir), "part_id", 400).groupBy("part_id").agg(F.count("*").alias("points"))


POINTS = "WITH p AS (SELECT DISTINCT l_partkey AS part_id, l_shipdate, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_extendedprice > 0) SELECT part_id, least(count(*), 400) AS points FROM p GROUP BY part_id"

QUERIES = {
    f.__name__: f
    for f in (product_extract, declared_reviews, provider_reviews, same_listing_dedupe, review_model_metrics, leave_one_source_out, review_terms, second_reads, largest_source, label_counts_by_lang, mapped_labels, eligible_stores, stream_daily_counts, stream_debounce, store_search_urls, price_points_distinct)
}
ORACLE_SQL = {
    "product_extract": PRODUCT, "second_reads": READS, "declared_reviews": DECLARED, "provider_reviews": PROVIDER, "largest_source": LARGEST, "label_counts_by_lang": COUNTS, "mapped_labels": MAPPED, "eligible_stores": ELIGIBLE, "store_search_urls": SEARCH, "price_points_distinct": POINTS,
    "stream_debounce": DEBOUNCE.replace("SELECT user_id, ts AS observed_at, event_id, price FROM walk", "SELECT user_id, ts AS observed_at, price FROM walk"),
}
