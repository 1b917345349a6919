"""Queries on what is put together from the parts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import text as tx
from candor.operators import assembly
from candor.plans.page_queries import HOST_SQL, PATH_SQL
from candor.sources import tables as src

HASH_SQL = r"sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')))"


def page_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platforms of page addresses; hosts that name one are made from example hosts by id."""
    k = F.col("page_id")
    u = F.when(k % 3 == 0, F.replace("url", F.lit("example"), F.lit("amazon"))).when(k % 7 == 0, "no address").otherwise(F.col("url"))
    return src.table(spark, sf_dir, "pages").select("page_id", assembly.platform(u).alias("platform"))


PLATFORM = rf"""
WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, 'example', 'amazon') WHEN page_id % 7 = 0 THEN 'no address' ELSE url END AS url FROM pages), h AS (SELECT page_id, {HOST_SQL} AS h FROM u)
SELECT page_id, CASE WHEN contains(h, 'amazon') THEN 'Amazon' WHEN replace(h, 'www.', '') <> '' THEN replace(h, 'www.', '') ELSE 'Unknown store' END AS platform FROM h
"""


def page_product_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = spark.createDataFrame([("example.com", "Com", ["/de/", "?page="]), ("example.org", "Org", ["/en/1"]), ("blog.example.net", "Blog", [])], "domain string, store string, patterns array<string>")
    return assembly.product_address(src.table(spark, sf_dir, "pages").select("page_id", "url"), "url", stores, "page_id").select("page_id", "store", "is_product")


ADDRESS = rf"""
WITH p AS (SELECT page_id, {HOST_SQL} AS h, {PATH_SQL} || CASE WHEN regexp_extract(url, '^[^?#]*\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1) ELSE '' END AS t FROM pages),
s AS (SELECT *, CASE WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN 'Com' WHEN h = 'example.org' OR ends_with(h, '.example.org') THEN 'Org' WHEN h = 'blog.example.net' OR ends_with(h, '.blog.example.net') THEN 'Blog' END AS store FROM p)
SELECT page_id, store, coalesce(store = 'Com' AND (contains(t, '/de/') OR contains(t, '?page=')) OR store = 'Org' AND contains(t, '/en/1'), FALSE) AS is_product FROM s
"""


def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scraped sources, of which every third is declared by its page too, with gaps by id."""
    p, k = src.table(spark, sf_dir, "part"), F.col("p_partkey")
    gap = lambda n, c: F.when(k % n != 0, c)
    none = lambda kind: F.lit(None).cast(kind)
    scraped = p.select(k.alias("part_id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"), none("string").alias("image_url"), gap(2, F.lit(4.0)).alias("rating"), gap(5, F.lit(10)).alias("review_count"), F.when(k % 4 == 0, "").alias("sku"), F.lit("INR").alias("currency"))
    d = p.where(k % 3 == 0)
    declared = d.select(
        k.alias("part_id"), gap(7, F.upper("p_name")).alias("title"), gap(4, F.col("p_retailprice") + 1).alias("price"), none("string").alias("brand"), F.concat(F.lit("i"), k).alias("image_url"), F.lit(3.0).alias("rating"), F.lit(20).alias("review_count"), gap(6, F.concat(F.lit("s"), k)).alias("sku"), gap(5, F.lit("usd")).alias("currency"),
        F.concat(F.lit("g"), k).alias("gtin"), gap(9, F.concat(F.lit("m"), k)).alias("mpn"), (k % 2 == 0).alias("in_stock"),
    )
    return assembly.merged_source(scraped, declared, "part_id")


MERGED = """
WITH x AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS d, * FROM part)
SELECT k AS part_id, CASE WHEN d AND k % 7 <> 0 THEN upper(p_name) ELSE p_name END AS title, CASE WHEN d AND k % 4 <> 0 THEN p_retailprice + 1 ELSE p_retailprice END AS price, p_brand AS brand, CASE WHEN d THEN 'i' || k END AS image_url,
  CASE WHEN k % 2 <> 0 THEN 4.0::DOUBLE WHEN d THEN 3.0::DOUBLE END AS rating, CASE WHEN k % 5 <> 0 THEN 10 WHEN d THEN 20 END AS review_count, CASE WHEN d AND k % 6 <> 0 THEN 's' || k WHEN d AND k % 9 <> 0 THEN 'm' || k END AS sku,
  CASE WHEN d AND k % 5 <> 0 THEN 'USD' ELSE 'INR' END AS currency, CASE WHEN d THEN 'g' || k END AS gtin, CASE WHEN d AND k % 9 <> 0 THEN 'm' || k END AS mpn, CASE WHEN d THEN k % 2 = 0 END AS in_stock FROM x
"""


def hashed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human labels by text: the label of the least id of each text."""
    d = src.table(spark, sf_dir, "documents").join(src.table(spark, sf_dir, "labels"), "doc_id").withColumn("review_hash", tx.review_hash("text"))
    return d.groupBy("review_hash").agg(F.min_by(F.when(F.col("quality") == 1, "real").otherwise("fake"), "doc_id").alias("label"))


LABELS_SQL = f"lab AS (SELECT {HASH_SQL} AS h, arg_min(CASE quality WHEN 1 THEN 'real' ELSE 'fake' END, doc_id) AS label FROM documents JOIN labels USING (doc_id) GROUP BY 1)"


def findings_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.labelled_findings(src.table(spark, sf_dir, "documents").select("doc_id", "text"), hashed_labels(spark, sf_dir)).select("doc_id", "label")


def findings_that_have_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.has_label(src.table(spark, sf_dir, "documents").select("doc_id", "text"), hashed_labels(spark, sf_dir)).select("doc_id")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers as scored listings: relation, differences, likenesses and prices by id."""
    k = F.col("ordinal")
    note = F.array(F.lit(assembly.UNCONFIRMED))
    return src.offers(spark, sf_dir).select(
        "part_id", k.alias("listing_id"), "price", "in_stock", F.when(k % 3 == 0, "exact").when(k % 3 == 1, "similar").otherwise("none").alias("relation"), F.when(k % 2 == 0, note).otherwise(F.array(F.lit("other size"))).alias("differences"),
        (k % 10 / 10.0).alias("image"), F.when(k % 4 == 0, "u").alias("image_url"), (k % 7 / 10.0).alias("title"), "ordinal",
    )


LISTINGS_SQL = """
f AS (SELECT l_partkey, l_suppkey, arg_min({'k': l_orderkey * 10 + l_linenumber, 'price': l_extendedprice / l_quantity, 'out': l_returnflag = 'R'}, (l_shipdate, l_orderkey, l_linenumber)) AS x FROM lineitem GROUP BY 1, 2),
li AS (SELECT l_partkey AS part_id, x.k AS k, x.price AS price, x.out AS sold, CASE x.k % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'similar' ELSE 'none' END AS relation, x.k % 2 = 0 AS note FROM f)
"""


def listing_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = assembly.views(F.col("image"), F.col("image_url"), F.col("title"))
    return listings(spark, sf_dir).select("listing_id", assembly.same_product("relation", "differences").alias("compared"), v.alias("v")).select("listing_id", "compared", "v.image", "v.text", "v.both")


VIEWS = f"""
WITH {LISTINGS_SQL}, v AS (SELECT k, relation = 'exact' OR (relation = 'similar' AND note) AS compared, k % 10 / 10.0 >= 0.5 OR k % 4 = 0 AS image, k % 7 / 10.0 >= 0.25 AS text FROM li)
SELECT k AS listing_id, compared, image, text, image AND text AS both FROM v
"""


def listing_relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.relation_counts(listings(spark, sf_dir), "part_id", F.struct("price", "listing_id"))


RELATIONS = f"""
WITH {LISTINGS_SQL}
SELECT part_id, count(*) FILTER (relation = 'exact') AS exact_count, count(*) FILTER (relation = 'similar') AS similar_count, arg_min(k, (price, k)) FILTER (relation = 'exact' OR relation = 'similar' AND note) AS best_listing FROM li GROUP BY part_id
"""


def listing_comparison_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = listings(spark, sf_dir).withColumns({"eligible": F.col("in_stock") & (F.col("relation") == "exact"), "possible": F.col("relation") == "similar"})
    return assembly.comparison_order(o, "part_id").select("part_id", "listing_id", "place")


ORDER = f"""
WITH {LISTINGS_SQL}, r AS (SELECT *, CASE WHEN relation = 'similar' THEN 2 WHEN NOT sold AND relation = 'exact' THEN 0 ELSE 1 END AS r FROM li)
SELECT part_id, k AS listing_id, CAST(row_number() OVER (PARTITION BY part_id ORDER BY r, CASE WHEN r = 0 THEN price END NULLS FIRST, k) AS INTEGER) AS place FROM r
"""


def history_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price points of the last 180 days before the newest year's end, by part."""
    p = src.prices(spark, sf_dir).where(assembly.in_range(F.col("observed_at").cast("timestamp"), F.lit("1998-12-01").cast("timestamp")))
    return p.groupBy("part_id").agg(F.count("*").alias("points"))


RANGE = "SELECT l_partkey AS part_id, count(*) AS points FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-12-01' - INTERVAL 180 DAY GROUP BY 1"


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a made-up probability, and the language of their document as source."""
    l = src.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"), (F.col("doc_id") * 37 % 101 / 100.0).alias("probability"))
    return l.join(src.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


SCORED_SQL = "sl AS (SELECT doc_id, toxic AS label, doc_id * 37 % 101 / 100.0 AS p, lang FROM labels JOIN documents USING (doc_id))"


def probability_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.bands(scored_labels(spark, sf_dir), ["lang"])


BANDS = f"""
WITH {SCORED_SQL}
SELECT lang, count(*) AS n, round(avg(CASE WHEN p <= 0.045 THEN 1.0::DOUBLE ELSE 0 END), 4) AS genuine_share, round(avg(CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (p <= 0.045), 4) AS real_within_genuine,
  round(avg(CASE WHEN p > 0.045 AND p < 0.9 THEN 1.0::DOUBLE ELSE 0 END), 4) AS uncertain_share, round(avg(CASE WHEN p >= 0.9 THEN 1.0::DOUBLE ELSE 0 END), 4) AS flagged_share, round(avg(CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0 END) FILTER (p >= 0.9), 4) AS fake_within_flagged FROM sl GROUP BY lang
"""


def recall_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.source_recall(scored_labels(spark, sf_dir), "lang")


RECALL = f"""
WITH {SCORED_SQL}
SELECT lang, count(*) AS test_rows, round(avg(CASE WHEN p >= 0.9 THEN 1.0::DOUBLE ELSE 0 END) FILTER (label = 1), 4) AS recall_at_flag, round(avg(CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (label = 1), 4) AS recall_at_half,
  round(avg(CASE WHEN p >= 0.9 THEN 1.0::DOUBLE ELSE 0 END) FILTER (label <> 1), 4) AS real_flagged FROM sl GROUP BY lang
"""

QUERIES = {
    f.__name__: f
    for f in (page_platforms, page_product_address, merged_sources, findings_with_labels, findings_that_have_labels, listing_views, listing_relation_counts, listing_comparison_order, history_in_range, probability_bands, recall_by_source)
}
ORACLE_SQL = {
    "page_platforms": PLATFORM, "page_product_address": ADDRESS, "merged_sources": MERGED, "findings_with_labels": f"WITH {LABELS_SQL} SELECT doc_id, label FROM documents LEFT JOIN lab ON h = {HASH_SQL}",
    "findings_that_have_labels": f"WITH {LABELS_SQL} SELECT doc_id FROM documents WHERE {HASH_SQL} IN (SELECT h FROM lab)", "listing_views": VIEWS, "listing_relation_counts": RELATIONS, "listing_comparison_order": ORDER, "history_in_range": RANGE, "probability_bands": BANDS, "recall_by_source": RECALL,
}
