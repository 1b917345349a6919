"""Queries on keyed tables, imports, gates and small parts, and their SQL. Tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions.text import review_hash
from candor.operators import assembly, candidates, labels, metrics
from candor.plans.price_queries import DEBOUNCE
from candor.plans.review_queries import FINDINGS_SQL, findings
from candor.sources import files, keyed, sinks
from candor.sources import tables as src
from candor.sources.staging import shared_folder

HASH_SQL = r"sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')))"
SEEN = "product string, review_hash string, first_seen int, last_seen int, rating int"


def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of their source as observed reviews, in two batches of which the second sees every third again: the first
    sight stays, the last one and the rating are those of the later row (K1)."""
    path = f"{shared_folder(spark, 'keyed')}/reviews"
    d = src.table(spark, sf_dir, "documents").where("text is not null")
    row = lambda day, rating: d.select(F.col("source").alias("product"), review_hash("text").alias("review_hash"), F.lit(day).alias("first_seen"), F.lit(day).alias("last_seen"), rating.cast("int").alias("rating"), F.col("doc_id").alias("ordinal"))
    keyed.upsert_keyed(path, row(1, F.col("doc_id") % 5), SEEN, ["product", "review_hash"], "ordinal", ("first_seen",), 16)
    keyed.upsert_keyed(path, row(2, F.col("doc_id") % 7).where("ordinal % 3 = 0"), SEEN, ["product", "review_hash"], "ordinal", ("first_seen",), 16)
    return keyed.read_keyed(spark, path, SEEN)


UPSERTED = f"""
WITH r AS (SELECT source AS product, {HASH_SQL} AS review_hash, doc_id FROM documents WHERE text IS NOT NULL), g AS (SELECT product, review_hash, max(doc_id) AS a, max(doc_id) FILTER (doc_id % 3 = 0) AS b FROM r GROUP BY ALL)
SELECT product, review_hash, CAST(1 AS INTEGER) AS first_seen, CAST(CASE WHEN b IS NULL THEN 1 ELSE 2 END AS INTEGER) AS last_seen, CAST(coalesce(b % 7, a % 5) AS INTEGER) AS rating FROM g
"""


def suppressed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as prices of their user, stored in two batches: what repeats the last stored price within 12 hours isn't (K3)."""
    path = f"{shared_folder(spark, 'keyed')}/points"
    p = src.event_prices(spark, sf_dir).select("user_id", F.col("observed_at").cast("timestamp").alias("observed_at"), "price", "ordinal")
    middle = F.lit("2024-01-15").cast("timestamp")
    for part in (p.where(F.col("observed_at") < middle), p.where(F.col("observed_at") >= middle)):
        keyed.append_suppressed(path, part, "user_id", 720, 16)
    return keyed.read_keyed(spark, path, "user_id bigint, observed_at timestamp, ordinal bigint, price double").select("user_id", F.col("ordinal").alias("event_id"), "price")


def imported_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as CSV and imported by the rules of foreign files: blank texts go, ratings of 1 to 5, one row a text."""
    at = shared_folder(spark, "import")
    c = src.table(spark, sf_dir, "conversations")
    c.select(F.col("text").alias("review_text"), (F.col("turn") % 8).cast("string").alias("rating"), F.col("role").alias("label")).write.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{at}/csv")
    keyed.import_reviews(f"{at}/table", files.read_csv(spark, f"{at}/csv"), "csv", 16)
    return keyed.read_keyed(spark, f"{at}/table", keyed.IMPORTED).select("review_hash", "source")


IMPORTED = rf"SELECT DISTINCT {HASH_SQL} AS review_hash, 'csv' AS source FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''"


def stored_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as price points appended by bucket, read back as a history, counted by part (K2, S15); a path without a table is empty."""
    at = shared_folder(spark, "history")
    p = src.prices(spark, sf_dir).select(F.col("part_id").cast("string").alias("url"), F.col("observed_at").cast("timestamp").alias("observed_at"), "price")
    sinks.append_observations(p, f"{at}/points", 8)
    found = files.price_history(spark, f"{at}/points").unionByName(files.price_history(spark, f"{at}/nothing"))
    return found.groupBy("url").agg(F.count("*").alias("points"), F.round(F.sum("price"), 2).alias("total"))


HISTORY = "SELECT CAST(l_partkey AS VARCHAR) AS url, count(*) AS points, round(sum(l_extendedprice / l_quantity), 2) AS total FROM lineitem GROUP BY 1"


def registry_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as a registry file and read as one."""
    at = shared_folder(spark, "registry")
    s = src.table(spark, sf_dir, "supplier")
    one = F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("host"), F.array(F.lit("tools")).alias("categories"), F.when(F.col("s_suppkey") % 5 == 0, False).alias("enabled"))
    text = s.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("s_name"), one))))).alias("value"))  # a registry: one row a store
    text.coalesce(1).write.text(f"{at}/stores")
    return files.store_registry(spark, f"{at}/stores/*.txt").select("store", "host", "enabled")


REGISTRY = "SELECT s_name AS store, 's' || s_suppkey || '.example' AS host, s_suppkey % 5 <> 0 AS enabled FROM supplier"


def gated_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with a title that aren't of the source's own store, without noise (FL1, FL2)."""
    o = src.offers(spark, sf_dir)
    l = o.select("part_id", "store", "ordinal", "price", F.when(F.col("part_id") % 7 != 0, "title").otherwise(" ").alias("title"), F.lit("u").alias("url"), F.when(F.col("part_id") % 3 == 0, F.upper("store")).otherwise("x").alias("source_store"), (F.col("part_id") % 5 / 10).alias("likeness"))
    l = l.withColumn("title", F.when(F.trim("title") == "", None).otherwise(F.coalesce(F.nullif(F.trim("title"), F.lit("title")), F.lit("t"))))
    kept = candidates.candidate_gate(l)
    return kept.where(candidates.noise_gate(F.when(F.col("ordinal") % 2 == 0, F.col("price")), F.col("likeness"), F.col("ordinal") % 11 == 0, F.col("part_id") % 2 == 0)).select("part_id", "store", "ordinal")


def best_of_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of one part, folded to four addresses; the most alike stays, the first of equals."""
    o = src.offers(spark, sf_dir).select("part_id", (F.col("ordinal") % 4).alias("url_key"), "ordinal", (F.col("ordinal") % 10 / 10).alias("title_similarity"))
    return candidates.keep_best_by_url(o, ["part_id"]).select("part_id", "url_key", "ordinal")


OFFERS_SQL = "o AS (SELECT l_partkey AS part_id, s_name AS store, arg_min(l_orderkey * 10 + l_linenumber, (l_shipdate, l_orderkey, l_linenumber)) AS ordinal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
GATED = f"""
WITH {OFFERS_SQL} SELECT part_id, store, ordinal FROM o WHERE part_id % 7 <> 0 AND part_id % 3 <> 0 AND NOT (ordinal % 2 <> 0 AND part_id % 5 / 10 < 0.15) AND NOT (ordinal % 11 = 0 AND part_id % 2 <> 0)
"""
BEST = f"WITH {OFFERS_SQL} SELECT part_id, ordinal % 4 AS url_key, arg_max(ordinal, (ordinal % 10, -ordinal)) AS ordinal FROM o GROUP BY ALL"


def similar_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as similar products: those with a stated difference last, then closeness, then price; five each."""
    p = src.titles(spark, sf_dir)
    l = p.select("brand", "part_id", "price", F.col("part_id").alias("ordinal"), F.when(F.col("part_id") % 3 == 0, F.array(F.lit("other size"))).otherwise(F.array().cast("array<string>")).alias("differences"), (F.col("part_id") % 9 / 10).alias("closeness"))
    return candidates.similar_ranked(l, ["brand"], 5).select("brand", "part_id", "rank")


SIMILAR = "SELECT p_brand AS brand, p_partkey AS part_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 3 = 0, p_partkey % 9 DESC, p_retailprice, p_partkey) AS INTEGER) AS rank FROM part QUALIFY rank <= 5"


def part_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts cited, as the JSON of an answer (K6, K8)."""
    p = src.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("t"), F.concat(F.lit("https://x.example/"), F.col("p_partkey")).alias("u"))
    ieee, bib = labels.citation("t", "u")
    return sinks.as_json(p.select("p_partkey", ieee.alias("ieee"), bib.alias("bibtex")), "p_partkey").select("p_partkey", F.get_json_object("json", "$.ieee").alias("ieee"), F.get_json_object("json", "$.bibtex").alias("bibtex"))


CITED = r"""SELECT p_partkey, '"' || p_name || '," [Online]. Available: https://x.example/' || p_partkey AS ieee, '@misc{listing, title = {' || p_name || '}, howpublished = {\url{https://x.example/' || p_partkey || '}}}' AS bibtex FROM part"""


def rule_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules alone on the labelled documents of the test split, quality 0 as fake."""
    s = metrics.stratified_split(src.table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", (1 - F.col("quality")).alias("label")), "doc_id", "label").where("split = 'test'")
    return assembly.rule_baseline(findings(spark, sf_dir).join(s, F.col("review_id") == F.col("doc_id")))


BASELINE = f"""
WITH {FINDINGS_SQL}, r AS (SELECT doc_id, 1 - quality AS y, row_number() OVER (PARTITION BY quality ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS p, count(*) OVER (PARTITION BY quality) AS n FROM labels WHERE quality IS NOT NULL),
j AS (SELECT y = 1 AS fake, classification = 'suspicious' AS said FROM findings JOIN r ON review_id = doc_id WHERE p >= floor(n * (0.7::DOUBLE + 0.15::DOUBLE))),
c AS (SELECT count(*) FILTER (said AND fake) AS tp, count(*) FILTER (said AND NOT fake) AS fp, count(*) FILTER (NOT said AND fake) AS fn, count(*) FILTER (NOT said AND NOT fake) AS tn FROM j)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS "precision", CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall FROM c
"""


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint for each split that is the same for any order of its rows; shown are its counts and form."""
    d = src.table(spark, sf_dir, "documents").join(src.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    s = metrics.stratified_split(d.select("doc_id", "text", "toxic"), "doc_id", "toxic")
    a, b = assembly.split_fingerprint(s, "doc_id", "text", "split"), assembly.split_fingerprint(s.orderBy(F.desc("text")), "doc_id", "text", "split").select("split", F.col("fingerprint").alias("again"))
    return a.join(b, "split").select("split", "n", (F.col("fingerprint") == F.col("again")).alias("same"), F.length("fingerprint").alias("places"))


SPLITS = """
WITH r AS (SELECT toxic, row_number() OVER (PARTITION BY toxic ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS p, count(*) OVER (PARTITION BY toxic) AS n FROM labels JOIN documents USING (doc_id))
SELECT CASE WHEN p < floor(n * 0.7::DOUBLE) THEN 'train' WHEN p < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'valid' ELSE 'test' END AS split, count(*) AS n, true AS same, CAST(64 AS INTEGER) AS places FROM r GROUP BY 1
"""


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human labels with the first text of their hash."""
    d = src.table(spark, sf_dir, "documents")
    l = labels.save_labels(spark.createDataFrame([], "review_hash string, label string"), d.select("text", F.when(F.col("doc_id") % 2 == 0, "real").otherwise("fake").alias("label"), F.col("doc_id").alias("ordinal")))
    return labels.with_first_text(l, d.select("text", F.col("doc_id").alias("ordinal"))).select("review_hash", "label", F.length("text").alias("n_chars"))


TEXTS = f"""
WITH d AS (SELECT doc_id, text, {HASH_SQL} AS h FROM documents WHERE text IS NOT NULL), l AS (SELECT h, arg_max(CASE WHEN doc_id % 2 = 0 THEN 'real' ELSE 'fake' END, doc_id) AS label FROM d WHERE trim(text) <> '' AND length(text) <= 5000 GROUP BY h)
SELECT l.h AS review_hash, label, CAST(length(arg_min(text, doc_id)) AS INTEGER) AS n_chars FROM l JOIN d USING (h) GROUP BY l.h, label
"""

QUERIES = {f.__name__: f for f in (keyed_upsert, suppressed_append, imported_labels, stored_observations, registry_stores, gated_listings, best_of_address, similar_order, part_citations, rule_baseline, split_counts, labelled_texts)}
ORACLE_SQL = {
    "suppressed_append": DEBOUNCE.replace("SELECT user_id, ts AS observed_at, event_id, price FROM walk", "SELECT user_id, event_id, price FROM walk"), "rule_baseline": BASELINE, "keyed_upsert": UPSERTED, "imported_labels": IMPORTED, "stored_observations": HISTORY, "registry_stores": REGISTRY, "gated_listings": GATED, "best_of_address": BEST, "similar_order": SIMILAR, "part_citations": CITED, "split_counts": SPLITS, "labelled_texts": TEXTS,
}
