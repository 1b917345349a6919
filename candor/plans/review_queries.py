"""Queries on reviews, duplicates and posting activity, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import text as tx
from candor.operators import neardup, reviews
from candor.sources import tables as src
from candor.sources.staging import staged

#: Lexicon entries that occur in the invented prose of the documents.
GOOD, BAD = ("tion", "enst", "ment"), ("scum", "idiot", "worthless", "trash", "stin")
PROMO = (r"\b(?:the the)\b", r"\b(?:stupid|scum)\b")
LIST = lambda words: ", ".join(f"'{w}'" for w in words)

KEY_SQL = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g'))"
PAIRS_SQL = rf"""
ws AS (SELECT doc_id AS id, list_filter(string_split({KEY_SQL}, ' '), lambda w: w <> '') AS w FROM documents),
gs AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS g FROM ws WHERE len(w) >= 4),
ex AS (SELECT id, len(g) AS n, unnest(g) AS gram FROM gs),
df AS (SELECT gram FROM ex GROUP BY gram HAVING count(*) > 1),
kx AS (SELECT ex.* FROM ex JOIN df USING (gram)),
pairs AS (
  SELECT a.id AS a, b.id AS b, count(*) AS overlap, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard
  FROM kx AS a JOIN kx AS b ON a.gram = b.gram AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8
)
"""
WHOLE_SQL = rf"""
ws AS (SELECT doc_id AS id, list_filter(string_split({KEY_SQL}, ' '), lambda w: w <> '') AS w FROM documents),
gs AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')))) AS g FROM ws WHERE len(w) >= 4),
cl AS (SELECT min(id) AS id, g, count(*) AS c FROM gs GROUP BY g),
cx AS (SELECT id, len(g) AS n, unnest(g) AS gram FROM cl),
cp AS (
  SELECT a.id AS a, b.id AS b, count(*) AS overlap, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard
  FROM cx AS a JOIN cx AS b ON a.gram = b.gram AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8
)
"""
SENTIMENT_SQL = f"""
lex AS (SELECT *, (SELECT count(*) FROM (VALUES {", ".join(f"('{w}')" for w in GOOD)}) AS v(w) WHERE contains(lower(text), w)) AS p,
               (SELECT count(*) FROM (VALUES {", ".join(f"('{w}')" for w in BAD)}) AS v(w) WHERE contains(lower(text), w)) AS q FROM documents),
sent AS (SELECT *, CASE WHEN p + q > 0 THEN round((p - q) / (p + q), 2) ELSE 0.0 END AS sentiment, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_words, CAST(doc_id % 5 + 1 AS INTEGER) AS rating FROM lex)
""".replace("\\\\s", "\\s")
FINDINGS_SQL = f"""
{WHOLE_SQL}, near AS (SELECT a AS id FROM cp UNION SELECT b FROM cp), dup AS (SELECT gs.id FROM gs JOIN cl USING (g) WHERE cl.c > 1 OR cl.id IN (SELECT id FROM near)), {SENTIMENT_SQL},
f AS (
  SELECT doc_id AS review_id, source AS product, text, rating, sentiment, n_words, doc_id IN (SELECT id FROM dup) AS nd,
         regexp_matches(lower(text), '{PROMO[0]}') OR regexp_matches(lower(text), '{PROMO[1]}') AS promo, rating >= 4 AND sentiment <= -0.4 AS over_, rating <= 2 AND sentiment >= 0.5 AS under_, n_words <= 4 AND rating = 5 AND sentiment > 0.5 AS praise
  FROM sent
), g AS (
  SELECT *, round(CASE WHEN promo THEN 0.6 ELSE 0 END + CASE WHEN over_ THEN 0.5 ELSE 0 END + CASE WHEN under_ THEN 0.45 ELSE 0 END + CASE WHEN praise THEN 0.2 ELSE 0 END + CASE WHEN nd THEN 0.55 ELSE 0 END, 2) AS suspicion,
         promo OR over_ OR under_ OR praise OR nd AS any_signal
  FROM f
), findings AS (
  SELECT *, CASE WHEN suspicion >= 0.5 THEN 'suspicious' WHEN n_words >= 8 AND NOT any_signal THEN 'genuine-looking' ELSE 'needs-review' END AS classification,
         CASE WHEN suspicion >= 0.5 THEN least(0.92, round(0.5 + suspicion * 0.35, 2)) WHEN n_words >= 8 AND NOT any_signal THEN 0.58 ELSE 0.35 END AS confidence,
         CASE WHEN suspicion >= 0.8 THEN 'high' WHEN suspicion < 0.5 AND n_words >= 8 AND NOT any_signal THEN 'low' ELSE 'medium' END AS risk
  FROM g
)
"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = src.reviews(spark, sf_dir)
    dup = staged(neardup.whole_flagged(r, "review_id", "text").select(F.col("id").alias("review_id"), F.lit(True).alias("near_duplicate")), "flagged")  # known to be few: texts stay where they are
    marked = r.join(dup, "review_id", "left").withColumn("near_duplicate", F.coalesce("near_duplicate", F.lit(False)))
    return reviews.rule_findings(marked, GOOD, BAD, PROMO)


def neardup_trigram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = neardup.similar_pairs(src.table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.select("a", "b", "overlap", F.round("jaccard", 6).alias("jaccard"))


def neardup_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.whole_flagged(src.table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def neardup_whole_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different gram sets, without a limit on how common a gram is; a and b are the least ids of their sets' texts."""
    p = neardup.class_pairs(neardup.gram_classes(src.table(spark, sf_dir, "documents"), "doc_id", "text"))
    return p.select("a", "b", "overlap", F.round("jaccard", 6).alias("jaccard"))


def neardup_whole_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.whole_flagged(src.table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def neardup_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates within a product: by characters in small products, by grams in those of over 150 texts."""
    return neardup.exact_flagged(src.table(spark, sf_dir, "documents"), "source", "doc_id", "text").withColumnRenamed("id", "doc_id")


def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.exact_groups(src.table(spark, sf_dir, "documents"), "doc_id", tx.review_hash("text")).select(F.col("key").alias("review_hash"), "first_id", "n")


EXACT = r"""
SELECT sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS review_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1
"""


def distinct_ratio_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.table(spark, sf_dir, "documents").groupBy("source", F.xxhash64("text").alias("h"), "text").agg(F.count("*").alias("n"))
    return d.groupBy("source").agg(F.sum("n").alias("n_reviews"), F.count("*").alias("n_distinct"), F.round(F.count("*") / F.sum("n"), 2).alias("unique_text_ratio"))


DISTINCT = "SELECT source, count(*) AS n_reviews, count(DISTINCT text) AS n_distinct, round(count(DISTINCT text) / count(*), 2) AS unique_text_ratio FROM documents GROUP BY source"


def sentiment_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "documents").select("doc_id", tx.sentiment("text", GOOD, BAD).alias("sentiment"), tx.word_count("text").alias("n_words"))


def review_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("review_id", "product", "sentiment", "near_duplicate", "suspicion", "classification", "confidence", "risk")


def two_way_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("review_id") % 4 != 0, (F.col("review_id") * 37 % 100) / 100)
    v = reviews.two_way_verdict(F.col("classification"), F.col("confidence"), F.col("probability"))
    return findings(spark, sf_dir).withColumn("probability", p).withColumn("v", v).select("review_id", "classification", "v.verdict", F.col("v.certainty").alias("certainty"), F.col("v.note").alias("note"))


VERDICT = f"""
WITH {FINDINGS_SQL}, p AS (SELECT *, CASE WHEN review_id % 4 <> 0 THEN (review_id * 37 % 100) / 100 END AS prob FROM findings)
SELECT review_id, classification,
       CASE classification WHEN 'suspicious' THEN 'not_genuine' WHEN 'genuine-looking' THEN 'genuine' ELSE CASE WHEN prob >= 0.5 THEN 'not_genuine' ELSE 'genuine' END END AS verdict,
       CASE WHEN classification = 'suspicious' AND confidence >= 0.7 OR classification = 'genuine-looking' AND confidence >= 0.8 THEN 'clear' ELSE 'limited' END AS certainty,
       CASE WHEN classification = 'needs-review' THEN CASE WHEN prob IS NOT NULL THEN 'close call' ELSE 'too short to judge' END END AS note
FROM p
"""


def model_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("review_id") % 4 != 0, (F.col("review_id") * 37 % 100) / 100)
    return reviews.merge_model(findings(spark, sf_dir).withColumn("probability", p)).select("review_id", "detector", "classification", F.round("confidence", 4).alias("confidence"), "risk", F.try_element_at("signals", F.lit(-1)).alias("last_signal"))


MERGE = f"""
WITH {FINDINGS_SQL}, p AS (SELECT *, CASE WHEN review_id % 4 <> 0 THEN (review_id * 37 % 100) / 100 END AS prob FROM findings)
SELECT review_id, CASE WHEN prob IS NULL THEN 'rules' ELSE 'ml+rules' END AS detector,
       CASE WHEN prob IS NULL OR classification = 'suspicious' THEN classification WHEN prob >= 0.9 THEN 'suspicious' WHEN prob <= 0.045 AND NOT any_signal THEN 'genuine-looking' ELSE 'needs-review' END AS classification,
       round(CASE WHEN prob IS NULL THEN confidence WHEN prob >= 0.9 THEN greatest(CASE WHEN classification = 'suspicious' THEN confidence ELSE 0 END, least(0.95, round(prob, 2)))
            WHEN classification = 'suspicious' THEN confidence WHEN prob <= 0.045 AND NOT any_signal THEN least(0.9, round(1 - prob, 2)) ELSE 0.45 END, 4) AS confidence,
       CASE WHEN prob IS NULL THEN risk WHEN prob >= 0.95 THEN 'high' WHEN prob >= 0.9 THEN 'medium' WHEN classification = 'suspicious' THEN risk WHEN prob <= 0.045 AND NOT any_signal THEN 'low' ELSE 'medium' END AS risk,
       CASE WHEN prob IS NULL THEN CASE WHEN nd THEN 'near_duplicate' WHEN praise THEN 'short_praise' WHEN over_ OR under_ THEN 'rating_mismatch' WHEN promo THEN 'promotional' END
            ELSE 'Text model: ' || (review_id * 37 % 100) || '%' || CASE WHEN prob >= 0.9 THEN ' alike to generated reviews' WHEN classification = 'suspicious' THEN ' alike, below the flag' WHEN prob <= 0.045 AND NOT any_signal THEN ' alike only' ELSE ' alike, inconclusive' END END AS last_signal
FROM p
"""


def trust_score_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = src.reviews(spark, sf_dir)
    products = r.groupBy("product").agg(F.round(F.avg("rating"), 1).alias("rating")).withColumns({"has_title": F.lit(True), "has_price": F.substring("product", -1, 1) != "3", "has_image": F.substring("product", -1, 1) != "5"})
    return reviews.trust_score(findings(spark, sf_dir).withColumn("probability", F.lit(None).cast("double")), products, "product")


TRUST = f"""
WITH {FINDINGS_SQL}, per AS (
  SELECT product, round(avg(rating), 1) AS rating, count(*) AS n, count(*) FILTER (classification = 'suspicious') AS s, count(DISTINCT text) AS d, right(product, 1) <> '3' AS hp, right(product, 1) <> '5' AS hi FROM findings GROUP BY product
), pil AS (
  SELECT *, CASE WHEN hp AND hi THEN 35.0 ELSE 20.0 END AS metadata, round(round(greatest(1.0, rating - s * 0.2), 1) / 5 * 25, 1) AS rating_reputation, CASE WHEN hp THEN 20.0 ELSE 10.0 END AS price_realism,
         round(round(d / n, 2) * 20, 1) AS text_integrity FROM per
), t AS (SELECT *, greatest(10.0, least(100.0, round(CAST(metadata AS DOUBLE) + rating_reputation + CAST(price_realism AS DOUBLE) + text_integrity, 1))) AS score FROM pil)
SELECT product, CAST(metadata AS DOUBLE) AS metadata, rating_reputation, CAST(price_realism AS DOUBLE) AS price_realism, text_integrity, round(d / n, 2) AS unique_text_ratio, round(s / n, 2) AS suspicious_share, score,
       CASE WHEN score >= 65 THEN 'VERIFIED' WHEN score >= 45 THEN 'CAUTION' ELSE 'BLOCKED' END AS verdict, CASE WHEN score >= 65 THEN 0.85::DOUBLE WHEN score >= 45 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS confidence, n AS n_reviews
FROM t
"""


def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).withColumn("probability", F.lit(None).cast("double"))
    f = f.withColumn("verdict", reviews.two_way_verdict(F.col("classification"), F.col("confidence"), F.col("probability"))["verdict"])
    return reviews.findings_summary(f, ["product"])


FSUM = f"""
WITH {FINDINGS_SQL}
SELECT product, count(*) AS total_reviews, count(*) FILTER (classification <> 'suspicious') AS genuine, count(*) FILTER (classification = 'suspicious') AS not_genuine, count(*) FILTER (classification = 'suspicious') AS suspicious,
       count(*) FILTER (classification = 'genuine-looking') AS genuine_looking, count(*) FILTER (classification = 'needs-review') AS needs_review, round(count(*) FILTER (classification = 'suspicious') / count(*), 3) AS suspicious_share,
       CAST(0 AS BIGINT) AS scored_by_text_model
FROM findings GROUP BY product
"""


def latin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "documents").select("doc_id", F.round(tx.latin_share("text"), 6).alias("latin_share"), tx.latin_gate("text").alias("judged"))


LATIN = r"""
WITH s AS (SELECT doc_id, text, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(text, '\P{L}', '', 'g')) AS l, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents)
SELECT doc_id, CASE WHEN l > 0 THEN round(a / l, 6) ELSE 0.0 END AS latin_share, coalesce(l > 0 AND a / l >= 0.9, FALSE) AND n >= 6 AS judged FROM s
"""


def event_burst_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = reviews.burst_days(src.table(spark, sf_dir, "events"), "user_id", "ts")
    return days.select("user_id", "day", "count", F.round("z_score", 2).alias("z_score"))


BURST = """
WITH g AS (SELECT user_id, min(ts)::DATE AS f, max(ts)::DATE AS l, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 15 AND max(ts)::DATE - min(ts)::DATE >= 2),
cal AS (SELECT user_id, unnest(generate_series(f, l, INTERVAL 1 DAY))::DATE AS day FROM g),
c AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
x AS (SELECT cal.user_id, cal.day, coalesce(c.n, 0) AS cnt FROM cal LEFT JOIN c ON cal.user_id = c.user_id AND cal.day = c.day),
s AS (SELECT user_id, avg(cnt) AS m, stddev_pop(cnt) AS d FROM x GROUP BY user_id)
SELECT x.user_id, x.day, x.cnt AS "count", CASE WHEN d > 0 THEN round((cnt - m) / d, 2) ELSE 0.0 END AS z_score FROM x JOIN s USING (user_id)
"""


def burst_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-02-01").cast("timestamp")
    b = reviews.burst_summary(src.table(spark, sf_dir, "events"), "user_id", "ts", now)
    return b.select("user_id", "peak_date", "peak_count", "max_z_score", "vol_30d", "vol_90d", "vol_365d", F.size("burst_points").alias("n_points"))


PEAKS = """
WITH g AS (SELECT user_id, min(ts)::DATE AS f, max(ts)::DATE AS l FROM events GROUP BY user_id HAVING count(*) >= 15 AND max(ts)::DATE - min(ts)::DATE >= 2),
cal AS (SELECT user_id, unnest(generate_series(f, l, INTERVAL 1 DAY))::DATE AS day FROM g),
c AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
x AS (SELECT cal.user_id, cal.day, coalesce(c.n, 0) AS cnt FROM cal LEFT JOIN c ON cal.user_id = c.user_id AND cal.day = c.day),
s AS (SELECT user_id, avg(cnt) AS m, stddev_pop(cnt) AS d FROM x GROUP BY user_id),
z AS (SELECT x.user_id, x.day, x.cnt, CASE WHEN d > 0 THEN round((cnt - m) / d, 2) ELSE 0.0 END AS z FROM x JOIN s USING (user_id) WHERE cnt > 0),
pk AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, day) = 1),
pts AS (SELECT user_id, count(*) FILTER (cnt >= 3 AND z >= 2) AS n_points FROM z GROUP BY user_id),
v AS (SELECT user_id, floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400) AS age FROM events)
SELECT pk.user_id, pk.day AS peak_date, pk.cnt AS peak_count, pk.z AS max_z_score, (SELECT count(*) FROM v WHERE v.user_id = pk.user_id AND age <= 30) AS vol_30d,
       (SELECT count(*) FROM v WHERE v.user_id = pk.user_id AND age <= 90) AS vol_90d, (SELECT count(*) FROM v WHERE v.user_id = pk.user_id AND age <= 365) AS vol_365d, CAST(n_points AS INTEGER) AS n_points
FROM pk JOIN pts USING (user_id)
"""


def layered_review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as layers by role; the first 10 different texts of each."""
    c = src.table(spark, sf_dir, "conversations").withColumn("ordinal", F.col("turn"))
    p = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return reviews.layered(c, "conv_id", "text", p, 10).select("conv_id", "turn", "role")


LAYERED = r"""
WITH k AS (SELECT *, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS key, CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS p FROM conversations),
a AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, key ORDER BY p, turn) = 1)
SELECT conv_id, turn, role FROM a QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p, turn) <= 10
"""

QUERIES = {
    f.__name__: f
    for f in (neardup_trigram_pairs, neardup_flagged, neardup_whole_classes, neardup_whole_flagged, neardup_by_product, exact_duplicate_groups, distinct_ratio_by_source, sentiment_lexicon, review_rule_findings, two_way_verdict, model_merge, trust_score_by_source, findings_summary, latin_gate, event_burst_zscore, burst_peaks, layered_review_merge)
}
ORACLE_SQL = {
    "neardup_trigram_pairs": f"WITH {PAIRS_SQL} SELECT a, b, overlap, round(jaccard, 6) AS jaccard FROM pairs",
    "neardup_whole_classes": f"WITH {WHOLE_SQL} SELECT a, b, overlap, round(jaccard, 6) AS jaccard FROM cp",
    "neardup_whole_flagged": f"WITH {WHOLE_SQL} SELECT gs.id AS doc_id FROM gs JOIN cl USING (g) WHERE cl.c > 1 OR cl.id IN (SELECT a FROM cp UNION SELECT b FROM cp)",
    "neardup_flagged": f"WITH {PAIRS_SQL} SELECT a AS doc_id FROM pairs UNION SELECT b FROM pairs",
    "exact_duplicate_groups": EXACT,
    "distinct_ratio_by_source": DISTINCT,
    "sentiment_lexicon": f"WITH {SENTIMENT_SQL} SELECT doc_id, sentiment, CAST(n_words AS INTEGER) AS n_words FROM sent",
    "review_rule_findings": f"WITH {FINDINGS_SQL} SELECT review_id, product, sentiment, nd AS near_duplicate, suspicion, classification, confidence, risk FROM findings",
    "two_way_verdict": VERDICT,
    "model_merge": MERGE,
    "trust_score_by_source": TRUST,
    "findings_summary": FSUM,
    "latin_gate": LATIN,
    "event_burst_zscore": BURST,
    "burst_peaks": PEAKS,
    "layered_review_merge": LAYERED,
}
