"""Queries on offers and prices, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import text as tx
from candor.operators import candidates, prices
from candor.sources import tables as src

#: Second-hand titles among the parts begin with this word.
OLD = r"^old\b"

OFFERS_SQL = """
first_line AS (
  SELECT l_partkey, l_suppkey, arg_min(struct_pack(q := l_quantity, e := l_extendedprice, r := l_returnflag, o := l_orderkey, n := l_linenumber),
         struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber)) AS x
  FROM lineitem GROUP BY ALL
), offers AS (
  SELECT l_partkey AS part_id, s_name AS store, x.e / x.q AS price, x.r <> 'R' AS in_stock,
         CASE WHEN s_nationkey % 7 = 0 THEN 'USD' ELSE 'INR' END AS currency, p_name AS title, FALSE AS is_source, x.o * 10 + x.n AS ordinal
  FROM first_line JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL
  SELECT p_partkey, 'source', p_retailprice, TRUE, 'INR', p_name, TRUE, 0 FROM part
), judged AS (
  SELECT *, CASE WHEN price IS NULL OR price <= 0 THEN 'no price shown' WHEN NOT in_stock THEN 'out of stock'
                 WHEN currency <> 'INR' THEN 'price in ' || currency || ', not comparable'
                 WHEN NOT is_source AND (title = 'old' OR title LIKE 'old %') THEN 'refurbished / used listing' END AS reason
  FROM offers
)
"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = src.offers(spark, sf_dir).unionByName(src.source_offers(spark, sf_dir))
    reason = prices.exclusion_reason(F.col("price"), F.col("in_stock"), F.col("currency"), F.when(~F.col("is_source"), F.col("title")).otherwise(""), used=OLD)
    return both.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def lowest_offer_per_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = prices.best_per_store(judged(spark, sf_dir), ["part_id"])
    return prices.lowest(best, ["part_id"]).select("part_id", "eligible_offers", "store", F.round("price", 8).alias("price"), "is_source", tx.format_inr(F.round("price", 0)).alias("shown"))


LOWEST = f"""
WITH {OFFERS_SQL}, ok AS (SELECT * FROM judged WHERE reason IS NULL)
SELECT part_id, count(*) AS eligible_offers, b.store AS store, round(b.price, 8) AS price, b.is_source AS is_source,
       'Rs ' || CASE WHEN length(w) <= 3 THEN w ELSE
         CASE WHEN length(w) <= 5 THEN left(w, length(w) - 3) ELSE
           CASE WHEN length(w) <= 7 THEN left(w, length(w) - 5) || ',' || substr(w, length(w) - 4, 2) ELSE left(w, length(w) - 7) || ',' || substr(w, length(w) - 6, 2) || ',' || substr(w, length(w) - 4, 2) END END
         || ',' || right(w, 3) END AS shown
FROM (SELECT part_id, count(*) AS n, arg_min(struct_pack(store := store, price := price, is_source := is_source), struct_pack(a := price, b := NOT is_source, c := store)) AS b,
             CAST(CAST(round(arg_min(price, struct_pack(a := price, b := NOT is_source, c := store)), 0) AS BIGINT) AS VARCHAR) AS w FROM ok GROUP BY part_id) AS g JOIN ok USING (part_id)
GROUP BY part_id, b, w
"""


def offer_exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("offers"), F.count_distinct("part_id").alias("parts"))


REASONS = f"WITH {OFFERS_SQL} SELECT coalesce(reason, 'eligible') AS reason, count(*) AS offers, count(DISTINCT part_id) AS parts FROM judged GROUP BY 1"


def price_history_last_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = prices.newest_points(src.prices(spark, sf_dir), "part_id", 60)
    return newest.groupBy("part_id").agg(F.count("*").alias("points"), F.min("observed_at").alias("oldest"), F.max("observed_at").alias("newest"), F.round(F.sum("price"), 3).alias("price_sum"))


HISTORY = """
WITH p AS (SELECT DISTINCT l_partkey AS part_id, l_shipdate AS t, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_extendedprice / l_quantity > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY t DESC, price DESC) AS r FROM p)
SELECT part_id, count(*) AS points, min(t) AS oldest, max(t) AS newest, round(sum(price), 3) AS price_sum FROM r WHERE r <= 60 GROUP BY part_id
"""


def history_newest_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.newest_points(src.prices(spark, sf_dir), "part_id", 10).select("part_id", "observed_at", F.round("price", 8).alias("price"))


NEWEST = """
WITH p AS (SELECT DISTINCT l_partkey AS part_id, l_shipdate AS observed_at, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_extendedprice / l_quantity > 0)
SELECT part_id, observed_at, round(price, 8) AS price FROM p QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY observed_at DESC, price DESC) <= 10
"""


def price_summary_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prices.price_summary(src.prices(spark, sf_dir), "part_id")
    return s.select("part_id", *[F.round(c, 8).alias(c) for c in ("min_price", "max_price", "avg_price")], "observations", F.round("change_pct", 8).alias("change_pct"), "trend")


SUMMARY = """
WITH p AS (SELECT l_partkey AS part_id, l_shipdate AS t, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_extendedprice / l_quantity > 0),
g AS (SELECT part_id, min(price) AS lo, max(price) AS hi, avg(price) AS av, count(*) AS n,
             arg_min(price, struct_pack(a := t, b := price)) AS f, arg_max(price, struct_pack(a := t, b := price)) AS l FROM p GROUP BY part_id),
c AS (SELECT *, CASE WHEN n >= 2 THEN (l - f) / f * 100 END AS ch FROM g)
SELECT part_id, round(lo, 8) AS min_price, round(hi, 8) AS max_price, round(av, 8) AS avg_price, n AS observations, round(ch, 8) AS change_pct,
       CASE WHEN ch > 2 THEN 'rising' WHEN ch < -2 THEN 'falling' WHEN ch IS NOT NULL THEN 'stable' END AS trend FROM c
"""


def price_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user with coarse values, kept unless the last kept one says the same within 12 hours."""
    kept = prices.debounced(src.event_prices(spark, sf_dir), "user_id", minutes=720)
    return kept.select("user_id", "observed_at", F.col("ordinal").alias("event_id"), "price")


DEBOUNCE = """
WITH RECURSIVE e AS (
  SELECT user_id, ts, event_id, CAST(floor(value / 50.0) AS DOUBLE) AS price, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events
), walk AS (
  SELECT user_id, r, ts, event_id, price, TRUE AS kept, ts AS last_ts, price AS last_price FROM e WHERE r = 1
  UNION ALL
  SELECT e.user_id, e.r, e.ts, e.event_id, e.price, NOT (e.price = w.last_price AND floor(epoch(e.ts)) - floor(epoch(w.last_ts)) < 43200),
         CASE WHEN e.price = w.last_price AND floor(epoch(e.ts)) - floor(epoch(w.last_ts)) < 43200 THEN w.last_ts ELSE e.ts END,
         CASE WHEN e.price = w.last_price AND floor(epoch(e.ts)) - floor(epoch(w.last_ts)) < 43200 THEN w.last_price ELSE e.price END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1
)
SELECT user_id, ts AS observed_at, event_id, price FROM walk WHERE kept
"""


def live_point_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a user that no view of the same coarse price precedes within 12 hours."""
    e = src.event_prices(spark, sf_dir).join(src.table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), "event_type"), "ordinal")
    live, known = e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'view'").drop("event_type")
    return prices.live_points(live, known, "user_id", minutes=720).select("user_id", F.col("ordinal").alias("event_id"), "price")


LIVE = """
WITH e AS (SELECT *, CAST(floor(value / 50.0) AS DOUBLE) AS price FROM events)
SELECT user_id, event_id, price FROM e AS l WHERE event_type = 'purchase' AND NOT EXISTS (
  SELECT 1 FROM e AS p WHERE p.event_type = 'view' AND p.user_id = l.user_id AND p.price = l.price AND p.ts <= l.ts AND p.ts >= l.ts - INTERVAL 720 MINUTES)
"""


def price_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the value of the user's last view before it."""
    e = src.table(spark, sf_dir, "events")
    pick = lambda kind: e.where(F.col("event_type") == kind).select("user_id", F.col("ts").alias("observed_at"), F.col("value").alias("price"), F.col("event_id").alias("ordinal"))
    return prices.as_of(pick("purchase"), pick("view"), "user_id").select("user_id", F.col("ordinal").alias("event_id"), "last_price")


AS_OF = """
SELECT l.user_id, l.event_id, p.value AS last_price FROM (SELECT * FROM events WHERE event_type = 'purchase') AS l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') AS p ON l.user_id = p.user_id AND l.ts >= p.ts
"""


def order_volume_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each status within 30, 90 and 365 days before the end of 1998."""
    age = F.floor((F.unix_timestamp(F.lit("1998-12-31").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 86400)
    n = lambda d: F.sum(age.between(0, d).cast("long")).alias(f"vol_{d}d")
    return src.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(n(30), n(90), n(365))


VOLUME = """
WITH a AS (SELECT o_orderstatus, floor((epoch(TIMESTAMP '1998-12-31') - epoch(o_orderdate)) / 86400) AS age FROM orders)
SELECT o_orderstatus, count(*) FILTER (age BETWEEN 0 AND 30) AS vol_30d, count(*) FILTER (age BETWEEN 0 AND 90) AS vol_90d, count(*) FILTER (age BETWEEN 0 AND 365) AS vol_365d FROM a GROUP BY 1
"""


def topk_per_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part the 3 cheapest offers of a nation's stores, then 12 in all."""
    o = src.offers(spark, sf_dir).withColumn("group", F.substring("store", -1, 1))
    return candidates.top_per_store(o, ["part_id"], "group", F.col("price"), 3, 12).select("part_id", "store", "group", F.round("price", 8).alias("price"), "rank")


TOPK = f"""
WITH {OFFERS_SQL}, o AS (SELECT *, right(store, 1) AS grp FROM offers WHERE NOT is_source),
a AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY part_id, grp ORDER BY price, ordinal) <= 3),
b AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY price, ordinal) AS rank FROM a)
SELECT part_id, store, grp AS "group", round(price, 8) AS price, CAST(rank AS INTEGER) AS rank FROM b WHERE rank <= 12
"""


def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = candidates.ranked_offers(judged(spark, sf_dir).where(~F.col("is_source")), ["part_id"], 12)
    return ranked.select("part_id", "store", F.round("price", 8).alias("price"), "eligible", "rank")


RANKING = f"""
WITH {OFFERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY reason IS NOT NULL, coalesce(price, 999999), ordinal) AS rank FROM judged WHERE NOT is_source)
SELECT part_id, store, round(price, 8) AS price, reason IS NULL AS eligible, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12
"""


def store_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.attempt_report(judged(spark, sf_dir).where(~F.col("is_source")), "store")


ATTEMPTS = f"""
WITH {OFFERS_SQL}
SELECT store, count(*) AS listings, count(*) FILTER (reason IS NULL) AS exact, count(*) FILTER (reason = 'out of stock') AS out_of_stock,
       count(*) FILTER (reason IS NOT NULL AND reason <> 'out of stock') AS filtered, round(min(price) FILTER (reason IS NULL), 8) AS lowest
FROM judged WHERE NOT is_source GROUP BY store
"""


def fuller_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two reports on each supplier (open and finished lines) the one with more lines; the first on a tie."""
    line = src.table(spark, sf_dir, "lineitem")
    reports = line.groupBy("l_suppkey", "l_linestatus").agg(F.count("*").alias("listings")).select("l_suppkey", F.col("l_linestatus").alias("status"), "listings", F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("ordinal"))
    return candidates.fuller_reports(reports, "l_suppkey")


FULLER = """
WITH r AS (SELECT l_suppkey, l_linestatus AS status, count(*) AS listings FROM lineitem GROUP BY ALL)
SELECT l_suppkey, status, listings FROM r QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY listings DESC, status = 'F' DESC) = 1
"""

QUERIES = {f.__name__: f for f in (lowest_offer_per_part, offer_exclusion_reasons, price_history_last_60, history_newest_10, price_summary_by_part, price_debounce, live_point_suppression, price_as_of, order_volume_windows, topk_per_store, candidate_ranking, store_attempts, fuller_report)}
ORACLE_SQL = {
    "lowest_offer_per_part": LOWEST, "offer_exclusion_reasons": REASONS, "price_history_last_60": HISTORY, "history_newest_10": NEWEST, "price_summary_by_part": SUMMARY, "price_debounce": DEBOUNCE, "live_point_suppression": LIVE,
    "price_as_of": AS_OF, "order_volume_windows": VOLUME, "topk_per_store": TOPK, "candidate_ranking": RANKING, "store_attempts": ATTEMPTS, "fuller_report": FULLER,
}
