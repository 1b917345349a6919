"""Offers and observed prices: eligibility, the lowest, history, summaries, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CURRENCY = "INR"
USED = r"(?i)\b(refurbished|renewed|reconditioned|pre-?owned|second[- ]hand|open[- ]box|used)\b"


def exclusion_reason(price: Column, in_stock: Column, currency: Column, title: Column, source_title: Column | None = None, used: str = USED) -> Column:
    """Why an offer can't be the lowest; the first rule that fits (FL4, FL5)."""
    second_hand = title.rlike(used) if source_title is None else title.rlike(used) & ~F.coalesce(source_title.rlike(used), F.lit(False))
    return (
        F.when(price.isNull() | (price <= 0), "no price shown")
        .when(in_stock == F.lit(False), "out of stock")
        .when(currency != CURRENCY, F.concat(F.lit("price in "), currency, F.lit(", not comparable")))
        .when(F.coalesce(second_hand, F.lit(False)), "refurbished / used listing")
    )


def best_per_store(offers: DataFrame, keys: list[str], store: str = "store") -> DataFrame:
    """One offer for each store: one that can be bought before one that can't, then the cheapest, then the first."""
    rest = [c for c in offers.columns if c not in (*keys, store)]
    order = F.struct((~F.col("eligible")).cast("int"), F.coalesce("price", F.lit(float("inf"))), F.col("ordinal"))
    return offers.groupBy(*keys, store).agg(F.min_by(F.struct(*rest), order).alias("_best")).select(*keys, store, "_best.*")


def lowest(offers: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest eligible offer: by price, the source first, then store."""
    return offers.where("eligible").groupBy(*keys).agg(F.min_by(F.struct("store", "price", "is_source"), F.struct("price", (~F.col("is_source")).cast("int"), "store")).alias("_low"), F.count("*").alias("eligible_offers")).select(*keys, "eligible_offers", F.col("_low.store").alias("store"), F.col("_low.price").alias("price"), F.col("_low.is_source").alias("is_source"))


def newest_points(points: DataFrame, key: str, most: int) -> DataFrame:
    """The newest ``most`` different (time, price) points of each key."""
    valid = points.where("price > 0").select(key, "observed_at", "price").distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("observed_at"), F.desc("price")))
    return valid.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def price_summary(points: DataFrame, key: str) -> DataFrame:
    """Least, most, mean, number, change and trend; change and trend need two points."""
    by_time = F.struct("observed_at", "price")
    found = points.where("price > 0").groupBy(key).agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.avg("price").alias("avg_price"), F.count("*").alias("observations"), F.min_by("price", by_time).alias("first_price"), F.max_by("price", by_time).alias("last_price")
    )
    change = F.when(F.col("observations") >= 2, (F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100)
    return found.withColumn("change_pct", change).withColumn("trend", F.when(change > 2, "rising").when(change < -2, "falling").when(change.isNotNull(), "stable"))


def debounced(points: DataFrame, key: str, minutes: int = 30) -> DataFrame:
    """Observations that are stored: one is skipped if the last stored one of its key has the same price and is under
    ``minutes`` old. Skipped ones don't advance the state, so it is a fold, not a lag (ST1)."""
    item = F.struct(F.col("observed_at").alias("t"), F.col("ordinal").alias("o"), F.col("price").alias("p"))
    seconds = F.lit(minutes * 60)

    def keep(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        again = last.isNotNull() & (last["p"] == x["p"]) & ((F.unix_timestamp(x["t"].cast("timestamp")) - F.unix_timestamp(last["t"].cast("timestamp"))) < seconds)
        return F.when(again, kept).otherwise(F.concat(kept, F.array(x)))

    # A run of one price with gaps under the limit is folded on its own: elsewhere the next row is stored whatever came before.
    w = Window.partitionBy(key).orderBy("observed_at", "ordinal")
    gap = F.unix_timestamp(F.col("observed_at").cast("timestamp")) - F.unix_timestamp(F.lag("observed_at").over(w).cast("timestamp"))
    new = F.coalesce((F.lag("price").over(w) != F.col("price")) | (gap >= seconds), F.lit(True))
    runs = points.select(key, "observed_at", "ordinal", "price", new.cast("int").alias("_new")).withColumn("_run", F.sum("_new").over(w))
    folded = runs.groupBy(key, "_run").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    empty = F.slice("_all", 1, 0)
    return folded.select(key, F.explode(F.aggregate("_all", empty, keep)).alias("x")).select(key, F.col("x.t").alias("observed_at"), F.col("x.o").alias("ordinal"), F.col("x.p").alias("price"))


def live_points(live: DataFrame, points: DataFrame, key: str, minutes: int = 15) -> DataFrame:
    """Live prices that history doesn't have within the last ``minutes`` (ST3)."""
    near = (F.col("l.price") == F.col("p.price")) & (F.col("p.observed_at") <= F.col("l.observed_at")) & (F.col("p.observed_at") >= F.col("l.observed_at") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return live.alias("l").join(points.alias("p"), (F.col(f"l.{key}") == F.col(f"p.{key}")) & near, "left_anti")


def as_of(live: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """For each live row the last stored price at or before its time: union, then a running last value; no range join."""
    w = Window.partitionBy(key).orderBy("observed_at", "_live").rowsBetween(Window.unboundedPreceding, 0)
    both = points.select(key, "observed_at", F.col("price").alias("_p"), F.lit(0).alias("_live"), F.lit(None).cast("long").alias("ordinal")).unionByName(
        live.select(key, "observed_at", F.lit(None).cast("double").alias("_p"), F.lit(1).alias("_live"), "ordinal")
    )
    return both.withColumn("last_price", F.last("_p", ignorenulls=True).over(w)).where("_live = 1").select(key, "observed_at", "ordinal", "last_price")
