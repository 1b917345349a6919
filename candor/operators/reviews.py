"""Review integrity: rule signals, model merge, verdicts, trust scores, summaries, bursts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions import text as tx
from candor.sources.staging import staged

#: Lexicons and phrases of ordinary English and Hindi reviews (fixed values).
POSITIVE = ("great", "excellent", "amazing", "good", "awesome", "perfect", "love", "best", "superb", "nice", "original", "authentic")
NEGATIVE = ("defective", "stopped working", "heating", "terrible", "worst", "torn", "faded", "bad", "useless", "kharab", "bekar", "bakwas", "duplicate", "fake", "broken", "damaged", "return")
PROMOTION = (
    r"\b(?:best product ever|buy fast|must buy now|cheap price good|good good|amazing wow)\b",
    r"\b(?:100% working|guaranteed result|super fast delivery buy now)\b",
    r"\b(?:seller is great buy this|5 star product best quality buy)\b",
    r"\b(?:5 star product best quality|super amazing seller)\b",
    r"\b(?:ekdum mast product|bahut badhiya|ek number saaman)\b",
)


def rule_findings(reviews: DataFrame, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE, promotion: Sequence[str] = PROMOTION) -> DataFrame:
    """Reviews (text, rating, near_duplicate) with sentiment, suspicion, signals, classification, confidence and risk (M2)."""
    s, n = F.col("sentiment"), F.col("n_words")
    signal = lambda on, name: F.when(F.coalesce(on, F.lit(False)), F.lit(name))
    low = F.lower("text")
    is_promo = F.lit(False)
    for rule in promotion:
        is_promo = is_promo | low.rlike(rule)
    overrated, underrated = (F.col("rating") >= 4) & (s <= -0.4), (F.col("rating") <= 2) & (s >= 0.5)
    praise = (n <= 4) & (F.col("rating") == 5) & (s > 0.5)
    points = lambda on, x: F.when(F.coalesce(on, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    base = reviews.withColumn("sentiment", tx.sentiment("text", positive, negative)).withColumn("n_words", tx.word_count("text"))
    scored = base.withColumn(
        "suspicion", F.round(points(is_promo, 0.60) + points(overrated, 0.50) + points(underrated, 0.45) + points(praise, 0.20) + points(F.col("near_duplicate"), 0.55), 2)
    ).withColumn(
        "signals", F.filter(F.array(signal(is_promo, "promotional"), signal(overrated | underrated, "rating_mismatch"), signal(praise, "short_praise"), signal(F.col("near_duplicate"), "near_duplicate")), lambda x: x.isNotNull())
    )
    quiet = F.size("signals") == 0
    kind = F.when(F.col("suspicion") >= 0.5, "suspicious").when((n >= 8) & quiet, "genuine-looking").otherwise("needs-review")
    confidence = F.when(F.col("suspicion") >= 0.5, F.least(F.lit(0.92), F.round(F.lit(0.5) + F.col("suspicion") * 0.35, 2))).when((n >= 8) & quiet, 0.58).otherwise(0.35)
    risk = F.when(F.col("suspicion") >= 0.8, "high").when((F.col("suspicion") < 0.5) & (n >= 8) & quiet, "low").otherwise("medium")
    return scored.withColumns({"classification": kind, "confidence": confidence, "risk": risk})


def merge_model(findings: DataFrame, threshold: float = 0.8355, floor: float = 0.9, genuine_at: float = 0.045) -> DataFrame:
    """Findings with the text model's ``probability`` (null: rules alone) merged in (M3): what the rules suspect stays
    suspected, the model alone may suspect from max(threshold, floor) on and clear what has no signal up to
    ``genuine_at``. Signals gain the model's line, with the highest confidences 0.95 and 0.9."""
    p, flag = F.col("probability"), max(threshold, floor)
    rule = F.col("classification") == "suspicious"
    percent = F.concat(F.lit("Text model: "), F.format_string("%.0f", F.bround(p * 100, 0)), F.lit("%"))
    at = lambda flagged, kept, cleared, other, rules: F.when(p.isNull(), rules).when(p >= flag, flagged).when(rule, kept).when((p <= genuine_at) & (F.size("signals") == 0), cleared).otherwise(other)
    own, line = F.col("signals"), lambda end: F.concat(F.col("signals"), F.array(F.concat(percent, F.lit(end))))
    return findings.withColumns(
        {
            "detector": F.when(p.isNull(), "rules").otherwise("ml+rules"),
            "classification": at(F.lit("suspicious"), F.col("classification"), F.lit("genuine-looking"), F.lit("needs-review"), F.col("classification")),
            "confidence": at(F.greatest(F.when(rule, F.col("confidence")).otherwise(0.0), F.least(F.lit(0.95), F.round(p, 2))), F.col("confidence"), F.least(F.lit(0.9), F.round(1 - p, 2)), F.lit(0.45), F.col("confidence")),
            "risk": at(F.when(p >= 0.95, "high").otherwise("medium"), F.col("risk"), F.lit("low"), F.lit("medium"), F.col("risk")),
            "signals": at(line(" alike to generated reviews"), line(" alike, below the flag"), line(" alike only"), line(" alike, inconclusive"), own),
        }
    )


def two_way_verdict(classification: Column, confidence: Column, probability: Column) -> Column:
    """struct(verdict, certainty, note) (M4)."""
    suspicious, looking = classification == "suspicious", classification == "genuine-looking"
    verdict = F.when(suspicious, "not_genuine").when(looking, "genuine").when(probability >= 0.5, "not_genuine").otherwise("genuine")
    certainty = F.when(suspicious & (confidence >= 0.7), "clear").when(looking & (confidence >= 0.8), "clear").otherwise("limited")
    note = F.when(~suspicious & ~looking, F.when(probability.isNotNull(), "close call").otherwise("too short to judge"))
    return F.struct(verdict.alias("verdict"), certainty.alias("certainty"), note.alias("note"))


def trust_score(findings: DataFrame, products: DataFrame, key: str) -> DataFrame:
    """One row per product: pillars, score, verdict (A5).

    ``products`` has key, has_title, has_price, has_image, rating; products without findings have no score.
    """
    # Distinct texts by a two-step count: (key, digest of the text) first, so that a product with most reviews isn't one task's.
    texts = findings.groupBy(key, F.sha2("text", 256).alias("text")).agg(F.count("*").alias("n"), F.sum((F.col("classification") == "suspicious").cast("long")).alias("s"), F.count("probability").alias("m"))
    per = texts.groupBy(key).agg(F.sum("n").alias("n_reviews"), F.sum("s").alias("n_suspicious"), F.count("text").alias("n_distinct"), F.sum("m").alias("n_scored"))
    j = products.join(per, key, "left")
    some = F.coalesce(F.col("n_reviews") > 0, F.lit(False))
    unique, share = F.round(F.col("n_distinct") / F.col("n_reviews"), 2), F.round(F.col("n_suspicious") / F.col("n_reviews"), 2)
    adjusted = F.round(F.greatest(F.lit(1.0), F.col("rating") - F.coalesce("n_suspicious", F.lit(0)) * 0.2), 1)
    pillars = {
        "metadata": F.when(F.col("has_title") & F.col("has_price") & F.col("has_image"), 35.0).when(F.col("has_title"), 20.0).otherwise(10.0),
        "rating_reputation": F.when(F.col("rating").isNotNull(), F.round(adjusted / 5 * 25, 1)).otherwise(12.5),
        "price_realism": F.when(F.col("has_price"), 20.0).otherwise(10.0),
        "text_integrity": F.when(~some, 10.0).when(F.col("n_scored") > 0, F.round(unique * (1 - share) * 20, 1)).otherwise(F.round(unique * 20, 1)),
    }
    j = j.withColumns(pillars | {"unique_text_ratio": F.when(some, unique), "suspicious_share": F.when(some, share)})
    total = F.greatest(F.lit(10.0), F.least(F.lit(100.0), F.round(sum(F.col(c) for c in pillars), 1)))
    verdict = F.when(~some, "INSUFFICIENT DATA").when(total >= 65, "VERIFIED").when(total >= 45, "CAUTION").otherwise("BLOCKED")
    confidence = F.when(~some, 0.35).when(total >= 65, 0.85).when(total >= 45, 0.80).otherwise(0.90)
    return j.select(key, *pillars, "unique_text_ratio", "suspicious_share", F.when(some, total).alias("score"), verdict.alias("verdict"), confidence.alias("confidence"), F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"))


def findings_summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by class and verdict, and the suspicious share (A3)."""
    n = lambda c, v: F.sum((F.col(c) == v).cast("long"))
    return findings.groupBy(*keys).agg(
        F.count("*").alias("total_reviews"), n("verdict", "genuine").alias("genuine"), n("verdict", "not_genuine").alias("not_genuine"), n("classification", "suspicious").alias("suspicious"), n("classification", "genuine-looking").alias("genuine_looking"),
        n("classification", "needs-review").alias("needs_review"), F.round(n("classification", "suspicious") / F.count("*"), 3).alias("suspicious_share"), F.count("probability").alias("scored_by_text_model"),
    )


def burst_days(dated: DataFrame, key: str, ts: str, least_dated: int = 15, dated_share: float = 0.8) -> DataFrame:
    """Daily counts with days of none, and each day's z-score by the population deviation; only for keys with enough dated rows over 3 days or more."""
    day = F.to_date(ts)
    gate = dated.groupBy(key).agg(F.count(ts).alias("n"), F.count("*").alias("total"), F.min(day).alias("first"), F.max(day).alias("last"))
    gate = gate.where((F.col("n") >= least_dated) & (F.col("n") >= dated_share * F.col("total")) & (F.datediff("last", "first") >= 2))
    counts = dated.where(F.col(ts).isNotNull()).groupBy(key, day.alias("day")).agg(F.count("*").alias("count"))
    calendar = gate.select(key, F.explode(F.sequence("first", "last")).alias("day"))
    filled = calendar.join(counts, [key, "day"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    stats = filled.groupBy(key).agg(F.avg("count").alias("mean"), F.stddev_pop("count").alias("spread"))
    z = F.when(F.col("spread") > 0, F.round((F.col("count") - F.col("mean")) / F.col("spread"), 2)).otherwise(0.0)
    return filled.join(stats, key).withColumn("z_score", z)


def burst_summary(dated: DataFrame, key: str, ts: str, now: Column, least_count: int = 3, least_z: float = 2.0) -> DataFrame:
    """One row per key: peak day (the earliest of equals), its z-score, volumes, burst points."""
    days = burst_days(dated, key, ts).where("count > 0")
    point = F.struct("day", "count", "z_score")
    peak = days.groupBy(key).agg(F.max_by(point, F.struct("count", -F.unix_date("day"))).alias("p"), F.array_sort(F.collect_list(F.when((F.col("count") >= least_count) & (F.col("z_score") >= least_z), point))).alias("burst_points"))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.col(ts).cast("timestamp"))) / 86400)
    volume = lambda d: F.sum((age <= d).cast("long")).alias(f"vol_{d}d")
    volumes = dated.where(F.col(ts).isNotNull()).groupBy(key).agg(volume(30), volume(90), volume(365))
    return peak.join(volumes, key).select(key, F.col("p.day").alias("peak_date"), F.col("p.count").alias("peak_count"), F.col("p.z_score").alias("max_z_score"), "vol_30d", "vol_90d", "vol_365d", "burst_points")


def layered(layers: DataFrame, key: str, text: str, priority: Column, limit: int | None = None) -> DataFrame:
    """Rows of all layers, the one of best priority for each (key, review key); at most ``limit`` for each key if asked."""
    ranked = layers.withColumn("_k", tx.review_key(text)).where("_k <> ''").withColumn("_p", priority)
    first = Window.partitionBy(key, "_k").orderBy("_p", "ordinal")
    kept = ranked.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    if limit is not None:
        kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_p", "ordinal"))).where(F.col("_r") <= limit)
    return kept.drop("_k", "_p", "_r")


def conditional_layers(keys: DataFrame, layers: Sequence[DataFrame], key: str, text: str, enough: int = 3, limit: int | None = None) -> DataFrame:
    """Rows of layers (``key``, ``text``, ordinal) in order, where the next layer is asked only for keys of which the ones
    before gave fewer than ``enough`` different texts (S11). Adds ``layer``. A text comes once for a key, from the first
    layer that has it; keys without rows stay open to the end; at most ``limit`` rows for each key if asked.

    What was found so far is written after each layer, so a layer reads it instead of working it out again.
    """
    open_keys, found = keys.select(key).distinct(), None
    for k, layer in enumerate(layers):
        cols = [c for c in layer.columns if c != key]
        asked = layer.join(open_keys, key, "left_semi").withColumn("_k", tx.review_key(text)).where("_k <> ''")
        fresh = asked.groupBy(key, "_k").agg(F.min_by(F.struct(*cols), "ordinal").alias("r")).select(key, "_k", "r.*", F.lit(k).alias("layer"))
        if found is not None:
            fresh = fresh.join(found.select(key, "_k"), [key, "_k"], "left_anti")
        found = staged(fresh if found is None else found.unionByName(fresh), f"layer{k}")
        if k + 1 < len(layers):
            enough_of = found.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= enough)
            open_keys = staged(open_keys.join(enough_of, key, "left_anti"), f"open{k}")
    if limit is not None:
        place = F.row_number().over(Window.partitionBy(key).orderBy("layer", "ordinal"))
        found = found.withColumn("_r", place).where(F.col("_r") <= limit).drop("_r")
    return found.drop("_k")


def partial_result(products: DataFrame, reviews: DataFrame, collected: DataFrame, key: str) -> DataFrame:
    """Products (``key``, review_count, reported_total) while answers still come in (R11): ``n_reviews`` of the first pass
    (``key``, text) and of what was collected beyond its texts, and the count as stated, else as reported, else as found."""
    low = lambda d: d.select(key, F.lower("text").alias("_t"))
    known = low(reviews)
    fresh = low(collected).join(known.distinct(), [key, "_t"], "left_anti")
    n = known.union(fresh).groupBy(key).agg(F.count("*").alias("n_reviews"))
    filled = lambda c: F.nullif(F.col(c), F.lit(0))
    j = products.join(n, key, "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))
    return j.withColumn("review_count", F.coalesce(filled("review_count"), filled("reported_total"), "n_reviews")).select(key, "n_reviews", "review_count")
