"""Reviews inside the JSON that a page carries: its state is a variant that is walked level by level in the JVM.

A level's values are exploded into the next, written and read back, until none is left or ``most_depth`` is reached; so a
page's depth costs rounds, not nesting of plans, and no number of values meets a limit of recursion. What a value holds is
read by the rules of a store's own state (S8) or of any review widget (S10).

Defined results: pages without a state, with one that isn't JSON, null pages and empty tables give no rows; members of an
object are walked in the order of their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.functions import text as tx
from candor.sources.staging import staged

#: Names under which review widgets keep what they show (fixed values), in order of preference.
TEXT_NAMES = "reviewBody reviewText review_text reviewtext extract comment comments text body content description message review detail".split()
TOP_NAMES = "score_max scoreMax max_score maxScore ratingMax bestRating best_rating".split()
RATING_NAMES = "ratingValue rating stars star score overallRating userRating reviewRating starRating ratingStar".split()
DATE_NAMES = "datePublished date created createdAt created_at reviewDate submissionTime submitted_at postedOn timestamp updatedAt".split()
AUTHOR_NAMES = "author authorName userName username nickname reviewer customerName name".split()
NODES = "depth int, path array<int>, v variant"


def embedded_state(html: str | Column, name: str = "window.__INITIAL_STATE__") -> Column:
    """The variant that a script assigns to ``name``; null if it isn't JSON."""
    pattern = r"(?s)" + name.replace(".", r"\.") + r"\s*=\s*(\{.*?\});\s*</script>"
    return F.try_parse_json(F.nullif(F.regexp_extract(tx.col(html), pattern, 1), F.lit("")))


def walk(rows: DataFrame, key: str, value: str, most_depth: int = 40) -> DataFrame:
    """(``key``, depth, path, v): ``value`` and all values inside it down to ``most_depth``; path holds the place in each level."""
    spark = rows.sparkSession
    level = staged(rows.where(F.col(value).isNotNull()).select(key, F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path"), F.col(value).alias("v")), "level")
    levels = [level]
    for depth in range(1, most_depth + 1):
        inside = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        level = staged(inside.select(key, F.lit(depth).alias("depth"), F.concat("path", F.array(F.col("pos"))).alias("path"), F.col("value").alias("v")), "level")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def field(v: Column, name: str) -> Column:
    """A member as text; null if there is none or it is empty."""
    return F.nullif(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))


def state_reviews(nodes: DataFrame, key: str, kind: str = "ProductReviewValue") -> DataFrame:
    """(``key``, path, id, text, title, rating, date, author, verified_purchase, helpful) of the values whose type is
    ``kind`` and that have a text or a title (S8); texts of under two characters are left out."""
    v = F.col("v")
    hits = nodes.where(F.try_variant_get(v, "$.type", "string") == kind)
    text = F.coalesce(F.nullif(tx.clean(field(v, "text")), F.lit("")), F.nullif(tx.clean(field(v, "title")), F.lit("")))
    helpful = field(v, "helpfulCount")
    return hits.select(
        key, "path", field(v, "id").alias("id"), text.alias("text"), tx.clean(field(v, "title")).alias("title"), tx.collected_rating(field(v, "rating").try_cast("double")).alias("rating"), tx.clean(field(v, "created")).alias("date"), tx.clean(field(v, "author")).alias("author"),
        F.coalesce(F.lower(field(v, "certifiedBuyer")) == "true", F.lit(False)).alias("verified_purchase"), F.when(helpful.rlike(r"^\d+$"), helpful.try_cast("int")).otherwise(0).alias("helpful"),
    ).where(F.char_length("text") >= 2)


def picked(members: Column, names: Sequence[str]) -> Column:
    """The first of ``names`` that an array of (lower-case name, value) has with a value; the last of equal names counts."""
    listed = F.array(*[F.lit(n.lower()) for n in names])
    full = lambda x: ~F.is_variant_null(x) & (F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")) != "")
    # The best place among the names, then the last member of that name.
    best = F.array_min(F.transform(members, lambda m, i: F.when(F.array_contains(listed, m["k"]) & full(m["x"]), F.struct(F.array_position(listed, m["k"]).alias("p"), (-i).alias("i")))))
    return F.get(members, -best["i"])["x"]


def leading_number(v: Column) -> Column:
    return F.nullif(F.regexp_extract(F.try_variant_get(v, "$", "string"), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1), F.lit("")).try_cast("double")


def widget_reviews(nodes: DataFrame, key: str, most_depth: int = 12) -> DataFrame:
    """(``key``, path, text, rating, date, author) of every object, down to ``most_depth``, with a text of 12 to 5,000
    characters that is no address and a rating of 1 to 5, after scaling if its top is stated (S10)."""
    entries = F.map_entries(F.try_variant_get("v", "$", "map<string, variant>"))
    d = nodes.where(F.col("depth") <= most_depth).select(key, "path", F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("x"))).alias("m")).where("m is not null")
    d = d.withColumns({"t": picked(F.col("m"), TEXT_NAMES), "r": picked(F.col("m"), RATING_NAMES), "top": leading_number(picked(F.col("m"), TOP_NAMES))})
    d = d.withColumns({"text": F.when(F.schema_of_variant("t") == "STRING", F.try_variant_get("t", "$", "string")), "n": F.coalesce(leading_number(F.try_variant_get("r", "$.ratingValue", "variant")), leading_number(F.try_variant_get("r", "$.value", "variant")), leading_number(F.try_variant_get("r", "$.rating", "variant")), leading_number(F.col("r")))})
    n = F.when((F.col("top") > 5) & (F.col("top") <= 100) & F.col("n").between(0, F.col("top")), F.col("n") / F.col("top") * 5).otherwise(F.col("n"))
    d = d.withColumn("n", n).withColumn("rating", F.when(F.col("n").between(1, 5), F.floor(F.col("n") + 0.5).cast("int")).when((F.col("n") > 0) & (F.col("n") < 1), 1))
    spoken = (F.char_length(F.trim("text")) >= 12) & (F.char_length("text") <= 5000) & F.col("text").rlike("(?i)[a-z]{3}") & ~F.trim("text").rlike("(?i)^https?:")
    author = picked(F.col("m"), AUTHOR_NAMES)
    named = F.coalesce(F.try_variant_get(author, "$.name", "string"), F.when(F.schema_of_variant(author) == "STRING", F.try_variant_get(author, "$", "string")))
    return d.where(spoken & F.col("rating").isNotNull()).select(key, "path", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), "rating", F.try_variant_get(picked(F.col("m"), DATE_NAMES), "$", "string").alias("date"), named.alias("author"))
