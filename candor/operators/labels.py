"""Human labels and upserts on plain Parquet tables: last in a batch wins, some columns keep their first value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.functions.text import review_hash

LABELS = ("real", "fake", "clear")


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], order: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """``table`` after ``batch``: the last row of a key in the batch replaces the stored one, except columns of ``keep_first`` (K1, K5)."""
    cols = [c for c in table.columns if c not in keys]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_n"))
    both = table.select(*keys, F.struct(*cols).alias("_o")).join(last, keys, "full_outer")
    value = lambda c: (F.coalesce(F.col(f"_o.{c}"), F.col(f"_n.{c}")) if c in keep_first else F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))).alias(c)
    return both.select(*keys, *[value(c) for c in cols])


def save_labels(labels: DataFrame, batch: DataFrame) -> DataFrame:
    """Labels (review_hash, label) after a batch of (text, label, ordinal): set, change, or clear (K4). Blank and overlong
    texts and unknown labels are left out, as the form refuses them."""
    sound = batch.where((F.trim("text") != "") & (F.length("text") <= 5000) & F.col("label").isin(*LABELS))
    last = sound.groupBy(review_hash("text").alias("review_hash")).agg(F.max_by("label", "ordinal").alias("new"))
    both = labels.join(last, "review_hash", "full_outer").withColumn("label", F.coalesce("new", "label"))
    return both.where("label <> 'clear'").select("review_hash", "label")


def label_counts(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of labels (A1)."""
    return labels.groupBy(*keys).agg(*[F.sum((F.col("label") == v).cast("long")).alias(v) for v in LABELS[:2]])


def largest_dataset(rows: DataFrame) -> DataFrame:
    """The dataset of most rows, the first by name of equals (A2)."""
    return rows.groupBy("dataset").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dataset").limit(1)


def mapped(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with the label that a mapping (dataset_name, raw_label, label) gives; never guessed, and one row for each text. The
    mapping is a small registry: raw labels are few, so rows dealt by them would be few tasks' work."""
    known = rows.join(F.broadcast(mapping.dropDuplicates(["dataset_name", "raw_label"])), ["dataset_name", "raw_label"])
    of = lambda n: F.min_by(n, "ordinal").alias(n)  # noqa: E731  each by itself: a text that isn't asked for stays where it is
    return known.groupBy(review_hash("text").alias("review_hash")).agg(of("text"), of("label"))


def unknown_texts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose text key isn't among the known ones, and only the first of each new key."""
    k = review_hash("text")
    fresh = rows.withColumn("_k", k).join(known.select(k.alias("_k")).distinct(), "_k", "left_anti")
    cols = [c for c in rows.columns]
    return fresh.groupBy("_k").agg(F.min_by(F.struct(*cols), F.col("ordinal")).alias("x")).select("x.*")


def citation(title: str, url: str) -> tuple:
    """IEEE and BibTeX strings of a product page (K8)."""
    t, u = F.col(title), F.col(url)
    return F.format_string('"%s," [Online]. Available: %s', t, u), F.format_string("@misc{listing, title = {%s}, howpublished = {\\url{%s}}}", t, u)


def with_first_text(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Labels (review_hash, label) with the first text (by ordinal) of their hash; labels without a review are left out."""
    first = reviews.where("text is not null").groupBy(review_hash("text").alias("review_hash")).agg(F.min_by("text", "ordinal").alias("text"))
    return labels.join(first, "review_hash")
