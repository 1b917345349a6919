"""What is put together from the parts: platforms and product addresses, sources from two readers, labelled findings,
views of scored listings, comparisons, and reports of a classifier by band and source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions import similarity, urls
from candor.functions.text import col, review_hash

#: Platforms that a host may name (fixed values), in order.
PLATFORMS = ("amazon", "flipkart", "meesho", "reliancedigital", "jiomart", "bigbasket", "nykaa", "myntra")
UNCONFIRMED = "could not confirm it is the identical product"


def platform(url: str | Column, names: Sequence[str] = PLATFORMS) -> Column:
    """The first platform that the host names, capitalised, else the host without www. (F32)."""
    h = F.coalesce(urls.host(url), F.lit(""))
    out = F.when(F.lit(False), "")
    for n in names:
        out = out.when(F.contains(h, F.lit(n)), n.title())
    return out.otherwise(F.coalesce(F.nullif(F.replace(h, F.lit("www."), F.lit("")), F.lit("")), F.lit("Unknown store")))


def product_address(df: DataFrame, url: str, stores: DataFrame, id_col: str, name: str = "is_product") -> DataFrame:
    """``df`` with whether the address is on a known store and holds one of its product patterns in path or query.
    ``stores``: (domain, store, patterns array), a registry."""
    where = F.concat(urls.path(url), F.when(urls.query(url) != "", F.concat(F.lit("?"), urls.query(url))).otherwise(""))
    known = urls.with_store(df, url, stores.select("domain", "store"), id_col).join(stores.groupBy("store").agg(F.flatten(F.collect_list("patterns")).alias("_patterns")), "store", "left")
    return known.withColumn(name, F.coalesce(F.exists("_patterns", lambda p: F.contains(where, p)), F.lit(False))).drop("_patterns")


def merged_source(scraped: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """One row for each scraped source: what the page declares wins for title, price, brand and image; rating and review
    count only fill gaps; sku falls back to the declared one, then the part number; identifiers and stock are the declared ones alone (J11)."""
    s, d = scraped.alias("s"), declared.alias("d")
    wins = [F.coalesce(f"d.{c}", f"s.{c}").alias(c) for c in ("title", "price", "brand", "image_url")]
    fills = [F.coalesce(f"s.{c}", f"d.{c}").alias(c) for c in ("rating", "review_count")]
    own = [F.col(f"d.{c}").alias(c) for c in ("gtin", "mpn", "in_stock")]
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return s.join(d, F.col(f"s.{key}") == F.col(f"d.{key}"), "left").select(f"s.{key}", *wins, *fills, F.coalesce(filled("s.sku"), filled("d.sku"), filled("d.mpn")).alias("sku"), F.coalesce(F.upper("d.currency"), "s.currency").alias("currency"), *own)


def translation(df: DataFrame, text: str, table: DataFrame, name: str = "translation", least: float = 0.6) -> DataFrame:
    """``df`` with the known translation of a text: by equality of the lower case, else of the first entry (by ``ordinal``) whose
    sequence ratio is over ``least`` (F39). ``table``: (original, translated, ordinal), of any size.

    Different texts are looked up once. Those without an equal entry meet the entries that share three characters in a row
    and whose length allows the ratio; only such pairs are compared."""
    low = df.select(F.lower(col(text)).alias("_t")).where("_t is not null").distinct()
    entries = table.select(F.col("original").alias("_o"), "translated", "ordinal")
    equal = entries.groupBy("_o").agg(F.min_by("translated", "ordinal").alias("_x"))
    known = low.join(equal, F.col("_t") == F.col("_o"), "left").select("_t", "_x")
    longest = table.agg(F.max(F.char_length("original"))).first()[0] or 0
    reach = 2 / least - 1  # twice the shorter over both lengths is at most the ratio
    threes = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(c) - 2)), lambda i: F.substring(c, i, F.lit(3))))
    open_ = known.where(F.col("_x").isNull() & (F.char_length("_t") <= longest * reach)).select("_t", F.explode(threes(F.col("_t"))).alias("_g"))
    met = open_.join(entries.select("*", F.explode(threes(F.col("_o"))).alias("_g")), "_g").select("_t", "_o", "translated", "ordinal").distinct()
    fits = F.greatest(F.char_length("_t"), F.char_length("_o")) <= F.least(F.char_length("_t"), F.char_length("_o")) * reach
    like = met.where(fits).where(similarity.sequence_ratio("_o", "_t") > least).groupBy("_t").agg(F.min_by("translated", "ordinal").alias("_y"))
    found = known.join(like, "_t", "left").select("_t", F.coalesce("_x", "_y").alias("_found"))
    return df.join(found, F.lower(col(text)) == F.col("_t"), "left").withColumn(name, F.col("_found")).drop("_t", "_found")


def labelled_findings(findings: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Findings with the human label of their text, if there is one. ``labels``: (review_hash, label), one row a hash."""
    keyed = findings.withColumn("review_hash", review_hash(text))
    return keyed.join(labels.select("review_hash", "label"), "review_hash", "left")


def has_label(findings: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Only findings whose text has a label."""
    keyed = findings.withColumn("review_hash", review_hash(text))
    return keyed.join(labels.select("review_hash"), "review_hash", "left_semi")


def with_details(items: DataFrame, details: DataFrame, url: str = "url") -> DataFrame:
    """Listings with what reading their page gave, by canonical address; the last reading of an address counts.
    ``details``: (url, ordinal, ...) with fields that replace those of the listing where they are known."""
    fields = [c for c in details.columns if c not in (url, "ordinal")]
    last = details.withColumn("_k", urls.canonical_key(url)).groupBy("_k").agg(F.max_by(F.struct(*fields), "ordinal").alias("_d"))
    joined = items.withColumn("_k", urls.canonical_key(url)).join(last, "_k", "left")
    new = {c: F.coalesce(f"_d.{c}", c) if c in items.columns else F.col(f"_d.{c}") for c in fields}
    return joined.withColumns(new).drop("_k", "_d")


def same_product(relation: str | Column, differences: str | Column) -> Column:
    """Exact, or similar with nothing against it but that it couldn't be confirmed: what may enter prices and history (FL6)."""
    return (col(relation) == "exact") | ((col(relation) == "similar") & (col(differences) == F.array(F.lit(UNCONFIRMED))))


def views(image: Column, image_url: Column, title: Column) -> Column:
    """struct(image, text, both): in which views a listing is shown (FL7)."""
    by_image = (F.coalesce(image, F.lit(0.0)) >= 0.5) | F.coalesce(image_url != "", F.lit(False))
    by_text = F.coalesce(title, F.lit(0.0)) >= 0.25
    return F.struct(by_image.alias("image"), by_text.alias("text"), (by_image & by_text).alias("both"))


def in_range(observed: Column, now: Column, days: int = 180) -> Column:
    """Whether a point lies in the last ``days`` (FL8)."""
    return observed >= now - F.make_dt_interval(F.lit(days))


def relation_counts(listings: DataFrame, key: str, order: Column) -> DataFrame:
    """Exact and similar listings of each source, and the first by ``order`` that may be the very product."""
    fits = same_product("relation", "differences")
    return listings.groupBy(key).agg(
        F.sum((F.col("relation") == "exact").cast("long")).alias("exact_count"), F.sum((F.col("relation") == "similar").cast("long")).alias("similar_count"), F.min_by(F.when(fits, F.col("listing_id")), F.when(fits, order)).alias("best_listing")
    )


def comparison_order(offers: DataFrame, key: str) -> DataFrame:
    """Offers with their place in the comparison: eligible ones by price, other ones, possible ones, each in order."""
    rank = F.when(F.col("possible"), 2).when(F.col("eligible"), 0).otherwise(1)
    w = Window.partitionBy(key).orderBy(rank, F.when(rank == 0, F.col("price")), "ordinal")
    return offers.withColumn("place", F.row_number().over(w))


def bands(scored: DataFrame, keys: Sequence[str] = (), genuine_at: float = 0.045, suspicious_at: float = 0.9) -> DataFrame:
    """Shares of rows by band of probability, and how pure they are: ``scored`` has label (1 fake) and probability."""
    low, high = F.col("probability") <= genuine_at, F.col("probability") >= suspicious_at
    share = lambda on: F.round(F.avg(on.cast("double")), 4)
    inside = lambda on, y: F.round(F.avg(F.when(on, (F.col("label") == y).cast("double"))), 4)
    aggs = [F.count("*").alias("n"), share(low).alias("genuine_share"), inside(low, 0).alias("real_within_genuine"), share(~low & ~high).alias("uncertain_share"), share(high).alias("flagged_share"), inside(high, 1).alias("fake_within_flagged")]
    return scored.groupBy(*keys).agg(*aggs)


def source_recall(scored: DataFrame, source: str, suspicious_at: float = 0.9) -> DataFrame:
    """For each source: rows, recall of fakes at the flag and at 0.5, and reals wrongly flagged."""
    p, fake = F.col("probability"), F.col("label") == 1
    part = lambda who, at: F.round(F.avg(F.when(who, (p >= at).cast("double"))), 4)
    return scored.groupBy(source).agg(F.count("*").alias("test_rows"), part(fake, suspicious_at).alias("recall_at_flag"), part(fake, 0.5).alias("recall_at_half"), part(~fake, suspicious_at).alias("real_flagged"))


def rule_baseline(findings: DataFrame) -> DataFrame:
    """How the rules alone do on labelled findings (classification, label 1 fake): counts, precision, recall."""
    said, fake = F.col("classification") == "suspicious", F.col("label") == 1
    n = lambda on: F.sum(on.cast("long"))
    t = findings.agg(n(said & fake).alias("tp"), n(said & ~fake).alias("fp"), n(~said & fake).alias("fn"), n(~said & ~fake).alias("tn"))
    return t.withColumns({"precision": F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 4), "recall": F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 4)})


def split_fingerprint(rows: DataFrame, id_col: str, text: str, split: str) -> DataFrame:
    """One digest for each split, the same for any order of its rows (R16): exclusive or and sum of row hashes, which
    add up in parts, then SHA-256."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text))
    t = rows.groupBy(split).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    return t.select(split, "n", F.sha2(F.concat_ws(",", "n", "x", "s"), 256).alias("fingerprint"))
