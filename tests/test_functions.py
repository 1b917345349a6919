from datetime import datetime

import pytest
from pyspark.sql import functions as F

from candor.functions import dates, identifiers, text, urls


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, price", [("₹1,24,999.50", 124999.5), ("-5", 5.0), ("Rs. 0", None), ("free", None), (None, None), ("MRP 2,499 only", 2499.0)])
def test_parse_price(spark, value, price):
    assert one(spark, text.parse_price("v"), v=value) == price


@pytest.mark.parametrize("value, known", [("http://schema.org/OutOfStock", False), ("SoldOut", False), ("https://schema.org/PreOrder", None), ("presale, available soon", None), ("back-order", None), ("https://soldout.example/InStock", True), ("In stock", True), ("", None), ("ask", None), (None, None)])
def test_availability(spark, value, known):
    assert one(spark, text.availability("v"), v=value) is known


def test_ratings_round_and_gate_differently(spark):
    rows = spark.createDataFrame([(2.5,), (0.6,), (5.4,), (3.0,)], "v double").select(text.review_rating("v"), text.collected_rating("v"), text.imported_rating("v")).collect()
    assert [tuple(r) for r in rows] == [(None, 2, 2), (None, None, 1), (None, None, 5), (3, 3, 3)]


@pytest.mark.parametrize("value, shown", [(999.0, "Rs 999"), (1000.0, "Rs 1,000"), (124999.0, "Rs 1,24,999"), (12345678.5, "Rs 1,23,45,678.50"), (None, "price not read")])
def test_format_inr(spark, value, shown):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(text.format_inr("v")).first()[0] == shown


def test_titles_and_brands(spark):
    assert one(spark, text.clean_title("v", F.lit("ShopMart")), v="  Steel  Kettle 2 L | ShopMart") == "Steel Kettle 2 L"
    assert one(spark, text.clean_title("v"), v="Buy Steel Kettle 2 L online at low prices") == "Steel Kettle 2 L"
    assert one(spark, text.clean_title("v", F.lit("ShopMart")), v="ShopMart : Steel Kettle - Buy at best price") == "Steel Kettle"
    assert one(spark, text.clean_title("v"), v="Buy it online here") == "Buy it online here"
    for bad in ("Loading", " 404 ", "Page not found!", "undefined | Shop", "Just a moment...", "-- ", None):
        assert one(spark, text.clean_title(F.col("v").cast("string")), v=bad) is None
    assert one(spark, text.clean_brand("v"), v="Brand: Acme -") == "Acme"
    assert one(spark, text.clean_brand("v"), v="Visit the Acme Store") == "Acme"


def test_keys_fold_case_and_space(spark):
    assert one(spark, text.review_key("v"), v="  Straße\n GUT ") == "strasse gut"
    assert one(spark, text.review_hash("v"), v="A  b") == one(spark, text.review_hash("v"), v="a B")


def test_sentiment_counts_entries_not_hits(spark):
    assert one(spark, text.sentiment("v", ("good", "great"), ("bad",)), v="Good good great but bad") == 0.33
    assert one(spark, text.sentiment("v", ("good",), ("bad",)), v="plain") == 0.0


@pytest.mark.parametrize(
    "value, day",
    [
        ("Reviewed in India on 5 March 2024", datetime(2024, 3, 5)), ("Mar 5, 2024", datetime(2024, 3, 5)), ("2024-03-05", datetime(2024, 3, 5)), ("3 days ago", datetime(2024, 5, 29)), ("yesterday", datetime(2024, 5, 31)),
        ("2 months ago", None), ("31 February 2024", None), ("soon", None), ("", None), (None, None), ("2 hours ago", datetime(2024, 6, 1)), ("1 week ago", datetime(2024, 5, 25)),
    ],
)
def test_review_dates(spark, value, day):
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    assert one(spark, dates.parse_review_date("v", now).cast("timestamp_ntz"), v=value) == day


def test_gtin_and_mpn(spark):
    assert one(spark, identifiers.normal_gtin("v"), v="4006381333931") == "04006381333931"
    assert one(spark, identifiers.normal_gtin("v"), v="4006381333932") is None
    assert one(spark, identifiers.normal_gtin("v"), v="00000000") is None
    assert one(spark, identifiers.normal_gtin("v"), v=None) is None
    assert one(spark, identifiers.mpn_agree("a", "b"), a="SM-A155F/DS", b="sma155f") is True
    assert one(spark, identifiers.mpn_agree("a", "b"), a="AB12", b="AB123") is False
    assert one(spark, identifiers.mpn_agree("a", "b"), a="ABCD", b="AB123") is None


@pytest.mark.parametrize("url, public", [("http://shop.example/x", True), ("http://127.0.0.1/x", False), ("http://10.1.2.3", False), ("http://172.20.0.1", False), ("http://8.8.8.8", True), ("http://localhost", False), ("http://printer.local/", False), ("ftp://a.b", False), (None, False)])
def test_public_gate(spark, url, public):
    assert one(spark, urls.is_public("v"), v=url) is public


def test_canonical_keys(spark):
    assert one(spark, urls.canonical_key("v"), v="https://www.Shop.example/a/b/?utm=1&sku=2&pid=9#x") == "shop.example/a/b?pid=9&sku=2"
    assert one(spark, urls.canonical_key("v"), v="https://www.shop.example/Some-Name/dp/b0abcdefgh/ref=1") == "shop.example/dp/B0ABCDEFGH"


def test_store_is_the_longest_listed_domain(spark):
    pages = spark.createDataFrame([(1, "https://m.a.shop.example/x"), (2, "https://notshop.example/x"), (3, None)], "id int, url string")
    stores = spark.createDataFrame([("shop.example", "S"), ("a.shop.example", "A")], "domain string, store string")
    assert {r["id"]: r["store"] for r in urls.with_store(pages, "url", stores, "id").collect()} == {1: "A", 2: None, 3: None}


def test_slugs(spark):
    assert one(spark, urls.slug_words("v"), v="https://s.example/in/steel-kettle-1-5-l/p/77") == "steel kettle 1.5 l"


def test_ratio_is_that_of_the_sequence_matcher(monkeypatch):
    import random
    from difflib import SequenceMatcher

    from candor.functions import similarity

    rng = random.Random(3)
    text = lambda n, letters="ab c": "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    pairs = [(text(60), text(60)) for _ in range(2000)] + [(text(300), text(300)) for _ in range(40)] + [("", ""), ("", "a"), ("a", ""), ("naïve ß", "naive ss"), ("x" * 199, "x" * 201), ("x" * 201, "x" * 199)]
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert [similarity.ratio(a, b) for a, b in pairs] == want
    # Short titles take no walk over places.
    monkeypatch.setattr(similarity, "SequenceMatcher", None)
    assert [similarity.ratio(a, b) for a, b in pairs[:2000]] == want[:2000]
