from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candor.operators import candidates, extract, labels, matching, metrics, neardup, prices, reviews, visual

T0 = datetime(2024, 1, 1)


def offers(spark, rows):
    d = spark.createDataFrame(rows, "part_id int, store string, price double, in_stock boolean, currency string, title string, is_source boolean, ordinal long")
    reason = prices.exclusion_reason(F.col("price"), F.col("in_stock"), F.col("currency"), F.col("title"))
    return d.withColumn("reason", reason).withColumn("eligible", reason.isNull())


def test_exclusion_reasons_are_ordered(spark):
    rows = [(1, "a", None, False, "USD", "Used kettle", False, 0), (1, "b", 5.0, False, "USD", "x", False, 1), (1, "c", 5.0, None, "USD", "Used x", False, 2), (1, "d", 5.0, None, "INR", "pre-owned x", False, 3), (1, "e", 5.0, None, "INR", "x", False, 4)]
    assert [r["reason"] for r in offers(spark, rows).orderBy("ordinal").collect()] == ["no price shown", "out of stock", "price in USD, not comparable", "refurbished / used listing", None]


def test_lowest_prefers_what_can_be_bought_and_the_source_on_ties(spark):
    rows = [(1, "a", 3.0, False, "INR", "x", False, 1), (1, "a", 9.0, True, "INR", "x", False, 2), (1, "b", 7.0, True, "INR", "x", False, 3), (1, "source", 7.0, True, "INR", "x", True, 0)]
    best = prices.best_per_store(offers(spark, rows), ["part_id"])
    assert {r["store"]: r["price"] for r in best.collect()} == {"a": 9.0, "b": 7.0, "source": 7.0}
    assert prices.lowest(best, ["part_id"]).first()["store"] == "source"


def debounce(rows, minutes):
    """The plain rule, row by row."""
    kept, last = [], {}
    for k, t, o, p in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k in last and last[k][1] == p and t - last[k][0] < timedelta(minutes=minutes):
            continue
        last[k] = (t, p)
        kept.append((k, o))
    return sorted(kept)


@pytest.mark.parametrize("parts", [1, 7])
def test_debounce_is_a_fold(spark, parts):
    import random

    rng = random.Random(3)
    rows = [(rng.choice("ab"), T0 + timedelta(minutes=rng.randint(0, 400)), i, float(rng.randint(1, 2))) for i in range(300)]
    d = spark.createDataFrame(rows, "k string, observed_at timestamp_ntz, ordinal long, price double").repartition(parts)
    got = sorted((r["k"], r["ordinal"]) for r in prices.debounced(d, "k", 30).collect())
    assert got == debounce(rows, 30)


def test_summary_needs_two_points(spark):
    d = spark.createDataFrame([("a", T0, 10.0), ("b", T0, 10.0), ("b", T0 + timedelta(1), 12.0)], "k string, observed_at timestamp, price double")
    got = {r["k"]: (r["change_pct"], r["trend"]) for r in prices.price_summary(d, "k").collect()}
    assert got["a"] == (None, None) and got["b"] == (pytest.approx(20.0), "rising")


def review(spark, rows):
    return spark.createDataFrame(rows, "review_id int, text string, rating int, near_duplicate boolean")


def test_rules(spark):
    long = "this kettle boils water in two minutes and pours well"
    rows = [(1, "best product ever", 5, False), (2, "worst useless thing", 5, False), (3, "great nice", 1, False), (4, "great", 5, False), (5, long, None, False), (6, long, 3, True), (7, "ok", None, False)]
    got = {r["review_id"]: (r["classification"], r["risk"], r["suspicion"]) for r in reviews.rule_findings(review(spark, rows)).collect()}
    assert got == {1: ("suspicious", "high", 0.8), 2: ("suspicious", "medium", 0.5), 3: ("needs-review", "medium", 0.45), 4: ("needs-review", "medium", 0.2), 5: ("genuine-looking", "low", 0.0), 6: ("suspicious", "medium", 0.55), 7: ("needs-review", "medium", 0.0)}


def test_model_merge_never_lowers_a_rule(spark):
    long = "this kettle boils water in two minutes and pours well"
    f = reviews.rule_findings(review(spark, [(1, "best product ever", 5, False), (2, long, None, False), (3, long, None, False), (4, long, None, False), (5, long, None, False)]))
    p = F.element_at(F.array(*[F.lit(x) for x in (0.01, 0.95, 0.01, 0.5)]), F.col("review_id"))
    m = reviews.merge_model(f.withColumn("probability", F.when(F.col("review_id") <= 4, F.try_element_at(F.array(*[F.lit(x) for x in (0.01, 0.95, 0.01, 0.5)]), F.col("review_id")))))
    got = {r["review_id"]: (r["classification"], r["detector"]) for r in m.collect()}
    assert got == {1: ("suspicious", "ml+rules"), 2: ("suspicious", "ml+rules"), 3: ("genuine-looking", "ml+rules"), 4: ("needs-review", "ml+rules"), 5: ("genuine-looking", "rules")}
    assert p is not None


def test_trust_without_reviews(spark):
    f = reviews.rule_findings(spark.createDataFrame([("p", "fine solid kettle for tea and for coffee too", 5, False)], "product string, text string, rating int, near_duplicate boolean")).withColumn("probability", F.lit(None).cast("double"))
    products = spark.createDataFrame([("p", True, True, True, 4.0), ("q", True, False, False, None)], "product string, has_title boolean, has_price boolean, has_image boolean, rating double")
    got = {r["product"]: r for r in reviews.trust_score(f, products, "product").collect()}
    assert (got["p"]["score"], got["p"]["verdict"]) == (95.0, "VERIFIED")
    assert (got["q"]["score"], got["q"]["verdict"], got["q"]["n_reviews"]) == (None, "INSUFFICIENT DATA", 0)


def test_burst_fills_days_of_none(spark):
    rows = [("k", T0)] * 12 + [("k", T0 + timedelta(days=3))] * 4 + [("few", T0)] * 3
    d = spark.createDataFrame(rows, "k string, ts timestamp")
    b = reviews.burst_summary(d, "k", "ts", F.lit("2024-02-01").cast("timestamp")).collect()
    assert len(b) == 1 and b[0]["peak_count"] == 12 and b[0]["vol_30d"] == 4 and b[0]["vol_90d"] == 16
    assert [r["count"] for r in reviews.burst_days(d, "k", "ts").orderBy("day").collect()] == [12, 0, 0, 4]


def test_similar_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(20)]
    texts += [t + " tail" for t in texts[:6]] + ["a b c", "", None]
    grams = [None if t is None or len(t.split()) < 4 else {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grams[i] and grams[j] and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8}
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert {(r["a"], r["b"]) for r in neardup.similar_pairs(d, "id", "text").collect()} == want and want


def test_ranking_metrics_against_pairs(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.3), (0, 0.4), (1, 0.8)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    r = metrics.ranking(spark.createDataFrame(rows, "label int, score double"), []).first()
    assert r["roc_auc"] == pytest.approx(auc) and r["positives"] == 3


def test_mcnemar_and_gates(spark):
    d = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2 + [(True, True)] * 3, "a_right boolean, b_right boolean")
    assert metrics.mcnemar(d).first()["p_value"] == pytest.approx(2 * (1 + 10 + 45) / 1024)
    assert metrics.mcnemar(d.where("a_right and b_right")).first()["p_value"] == 1.0
    assert metrics.promote(None, 0.1) and metrics.promote(0.95, 0.936) and not metrics.promote(0.95, 0.92)
    assert metrics.temperature([10.0, -10.0, 8.0], [1, 0, 0]) > 1


def test_upserts(spark):
    old = spark.createDataFrame([("u", "h1", 1, "a"), ("u", "h2", 2, "b")], "url string, hash string, seen int, v string")
    new = spark.createDataFrame([("u", "h1", 9, "x", 1), ("u", "h1", 8, "y", 2), ("u", "h3", 7, "z", 3)], "url string, hash string, seen int, v string, o int")
    got = {r["hash"]: (r["seen"], r["v"]) for r in labels.upsert(old, new, ["url", "hash"], "o", ("seen",)).collect()}
    assert got == {"h1": (1, "y"), "h2": (2, "b"), "h3": (7, "z")}


def test_labels_clear_and_refuse(spark):
    none = spark.createDataFrame([], "review_hash string, label string")
    batch = spark.createDataFrame([("a b", "real", 1), ("A  b", "fake", 2), ("c", "real", 1), ("c", "clear", 2), (" ", "real", 1), ("d", "maybe", 1)], "text string, label string, ordinal int")
    assert [r["label"] for r in labels.save_labels(none, batch).collect()] == ["fake"]


NUMBERS = {"s_price", "c_price", "image"}
FIELDS = ["s_title", "s_brand", "s_price", "c_title", "c_price", "c_url", "s_gtin", "c_gtin", "s_mpn", "c_mpn", "image", "visual"]


def scores(spark, cases):
    """All cases in one plan; each is (source title, candidate title, other fields)."""
    rows = [{"s_title": s, "s_brand": "Acme", "s_price": 100.0, "c_title": c, "c_price": 100.0} | more for s, c, more in cases]
    d = spark.createDataFrame([(k, *[r.get(f) for f in FIELDS]) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{f} {'double' if f in NUMBERS else 'string'}" for f in FIELDS))
    return sorted(matching.score_matches(d).collect(), key=lambda r: r["k"])


def test_matches(spark):
    good = "4006381333931"
    cases = [
        ("Acme KX20 Phone 128 GB black", "Acme KX20 Phone 128GB", {}, "verified", "exact"), ("Acme KX20 Phone 128 GB", "Acme KX20 Pro Phone 128 GB", {}, "rejected", "similar"), ("Acme KX20 Phone", "Acme KX20 Phone case", {}, "rejected", "none"), ("Acme KX20 Phone", "Acme ZZ99 Phone", {}, "rejected", "similar"),
        ("Acme KX20 Phone 128 GB", "Acme KX20 Plus Phone 128 GB", {}, "rejected", "similar"), ("Acme KX20 Phone 128 GB", "Acme KX20 Phone 256 GB", {}, "candidate", "similar"), ("Acme KX20 Phone", "Acme KX20B Phone", {}, "verified", "exact"), ("Acme Surge 5 Shoes", "Acme Surge 5X Shoes", {}, "rejected", "similar"),
        ("Acme Surge 5 Shoes", "Acme Surge 6 Shoes", {}, "rejected", "similar"), ("Acme Surge 5 Shoes", "Nike Surge 5 Shoes", {}, "rejected", "none"), ("Acme Surge 5 Shoes for men", "Acme Surge 5 Shoes for women", {}, "rejected", "none"), ("Acme Surge 5 Shoes", "Acme Surge 5 zebra river storm team Shoes", {}, "candidate", "similar"),
        ("Acme Argan Shampoo 200 ml", "Acme Lily Conditioner 200 ml", {}, "rejected", "none"), ("Acme KX20 Phone case", "Acme KX20 Phone", {}, "rejected", "none"), ("Acme KX20 Phone", "Acme KX20 Phone | Without Charger", {}, "verified", "exact"), ("Refurbished Acme KX20 Phone", "Pre-owned Acme KX20 Phone", {}, "candidate", "similar"),
        ("Acme 55 inch QX9 TV", "Acme 65 inch QX9 TV", {}, "candidate", "similar"), ("Acme Steel Kettle 1.5 l", "Acme Steel Kettle 1500 ml", {}, "verified", "exact"), ("Acme KX20 Phone", "Renewed Acme KX20 Phone", {}, "rejected", "none"), ("Acme KX20 Phone", "Acme KX20 Phone", {"s_gtin": good, "c_gtin": "036000291452"}, "rejected", "similar"),
        ("Acme KX20 Phone", "Acme KX20 Phone", {"c_price": 10.0}, "rejected", "none"), ("Acme KX20 Phone", "Other thing entirely", {"s_gtin": good, "c_gtin": good}, "rejected", "none"), ("Acme Steel Kettle", "Acme Steel Kettle", {"visual": "different"}, "candidate", "similar"), ("", None, {"s_brand": None, "s_price": None}, "candidate", "similar"),
    ]
    got = scores(spark, [c[:3] for c in cases])
    wrong = [(c, r["status"], r["relation"], r["score"], r["flags"], r["differences"]) for c, r in zip(cases, got, strict=True) if (r["status"], r["relation"]) != c[3:]]
    assert not wrong, wrong


def test_identifiers_photos_addresses_and_notes_in_matches(spark):
    good, phone = "4006381333931", "Acme KX20 Phone"
    r = scores(
        spark,
        [(phone, "Acme KX20 handset", {"s_gtin": good, "c_gtin": good}), (phone, phone, {"s_mpn": "AB12345", "c_mpn": "ab-12345x"}), (phone, "Acme KX20 Phone AB12345", {"s_mpn": "AB12345"}), ("Acme Steel Kettle", "Acme Kettle", {}), ("Acme Steel Kettle", "Acme Kettle", {"image": 0.75}), ("Acme Steel Kettle", "Acme Kettle", {"image": 0.85}),
         ("Acme Surge KX20 Phone", "Acme phone", {"c_url": "https://shop.example/acme-surge-kx20-phone-black/p/1"}), ("Acme KX20 Phone 128 GB", "Acme KX20 Phone 256 GB", {}), (phone, "Acme KX20 Pro Phone", {}), (phone, phone, {"c_price": 300.0})],
    )
    assert r[0]["score"] >= 0.77 and "same part number" in r[1]["reasons"] and "part number in the title" in r[2]["reasons"]
    assert r[4]["score"] == pytest.approx(r[3]["score"] + 0.05) and r[5]["score"] == pytest.approx(r[3]["score"] + 0.10)
    assert r[6]["coverage"] == 1.0 and r[6]["code_score"] == 1.0
    assert r[7]["differences"] == ["storage 256 GB instead of 128 GB"] and r[8]["differences"] == ["the Pro version of this model"] and r[9]["flags"] == ["price off"]


def test_specs_and_memory(spark):
    d = spark.createDataFrame([("Kettle 1.5 l 2 kg SPF 50 5G pack of 3 1 TB 30 cm",), ("Phone 8 GB RAM 128 GB",)], "t string")
    read = lambda d: matching.with_specs(d.withColumn("text", matching.normal("t")), "text", "x_").collect()
    s = read(d)[0]["x_specs"]
    assert s == {"ml": [1500.0], "g": [2000.0], "spf": [50.0], "pcs": [3.0], "storage_gb": [1024.0], "inch": [11.8]}
    titles = ["Phone 8 GB RAM 128 GB", "Phone (6GB, 128GB)", "8GB stick", "256 GB card", "RAM: 16 GB SSD 512 GB", "4gb 8gb", "plain"]
    got = read(spark.createDataFrame([(x,) for x in titles], "t string"))
    assert [tuple(r["x_memory"]) for r in got] == [([8.0, 128.0], []), ([6.0], [128.0]), ([8.0], []), ([], [256.0]), ([16.0], [512.0]), ([4.0], [8.0]), ([], [])]


def test_conditions(spark):
    rows = ["Phone (Renewed)", "never used phone", "Used phone", "open-box phone", "phone"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(matching.condition("t")).collect()]
    assert got == ["refurbished", "new", "used", "open_box", "new"]


def test_greedy_dedupe(spark):
    rows = [(1, "s", "red steel kettle two l", 0.5, 0), (1, "s", "red steel kettle two l.", 0.9, 1), (1, "s", "garden hose", 0.1, 2), (1, "t", "red steel kettle two l", 0.2, 3)]
    d = spark.createDataFrame(rows, "k int, store string, title string, match_score double, ordinal int")
    assert sorted(r["ordinal"] for r in candidates.same_listing_dedupe(d, ["k"]).collect()) == [1, 2, 3]


PAGE = """<html><head><title>Kettle page</title><meta property="og:title" content="Meta Kettle"><script type="application/ld+json">
{"@graph": [{"@type": "Product", "name": "No offer"}, {"@type": "Product", "name": "Acme Kettle", "brand": {"name": "Visit the Acme Store"}, "gtin13": "4006381333931",
 "offers": {"@type": "AggregateOffer", "offers": [{"availability": "OutOfStock"}, {"price": "1,299", "priceCurrency": "inr", "availability": "InStock"}]},
 "aggregateRating": {"ratingValue": 4.4, "reviewCount": "12"}, "review": [{"@type": "Review", "reviewBody": "Boils &amp; pours", "reviewRating": {"ratingValue": 4.5}}],}]}
</script></head></html>"""


def test_extraction(spark):
    d = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>nothing"), (4, "<h1>Only a heading</h1>")], "id int, html string")
    read = extract.read_pages(d)
    got = {r["id"]: r for r in extract.products(read).collect()}
    a = got[1]
    assert (a["p_title"], a["p_price"], a["p_currency"], a["p_brand"], a["in_stock"], a["p_review_count"]) == ("Acme Kettle", 1299.0, "INR", "Acme", True, 12)
    assert a["accepted"] and a["sources"] == ["json", "meta", "page"] and not got[2]["accepted"] and got[4]["reject_reason"] == "no price, no structured data"
    r = extract.declared_reviews(read, "id").collect()
    assert [(x["id"], x["text"], x["rating"]) for x in r] == [(1, "Boils & pours", 4)]


def test_link_states(spark):
    ok = ("https://a.b/x", "https://a.b/x")
    rows = [(404, *ok, "t", False), (410, *ok, "t", False), (503, *ok, "t", False), (202, *ok, "t", False), (407, *ok, "t", False), (418, *ok, "t", False), (302, *ok, "t", False)]
    rows += [(200, "https://a.b/x", "https://a.b/", "t", False), (200, "https://a.b/x", "https://a.b/search/q", "Steel kettle", False), (200, "https://a.b/x", "https://a.b/y?q=k", "Steel kettle", False), (200, "https://a.b/c/1", "https://a.b/search/2", "Steel kettle", False)]
    rows += [(200, *ok, "Are you a robot?", True), (200, *ok, "Oops, something went wrong", True), (200, *ok, "Garden hose green", True), (200, *ok, "Garden hose green", False), (200, *ok, "Steel kettle here", False), (200, *ok, "", False)]
    d = spark.createDataFrame(rows, "s int, u string, f string, t string, p boolean")
    none = F.lit(None).cast("string")
    judged = extract.link_state(F.col("s"), "u", "f", F.col("t"), none, none, F.array().cast("array<string>"), F.col("p"), F.lit("Buy Steel kettle 2l online"))
    got = [r[0]["state"] for r in d.select(judged).collect()]
    assert got == ["dead", "dead", "unchecked", "unchecked", "unchecked", "dead", "unchecked", "dead", "dead", "dead", "ok", "unchecked", "dead", "dead", "unchecked", "ok", "unchecked"]
    untitled = extract.link_state(F.col("s"), "u", "f", F.col("t"), none, none, F.array().cast("array<string>"), F.col("p"))
    assert [r[0]["state"] for r in d.where("s = 200 and u = f").select(untitled).collect()] == ["unchecked", "dead", "ok", "ok", "ok", "unchecked"]


def test_walls(spark):
    rows = [(200, "Robot check"), (None, "checking your browser"), (403, "x"), (500, "Access denied"), (500, "x"), (200, "Please log in to see more"), (200, "log in " + "x " * 500 + "to continue"), (200, "log in to continue " + "word " * 300), (200, "Captcha " + "word " * 600), (None, None)]
    d = spark.createDataFrame(rows, "s int, t string")
    assert [r[0] for r in d.select(extract.wall(F.col("s"), "t")).collect()] == ["blocked", "blocked", "blocked", "blocked", "http_500", "login", None, None, None, None]


def test_picture_features():
    import numpy as np

    rng = np.random.default_rng(1)
    picture = np.full((90, 60, 3), 255, dtype=np.uint8)
    picture[20:60, 10:50] = rng.integers(0, 200, (40, 40, 3))
    square = visual.trimmed(picture)
    assert square.shape == (40, 40, 3) and visual.phash(square) == visual.phash(square.copy()) < 1 << 64
    assert visual.hsv_histogram(picture).sum() == pytest.approx(1.0)
    assert visual.decoded(b"short") is None


def test_near_duplicates_of_common_texts(spark):
    """Sixty copies have only grams of more than 50 texts, as do two texts that differ in a word."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    texts = [base] * 60 + [base + " more", "quite another text of six words", "quite another text of other words", None, "a b c"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert not neardup.flagged(d, "id", "text").count()
    assert sorted(r["id"] for r in neardup.whole_flagged(d, "id", "text").collect()) == list(range(61))
    pairs = neardup.class_pairs(neardup.gram_classes(d, "id", "text")).collect()
    assert [(r["a"], r["b"], r["overlap"]) for r in pairs] == [(0, 60, 18)]


def test_exact_mode_of_small_groups(spark):
    near = "a fine kettle that boils water for tea quickly"
    rows = [("p", 1, near), ("p", 2, near + "."), ("p", 3, near.replace("fine", "fino")), ("p", 4, "a b c"), ("p", 5, "a b c"), ("q", 6, near), (None, 7, near), (None, 8, near)] + [("r", 100 + i, near) for i in range(151)]
    d = spark.createDataFrame(rows, "g string, id int, text string")
    assert sorted(r["id"] for r in neardup.exact_flagged(d, "g", "id", "text").collect()) == [1, 2, 3, 7, 8] + [100 + i for i in range(151)]  # the large group by its grams


def test_all_titles_of_a_block_are_paired(spark, tmp_path):
    """The first and fourth title of a block, three ids apart, meet; equal titles are one class."""
    from candor.plans import match_queries

    parts = [(1, "red bolt", 5), (2, "old gear", 6), (3, "new ring", 7), (4, "red bolt", 9), (5, "red bolt", 5)]
    rows = [(i, name, "Brand#1", "SMALL", size, 1.0) for i, name, size in parts]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["a_id"], r["b_id"]): (r["a_parts"], r["b_parts"]) for r in match_queries.title_class_jaccard(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)} and got[1, 4] == (2, 1)
    assert {(r["part_id"], r["class_id"]) for r in match_queries.title_class_members(spark, str(tmp_path)).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)}


def test_model_merge_rules(spark):
    rows = [("suspicious", 0.92, "high", ["promotional"], 0.95), ("suspicious", 0.6, "medium", ["promotional"], 0.3), ("needs-review", 0.35, "medium", [], 0.999), ("needs-review", 0.35, "medium", [], 0.91), ("genuine-looking", 0.58, "low", [], 0.01), ("needs-review", 0.35, "medium", ["short_praise"], 0.01), ("needs-review", 0.35, "medium", [], 0.5), ("suspicious", 0.7, "high", [], None)]
    d = spark.createDataFrame(rows, "classification string, confidence double, risk string, signals array<string>, probability double")
    got = [(r["classification"], r["confidence"], r["risk"], len(r["signals"]), r["detector"]) for r in reviews.merge_model(d).collect()]
    assert got == [("suspicious", 0.95, "high", 2, "ml+rules"), ("suspicious", 0.6, "medium", 2, "ml+rules"), ("suspicious", 0.95, "high", 1, "ml+rules"), ("suspicious", 0.91, "medium", 1, "ml+rules"), ("genuine-looking", 0.9, "low", 1, "ml+rules"), ("needs-review", 0.45, "medium", 2, "ml+rules"), ("needs-review", 0.45, "medium", 1, "ml+rules"), ("suspicious", 0.7, "high", 0, "rules")]


def test_promotion_needs_whole_words(spark):
    d = spark.createDataFrame([("really good goods and goodness",), ("GOOD GOOD item",), ("100% workings",), ("guaranteed result!",)], "text string").withColumns({"rating": F.lit(3), "near_duplicate": F.lit(False)})
    assert [r["signals"] for r in reviews.rule_findings(d).collect()] == [[], ["promotional"], [], ["promotional"]]


def test_categories_by_brand_and_memory(spark):
    rows = [("Surge 5", "Nike"), ("Thing 8 GB RAM", None), ("Nike thing", None), ("plain thing", None), ("KX20 back case", None), ("Rose shampoo", "Nike")]
    d = matching.with_identity(spark.createDataFrame(rows, "t string, b string"), "t", "b", "x_")
    assert [r["x_category"] for r in d.collect()] == ["fashion", "electronics", "fashion", "general", "electronics", "beauty"]


def test_search_texts(spark):
    d = spark.createDataFrame([("Acme Surge Phone KX20 5G (6GB, 128GB) black", "Acme"), ("Rice 5 kg", None)], "t string, b string")
    got = [r[0] for r in matching.with_identity(d, "t", "b", "x_").select(matching.queries(d, "x_")).collect()]
    assert got[0][0].startswith("acme surge kx20") and got[0][0].endswith("128gb") and got[1] == ["rice 5000g", "rice"]


def test_assembled_parts(spark):
    from candor.operators import assembly

    items = spark.createDataFrame([(1, "https://a.b/x/", 5.0), (2, "https://a.b/y", 6.0)], "id int, url string, price double")
    details = spark.createDataFrame([("https://www.a.b/x", 1, 7.0, "g1"), ("https://a.b/x?utm=1", 2, None, "g2")], "url string, ordinal int, price double, gtin string")
    assert [(r["id"], r["price"], r["gtin"]) for r in assembly.with_details(items, details).orderBy("id").collect()] == [(1, 5.0, "g2"), (2, 6.0, None)]
    table = spark.createDataFrame([("bakwas product hai", "useless product", 1)], "original string, translated string, ordinal int")
    texts = spark.createDataFrame([("Bakwas product hai",), ("bakwas products hain",), ("plain",), (None,)], "text string")
    assert [r[1] for r in assembly.translation(texts, "text", table).collect()] == ["useless product", "useless product", None, None]
    rows = spark.createDataFrame([(i, f"t{i}", "a" if i % 2 else "b") for i in range(20)], "id int, text string, split string")
    one = {tuple(r) for r in assembly.split_fingerprint(rows, "id", "text", "split").collect()}
    assert one == {tuple(r) for r in assembly.split_fingerprint(rows.orderBy(F.desc("id")).repartition(3), "id", "text", "split").collect()} and len(one) == 2
    found = spark.createDataFrame([("suspicious", 1), ("suspicious", 0), ("needs-review", 1), ("genuine-looking", 0)], "classification string, label int")
    assert tuple(assembly.rule_baseline(found).first()) == (1, 1, 1, 1, 0.5, 0.5)


def test_zipped_csv_is_read_by_workers(spark, tmp_path):
    import zipfile

    from candor.sources import files

    def pack(name, **parts):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in parts.items():
                z.writestr(k + (".csv" if k[0] != "_" else ".txt"), v)
        return str(tmp_path / name)

    body = "﻿a, b\n" + "\n".join(f'{i},"x\n{i}"' for i in range(25)) + "\nshort\n"
    got = files.read_zipped_csv(spark, pack("one.zip", data=body, _readme="no"), rows=10)
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["a", "b"] and sorted((int(a), b) for a, b in rows if a != "short") == [(i, f"x\n{i}") for i in range(25)] and ("short", None) in rows
    for bad in (pack("none.zip", _readme="no"), pack("two.zip", x="a\n1", y="a\n2")):
        with pytest.raises(ValueError):
            files.read_zipped_csv(spark, bad)


def test_eligible_stores_against_all_stores(spark):
    """Short lists of stores lose none: one host has most stores, a shop has several hosts, some have no brand or category."""
    import random

    rng = random.Random(5)
    stores = [(f"st{i % 70}", "h0" if i < 60 else f"h{rng.randint(0, 6)}", rng.random() > 0.1, rng.sample(["x", "y", "z"], rng.randint(0, 2)), rng.choice([None, None, "B", "c"]), i) for i in range(140)] + [("nohost", None, True, ["x"], None, -1)]
    sources = [(i, rng.choice(["x", "y", "z", None]), rng.choice(["b", "C", "d", None]), rng.choice(["h0", "h1", "h2", "h9"])) for i in range(40)]
    d = spark.createDataFrame(sources, "source_id int, category string, brand string, source_host string")
    registry = spark.createDataFrame(stores, "store string, host string, enabled boolean, categories array<string>, brand string, ordinal int")
    plain = {}
    for i, category, brand, own in sources:
        met = sorted((0 if b else 1, o, s) for s, h, on, cs, b, o in stores if on and h and h != own and (b.lower() == (brand or "").lower() if b else category in cs))
        plain[i] = list(dict.fromkeys(s for _, _, s in met))[:8]
    found = {i: [] for i in plain}
    for r in candidates.eligible_stores(d, registry).orderBy("source_id", "rank").collect():
        found[r["source_id"]].append(r["store"])
    assert found == plain
    plan = candidates.eligible_stores(d, registry)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [source_id" not in plan and "Window [row_number() windowspecdefinition(source_id" not in plan


def test_stream_suppression_counts_whole_seconds_and_breaks_ties(spark, tmp_path):
    from candor.streaming import observations

    ms = lambda n: timedelta(milliseconds=n)
    rows = [("a", T0 + ms(900), 1, 1.0), ("a", T0 + timedelta(minutes=30) + ms(100), 2, 1.0), ("b", T0, 3, 2.0), ("b", T0, 2, 1.0), ("b", T0, 1, 2.0)]
    d = spark.createDataFrame(rows, "k string, observed_at timestamp, ordinal long, price double")
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    kept = observations.suppressed(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), "k", 30)
    kept.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["k"], r["observed_at"], r["price"]) for r in spark.read.schema(kept.schema).parquet(f"{tmp_path}/out").collect())
    batch = sorted((r["k"], r["observed_at"], r["price"]) for r in prices.debounced(d, "k", 30).collect())
    assert got == batch and len(got) == 5
