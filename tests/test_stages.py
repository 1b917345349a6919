"""Candidate index, cascade, layers, page nodes, keyed tables: against plain versions and cases of a shop."""

import os

import pytest
from pyspark.sql import functions as F

from candor.operators import blocking, cards, cascade, labels, matching, metrics, neardup, reviews, state_walk
from candor.plans import match_queries
from candor.sources import keyed

SF = "/root/testdata/sf0.01"
TITLE = "Samsung Galaxy M36 5G (Orange Haze, 8GB RAM, 128GB Storage)"


def test_index_loses_no_pair_that_isnt_rejected(spark):
    """Recall of the index over every pair of the query set, with and without common words."""
    a = match_queries.match_sources(spark, SF).withColumnRenamed("a_id", "a")
    b = match_queries.match_listings(spark, SF).withColumnRenamed("b_id", "b")
    every = a.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(3)))).join(b.withColumn("_s", F.pmod("b", F.lit(4)).cast("int")), "_s").where("a <> b")
    d = matching.with_verdict(matching.with_likeness(matching.compared(every, match_queries.PARTS), ratio=False), F.col("title_sim"))
    want = {tuple(r) for r in d.where("status <> 'rejected'").select("a", "b").collect()}
    for rare, size in ((50, 2000), (5, 7)):
        got = {tuple(r) for r in blocking.candidates(a, b, "a", "b", rare=rare, list_size=size, same_ids=True).collect()}
        assert want and want <= got and len(got) < 20 * 2000 / 4


def shop(spark, answers, details=(), links=()):
    """Answers (title, address, price, out of stock, store) to one source, merged."""
    s = spark.createDataFrame([(1, TITLE, "Samsung", 21999.0)], "source_id int, s_title string, s_brand string, s_price double")
    a = spark.createDataFrame([(1, (*x, "Croma")[4], k, *x[:4]) for k, x in enumerate(answers)], "source_id int, store string, ordinal long, c_title string, c_url string, c_price double, out_of_stock boolean")
    l = spark.createDataFrame(list(links), "url_key string, state string")
    d = spark.createDataFrame([(u, 0, s_, g, p) for u, s_, g, p in details], "url_key string, ordinal int, status string, seen_state string, price double")
    return a, cascade.merge(s, a, l, d)


EXACT = ("Samsung Galaxy M36 5G (Orange Haze, 8GB RAM, 128GB Storage)", "https://croma.example/samsung-galaxy-m36/p/1", 21999.0, False)
BIGGER = ("Samsung Galaxy M36 5G (Orange Haze, 8GB RAM, 256GB Storage)", "https://croma.example/samsung-galaxy-m36-256/p/2", 24999.0, False)
NEXT = ("Samsung Galaxy M35 5G (Orange Haze, 8GB RAM, 128GB Storage)", "https://croma.example/samsung-galaxy-m35/p/3", 17999.0, False)
CASE = ("Back Cover Case for Samsung Galaxy M36 5G", "https://croma.example/case-cover-m36/p/4", 399.0, False)


def test_exact_and_similar_are_listed_apart(spark):
    a, m = shop(spark, [EXACT, BIGGER, NEXT, CASE, EXACT, ("", "https://x.example/1", 1.0, False), ("No address", None, 1.0, None)], links=[("croma.example/samsung-galaxy-m36/p/1", "ok")])
    found = {r["ordinal"]: r for r in m.collect()}
    assert found[0]["relation"] == "exact" and found[0]["differences"] == [] and found[0]["link_state"] == "ok" and found[0]["outcome"] == "listed"
    assert found[1]["relation"] == "similar" and "storage 256 GB instead of 128 GB" in found[1]["differences"] and found[2]["relation"] == "similar"
    assert found[3]["outcome"] == "filtered" and set(found) == {0, 1, 2, 3}
    r = cascade.attempts(a, m).first()
    assert (r["raw_results"], r["result_count"], r["similar_count"], r["filtered_out"]) == (7, 3, 2, 1)


def test_dead_links_second_looks_and_stock(spark):
    looks = [(None, ("listed", "unchecked")), (("http_404", "dead", None), ("dead", "dead")), (("ok", "ok", 24999.0), ("listed", "ok")), (("ok", "unchecked", None), ("listed", "unchecked"))]
    keys = [f"s{k}.example/samsung-galaxy-m36-256/p/2" for k in range(4)]
    answers = [(BIGGER[0], f"https://{key}", 24999.0, False, f"s{k}") for k, key in enumerate(keys)] + [(*EXACT[:3], True), NEXT]
    _, m = shop(spark, answers, [(key, *look) for key, (look, _) in zip(keys, looks, strict=True) if look], [(key, "unchecked") for key in keys] + [("croma.example/samsung-galaxy-m35/p/3", "dead")])
    found = {r["ordinal"]: r for r in m.collect()}
    assert [(found[k]["outcome"], found[k]["link_state"]) for k in range(4)] == [want for _, want in looks]
    assert found[5]["outcome"] == "dead" and cascade.STOCK_FLAG in found[4]["flags"]


def test_cascade_chooses_as_if_every_likeness_were_known(spark):
    """Limits cut before the step in Python as a plain ranking of all answers does, and the plan has it above the cut."""
    words = ["Haze", "Ocean", "Storm", "Night", "Pure", "Dawn", "Leaf", "Rock"]
    answers = [(f"Samsung Galaxy M36 5G {w} 8GB RAM {g}GB", f"https://croma.example/{i}{j}", 20000.0 + i, False) for i, w in enumerate(words) for j, g in enumerate((128, 256))] + [NEXT, CASE]
    _, m = shop(spark, answers)
    got = {r["ordinal"] for r in m.where("outcome = 'listed'").collect()}
    rows = spark.createDataFrame([(k, TITLE, "Samsung", 21999.0, t, p, u) for k, (t, u, p, _) in enumerate(answers)], "k int, s_title string, s_brand string, s_price double, c_title string, c_price double, c_url string")
    scored = [r for r in matching.score_matches(rows).collect() if r["relation"] != "none"]
    main = sorted((r for r in scored if r["status"] != "rejected"), key=lambda r: (-r["score"], r["k"]))[:3]
    similar = sorted((r for r in scored if r["status"] == "rejected"), key=lambda r: (-r["closeness"], r["k"]))[:2]
    assert got == {r["k"] for r in main + similar} and len(main) == 3
    assert m.where("outcome = 'not chosen'").count() == len(scored) - len(got)


def test_sources_that_share_a_search_get_what_their_own_answers_give(spark):
    """Without themselves; of a shared address the next answer takes their place; a title's price counts for each answer."""
    s = spark.createDataFrame([(1, "q", TITLE, "Samsung", 21999.0), (2, "q", NEXT[0], "Samsung", 100.0)], "source_id long, search string, s_title string, s_brand string, s_price double")
    answers = [(1, TITLE, "https://croma.example/a", 21999.0), (3, EXACT[0], "https://croma.example/a", 21999.0), (4, EXACT[0], "https://croma.example/b", 100.0), (2, NEXT[0], "https://croma.example/c", 17999.0), (5, CASE[0], "https://croma.example/d", 399.0), (6, EXACT[0], None, 1.0)]
    shared = spark.createDataFrame([("q", k, "Croma", k, t, u, p, False) for k, t, u, p in answers], "search string, own long, store string, ordinal long, c_title string, c_url string, c_price double, out_of_stock boolean")
    alone = shared.join(s.select("source_id")).where("own <> source_id").drop("search", "own")
    links, details = spark.createDataFrame([], "url_key string, state string"), spark.createDataFrame([], "url_key string, ordinal int, status string, seen_state string")
    columns = ["source_id", "ordinal", "pool", "rank", "score", "status", "relation", "closeness", "outcome"]
    one, other = cascade.merge(s, shared, links, details, ratio=False), cascade.merge(s.drop("search"), alone, links, details, ratio=False)
    got = {tuple(r) for r in one.select(*columns).collect()}
    assert got == {tuple(r) for r in other.select(*columns).collect()} and {r[:2] for r in got} == {(1, 2), (1, 3), (1, 4), (1, 5), (2, 1), (2, 4), (2, 5)}
    assert {(r[1], r[5]) for r in got if r[0] == 1 and r[1] in (3, 4)} == {(3, "verified"), (4, None)}
    assert sorted(map(tuple, cascade.attempts(shared, one, s).collect())) == sorted(map(tuple, cascade.attempts(alone, other).collect()))


def test_training_reads_each_text_once(spark):
    """Counts of grams are kept between the passes of a fit."""
    from candor.operators import model

    seen = spark.sparkContext.accumulator(0)

    def look(text):
        seen.add(1)
        return text

    d = spark.createDataFrame([(f"good thing number {k}" if k % 2 else f"bad junk of kind {k}", k % 2) for k in range(8)], "text string, label int")
    fitted = model.train(d.withColumn("text", F.udf(look)("text")), features=1 << 8)
    assert seen.value == 8
    assert all((r["probability"] > 0.5) == (r["label"] == 1) for r in model.probabilities(fitted, d).collect())


def test_titles_of_many_parts_are_read_once(spark):
    """Titles are made different before they are read, and the texts of a title reach all its parts."""
    found = match_queries.search_texts(spark, SF)
    assert "Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == spark.read.parquet(f"{SF}/part.parquet").count()


def test_second_reads_leave_raw_layers_behind(spark):
    from candor.plans import extract_queries

    plan = extract_queries.second_reads(spark, SF)._jdf.queryExecution().optimizedPlan()
    above = [line for line in plan.toString().splitlines() if "Aggregate" in line]
    assert above and not any("raw" in line for line in above)


def test_entries_of_a_comparison_are_worked_out_once(spark):
    from candor.plans import comparison_queries

    assert any("/entries/" in f for f in comparison_queries.compared(spark, SF).inputFiles())


def test_layers_are_asked_only_below_three(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, text string, ordinal int")
    first = rows((1, "a b", 0), (1, "c", 1), (1, "d", 2), (2, "x", 0), (2, "X", 1), (3, " ", 0))
    second, third = rows((1, "never", 0), (2, "x", 0), (2, "y", 1), (2, "z", 2), (3, "s", 0)), rows((2, "never", 0), (3, "t", 0), (4, "u", 0))
    keys = spark.createDataFrame([(i,) for i in range(1, 5)], "k int")
    got = sorted((r["k"], r["text"], r["layer"]) for r in reviews.conditional_layers(keys, [first, second, third], "k", "text").collect())
    assert got == [(1, "a b", 0), (1, "c", 0), (1, "d", 0), (2, "x", 0), (2, "y", 1), (2, "z", 1), (3, "s", 1), (3, "t", 2), (4, "u", 2)]


def test_state_without_json_and_deep_state(spark):
    deep = '{"a": ' * 20 + '{"type": "ProductReviewValue", "text": "well made", "rating": 4}' + "}" * 20
    page = lambda s: f"<script>window.__INITIAL_STATE__ = {s};</script>"
    d = spark.createDataFrame([(1, page(deep)), (2, page("{broken")), (3, None), (4, ""), (5, page('{"type": "ProductReviewValue", "title": "only this"}'))], "k int, html string")
    nodes = state_walk.walk(d.select("k", state_walk.embedded_state("html").alias("v")), "k", "v")
    assert sorted((r["k"], r["text"], r["rating"]) for r in state_walk.state_reviews(nodes, "k").collect()) == [(1, "well made", 4), (5, "only this", None)]
    shallow = state_walk.walk(d.select("k", state_walk.embedded_state("html").alias("v")), "k", "v", 3)
    assert [r["k"] for r in state_walk.state_reviews(shallow, "k").collect()] == [5]
    assert state_walk.walk(d.where("false").select("k", state_walk.embedded_state("html").alias("v")), "k", "v").count() == 0


def test_cards_hold_one_product_and_a_price(spark):
    one = '<div class="c"><a href="/product/fine-kettle-12345?qid=3">Fine steel kettle</a><p>EMI ₹100</p><p>₹1,299.50</p><p>4 stars</p></div>'
    bare = '<div><a href="/product/no-price-at-all-777777">Nothing to pay</a></div>'
    nested = '<section><a href="/product/first-thing-11111">First thing here</a><i>₹10</i><a href="/product/second-thing-2222">Second thing here</a><i>₹20</i></section>'
    far = "<div>" * 12 + '<a href="/product/far-from-price-333333">Far away</a>' + "</div>" * 12 + "<b>₹5</b>"
    d = spark.createDataFrame([(1, f"<body><main>{one}{one}{bare}</main></body>"), (2, nested), (3, f"<div>{far}</div>"), (4, None), (5, ""), (6, "<a href='/search/list-of-things-999999'>x</a>₹3 <b>unclosed")], "k int, html string")
    nodes = cards.page_nodes(d, "k")
    got = {r["address"]: r for r in cards.cards(nodes, "k").collect()}
    assert set(got) == {"/product/fine-kettle-12345"}
    r = got["/product/fine-kettle-12345"]
    assert (r["title"], r["price"], r["mrp"], r["rating"], r["out_of_stock"]) == ("Fine steel kettle", 1299.5, None, 4.0, False)
    assert cards.cards(cards.page_nodes(d.where("false"), "k"), "k").count() == 0


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    at, schema, keys = f"{tmp_path}/t", "k string, first int, v string", ["k"]
    batch = lambda *r: spark.createDataFrame(list(r), "k string, first int, v string, o int")
    keyed.upsert_keyed(at, batch(*[(f"k{i}", 1, "a", i) for i in range(40)]), schema, keys, "o", ("first",), 8)
    files = lambda: {os.path.join(p, f): os.path.getmtime(os.path.join(p, f)) for p, _, fs in os.walk(f"{at}/data") for f in fs if f.endswith(".parquet")}
    before = files()
    keyed.upsert_keyed(at, batch(("k3", 9, "b", 1), ("k3", 9, "c", 2)), schema, keys, "o", ("first",), 8)
    after = files()
    assert all(after[f] == t for f, t in before.items()) and len(after) == len(before) + 1
    rows = {r["k"]: (r["first"], r["v"]) for r in keyed.read_keyed(spark, at, schema).collect()}
    assert len(rows) == 40 and rows["k3"] == (1, "c") and rows["k4"] == (1, "a")
    keyed.upsert_keyed(at, batch(), schema, keys, "o")
    assert keyed.present(spark, at)[0] == 2 and keyed.read_keyed(spark, f"{tmp_path}/none", schema).count() == 0


def test_sixty_equal_texts_and_a_hot_gram(spark):
    base = "one two three four five six seven eight nine ten"
    texts = [base] * 60 + [f"{base} {i} {i}a {i}b" for i in range(12)] + [f"one two three q{i} r{i} s{i} t{i}" for i in range(40)] + [None, "", "a b c"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    grams = [None if t is None or len(t.split()) < 4 else {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    want = {i for i, a in enumerate(grams) if a and any(b and i != j and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(grams))}
    for size in (5000, 3):
        assert {r["id"] for r in neardup.whole_flagged(d, "id", "text", list_size=size).collect()} == want
    assert len(want) == 60


def test_pairs_of_texts_whatever_the_size_of_a_group(spark):
    """Grams of more than 50 texts count, and each pair of copies, of near copies and of both comes once, in lists of any size."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    texts = [base] * 53 + [base + " more"] * 4 + [base + " else", "quite another text of six words", None, "a b c"]
    d = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "id int, text string")
    grams = {100 - i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in enumerate(texts) if t and len(t.split()) >= 4}
    want = {(a, b): (len(grams[a] & grams[b]), len(grams[a] & grams[b]) / len(grams[a] | grams[b])) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8}
    for cell in (500, 7):
        got = neardup.similar_pairs(d, "id", "text", cell=cell).collect()
        assert len(got) == len(want) > 1500 and {(r["a"], r["b"]): (r["overlap"], r["jaccard"]) for r in got} == want


def test_no_gram_is_too_common_for_the_near_duplicate_queries(spark, tmp_path):
    from candor.plans import review_queries

    base = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(i, base) for i in range(60)] + [(60, base + " more"), (61, "quite another text")], "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in review_queries.neardup_flagged(spark, str(tmp_path)).collect()} == set(range(61))
    assert review_queries.neardup_trigram_pairs(spark, str(tmp_path)).count() == 61 * 60 // 2


def test_whole_gram_sets_are_neither_written_nor_kept_but_for_pairs_that_met(spark, monkeypatch):
    """Only keys are written of all texts; sets with their grams only of the two that share rare grams."""
    texts = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(20)] + ["w0x0 " + " ".join(f"w0x{k}" for k in range(1, 11)) + " last"]
    d = spark.createDataFrame(list(enumerate([*texts, texts[3], texts[3]])), "id int, text string")
    written, real = [], neardup.staged
    monkeypatch.setattr(neardup, "staged", lambda df, name: written.append(real(df, name)) or written[-1])
    assert sorted(r["id"] for r in neardup.whole_flagged(d, "id", "text").collect()) == [0, 3, 20, 21, 22]
    assert max(t.count() for t in written if "g" in t.columns) == 2


def test_pairs_are_told_apart_where_they_meet(spark):
    """A pair that shares two keys comes once, with what was read of both, and no pair is dealt again to be told apart."""
    a = matching.read_sources(spark.createDataFrame([(1, "Acme steel kettle 17", "acme")], "a int, s_title string, s_brand string")).select("*", F.lit(2.0).alias("s_price"))
    b = matching.read_listings(spark.createDataFrame([(2, "Acme steel kettle 17"), (3, "Acme kettle steel 17 new"), (4, "Bolt")], "b int, c_title string"))
    pairs = blocking.candidates(a, b, "a", "b", rare=1)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not plan.lstrip().startswith("Aggregate")
    wide = blocking.candidates(a, b, "a", "b", rare=1, whole=True)
    assert set(wide.columns) == {*a.columns, *b.columns} and {r["c_title"] for r in wide.collect()} == {"Acme steel kettle 17", "Acme kettle steel 17 new"}


def test_labels_are_mapped_where_the_rows_are(spark):
    """Two raw labels don't deal all texts to two tasks, and a label alone takes no text along."""
    mapping = spark.createDataFrame([("d", "L0", "real"), ("d", "L1", "fake"), ("d", "L1", "fake")], "dataset_name string, raw_label string, label string")
    rows = spark.createDataFrame([("d", "L1", "A  text", 5), ("d", "L0", "a text", 3), ("d", "L2", "other", 1), (None, "L0", "x", 2), ("d", "L0", None, 4)], "dataset_name string, raw_label string, text string, ordinal long")
    got = labels.mapped(rows, mapping)
    assert sorted((r["text"] or "", r["label"]) for r in got.collect()) == [("", "real"), ("a text", "real")]
    plan = got.select("review_hash", "label")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "min_by(text" not in plan


def test_running_totals_by_ranges(spark):
    rows = [(i % 2, round((i * 37 % 101) / 101, 3), "ab"[i % 3 == 0]) for i in range(400)] + [(0, 0.5, "a")] * 50
    d = spark.createDataFrame(rows, "label int, score double, k string")
    for keys in ([], ["k"]):
        for r in metrics.by_score(d, keys, ranges=7).collect():
            mine = [x for x in rows if not keys or x[2] == r["k"]]
            assert r["tp"] == sum(y for y, s, _ in mine if s >= r["score"]) and r["fp"] == sum(1 - y for y, s, _ in mine if s >= r["score"])
    assert metrics.by_score(d.where("false"), []).count() == 0
    neg = sorted(s for y, s, _ in rows if not y)
    at = 0.9 * (len(neg) - 1)
    want = neg[int(at)] + (neg[int(at) + 1] - neg[int(at)]) * (at - int(at))
    assert metrics.threshold_for_fpr(d, [], 0.1).first()["threshold"] == pytest.approx(want)


def test_conditions_boxes_and_packs(spark):
    titles = ["Acme phone (Renewed)", "Acme renewed formula cream", "Acme phone not refurbished", "Acme open-box delivery", "Acme phone used for calls", "Never used phone", "Like-new phone", "Certified refurbished phone"]
    d = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r[0] for r in d.select(matching.condition("t")).collect()] == ["refurbished", "new", "new", "new", "new", "new", "used", "refurbished"]
    boxes = ["Acme phone without charger", "Acme phone + case", "Acme phone charger", "Phone with fast cable", "Cover for Samsung M36", "Phone, charger included", "Kettle with 20 w adapter", "Ring light"]
    from candor.operators import identity

    d = spark.createDataFrame([(t.lower(),) for t in boxes], "t string")
    assert [r[0] for r in d.select(identity.is_accessory(F.col("t"))).collect()] == [False, False, True, False, True, False, False, True]
    d = spark.createDataFrame([("soap pack of 3 x 2 4pcs 5-pack set of 200 x7",)], "t string")
    assert sorted(d.select(identity.pack_sizes(identity.words(F.col("t")))).first()[0]) == [2.0, 3.0, 4.0, 5.0, 7.0]


def test_a_left_out_source_is_scored_by_a_model_without_it(spark):
    from candor.operators import model

    words = {1: "scum idiot trash worthless", 0: "kind fair mild warm"}
    rows = [(f"{words[i % 2]} w{i % 7} {'abc'[i % 3]}", i % 2, "abc"[i % 3]) for i in range(60)]
    d = spark.createDataFrame(rows, "text string, label int, source string")
    got = model.leave_one_out(d, "source", ["a", "b", "c"], features=1 << 10)
    assert got.count() == 60 and got.columns == ["text", "label", "source", "probability"]
    other = model.probabilities(model.train(d.where("source <> 'b'"), features=1 << 10), d.where("source = 'b'"))
    a, b = ({r["text"]: r["probability"] for r in x.collect()} for x in (got.where("source = 'b'"), other))
    assert all(abs(a[t] - b[t]) < 0.05 and (a[t] > 0.5) == (b[t] > 0.5) for t in b)
    terms = model.top_terms(model.term_weights(model.train(d, features=1 << 14), d), 3).collect()
    assert {r["term"] for r in terms if r["side"] == "fake"} <= {w for x in (words[1].split(),) for w in x} | {"scum idiot", "idiot trash", "trash worthless"} and [r["rank"] for r in terms] == [1, 2, 3, 1, 2, 3]
    high = model.highlights(d.withColumn("k", d["text"]), "k", model.term_weights(model.train(d, features=1 << 14), d), 2).where("rank = 1").collect()
    assert all("kind" not in r["term"] for r in high)


def test_cards_of_ids_of_seven_digits_equal_their_sql(spark, tmp_path):
    """Addresses of ids from 1,000,000 on are cut to six digits, so parts of one page share them."""
    import duckdb

    from candor.plans import collect_queries

    rows = [(1_000_000 + i, ("old ring", "hot bolt")[i % 3 == 0], f"Brand#{i}", "LARGE", i % 50 + 1, 900.0 + i / 10) for i in range(25)] + [(7, "old ring", "Brand#1", "SMALL", 2, 901.5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, address, title, price, mrp, rating, image_url, out_of_stock FROM ({collect_queries.CARDS})").fetchall()
    assert sorted(map(tuple, collect_queries.product_cards(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_pairs_of_titles_are_worked_out_once_for_each_two(spark, tmp_path):
    """Equal titles are one pair of titles whose parts come out each; words are read below the join, pairs aren't dealt anew."""
    from candor.plans import match_queries

    rows = [(i * 50, ("old ring", "hot bolt")[i % 3 == 0], "Brand#1", "LARGE", i % 2 + 1, 900.0) for i in range(9)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    ids = [r[0] for r in rows]
    for query in (match_queries.title_jaccard_pairs, match_queries.title_ratio_pairs):
        found = query(spark, str(tmp_path))
        assert sorted((r["a_id"], r["b_id"]) for r in found.collect()) == [(a, b) for a in ids if a % 100 == 0 for b in ids if a != b]
    for query in (match_queries.title_jaccard_pairs, match_queries.title_class_jaccard, match_queries.match_score_jaccard):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("Join Inner")]
        assert "RepartitionByExpression" not in above and ("regexp_replace" not in above or query is match_queries.match_score_jaccard)


def test_lengths_of_vectors_are_worked_out_below_the_join(spark):
    from candor.plans import metric_queries

    plan = metric_queries.vector_pair_verdict(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "SQRT" not in above and "SQRT" in below
