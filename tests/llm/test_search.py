"""SimHash groups, tiling, URL rules and neighbours against brute force."""

import random

import duckdb
import numpy as np
import pytest
import xxhash

from candor.llm import collision_ann, decontaminate, simhash, urlfilter


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_groups(prints, ids):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(prints)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(len(prints))]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 60, 400]))) for _ in range(60)]
    for t in texts[:25]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), None, "", "  ", "one", "one two", "x y z " * 4000]
    docs = spark.createDataFrame([(i * 3, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, simhash string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i * 3]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    want = plain_groups(prints, [i * 3 for i in range(len(texts))])
    assert [got[i * 3]["component_id"] for i in range(len(texts))] == want and len(set(want)) < len(texts) - 5
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == set(want)
    assert simhash.near_duplicates(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("tile", [1, 8, 64, 4096])
def test_links_lose_no_component_at_any_tile_size(spark, tile):
    rng = random.Random(tile)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = list({b ^ (1 << rng.randrange(64) if k else 0) ^ (1 << rng.randrange(64) if k > 1 else 0) for b in base for k in range(4)} | {0, 2**64 - 1, 1})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "simhash long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, 2, tile=tile)).collect()}
    got, want = [roots.get(p, p) for p in signed], plain_groups(prints, signed)
    assert len({*zip(got, want)}) == len(set(want)) == len(set(got))


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "q r s t"), (2, None)], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 4
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(docs).collect()) == ["1", "2", "None"]


def plain_tiles(text, item, size):
    """Greedy tiling by trying all places."""
    used_t, used_i, tiles = [False] * len(text), [False] * len(item), []
    while True:
        best = (size - 1, 0, 0)
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while t + n < len(text) and i + n < len(item) and text[t + n] == item[i + n] and not used_t[t + n] and not used_i[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, t, i)
        n, t, i = best
        if n < size:
            return tiles
        used_t[t : t + n] = used_i[i : i + n] = [True] * n
        tiles.append((t, i, n))


def test_tiles_against_plain_search():
    rng = np.random.default_rng(6)
    for _ in range(60):
        text, item = rng.integers(0, 3, rng.integers(0, 40)).astype(np.uint64), rng.integers(0, 3, rng.integers(0, 20)).astype(np.uint64)
        assert decontaminate.tile(text, item, 3) == plain_tiles(text.tolist(), item.tolist(), 3)


def test_tiles_of_texts_that_repeat_themselves():
    """Memory is that of the texts; all pairs of seeds would be 500 million."""
    assert decontaminate.tile(np.full(1_000_000, 7, np.uint64), np.full(500, 7, np.uint64), 5) == [(0, 0, 500)]
    parts = decontaminate.tile(np.full(1000, 7, np.uint64), np.array([7] * 9 + [8] + [7] * 6, np.uint64), 5)
    assert parts == [(0, 0, 9), (9, 10, 6)]


def test_leaks(spark):
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    item, other = prose(40), prose(30)
    moved = item[20:] + prose(3) + item[:20]
    rows = [(1, " ".join(prose(50) + item + prose(50))), (2, " ".join(prose(30) + moved)), (3, " ".join(prose(300))), (4, None), (5, ""), (6, " ".join(item[:12] + prose(50))), (7, ", ".join(item).upper()), (8, " ".join(prose(20000) + other)), (8, "clean words"), (9, " ".join(item + item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(other)), (12, None), (13, "too short"), (10, " ".join(item))], "item_id long, text string")
    for block in (1 << 20, 100):
        got = {(r["doc_id"], r["item_id"]): r["tiles"] for r in decontaminate.leaks(docs, bench, block_bytes=block).collect()}
        assert set(got) == {(1, 10), (2, 10), (7, 10), (8, 11), (9, 10)} and got[2, 10] == 2
    kept = sorted((r["doc_id"], r["text"] is None) for r in decontaminate.without_leaks(docs, bench).collect())
    assert [k for k, _ in kept] == [3, 4, 5, 6, 8]
    named = docs.selectExpr("*", "'x' as item_id", "'y' as coverage", "1 as tiles", "2 as _id", "3 as _hash")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(named, bench).collect()} == set(got)
    assert decontaminate.without_leaks(named, bench).columns == named.columns and decontaminate.without_leaks(named, bench).count() == 5
    assert decontaminate.leaks(docs, bench.where("item_id < 0")).count() == 0 and decontaminate.leaks(docs.where("doc_id < 0"), bench).count() == 0


URLS = [
    "http://a.example.org/es/1", "HTTPS://Example.ORG/en/12?q=://", "https://example.org/en/2", "https://x.com/fr/", "https://x.com/de/a#b", "https://notcom/de/", "https://com/de/", None, "no scheme", "://", "http://", "http://x.net",
    "https://x.com/de/a#b", "ftp://sub.sub.example.org/es/", "http://examplexorg/es/", "http://x.com?/de/", "http://é.com/de/ü",
]


def test_url_rules_against_sql(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [[i, u] for i, u in enumerate(URLS)])
    want = sorted(con.execute(urlfilter.ORACLE).fetchall())
    for limit in (16 << 20, 0):
        got = urlfilter.judge(pages, urlfilter.rule_table(spark, urlfilter.RULES), broadcast_bytes=limit)
        assert sorted(map(tuple, got.collect())) == want
    none = urlfilter.judge(pages, urlfilter.rule_table(spark, urlfilter.RULES).where("verdict = 'x'")).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")} and len(none) == len(URLS)


def test_long_urls_repeats_and_no_pages(spark):
    deep = "a." * 3000 + "example.org"
    rows = [(1, f"http://{deep}/es/{'x' * 50000}"), (2, f"http://{deep}/en/2"), (2, f"http://{deep}/en/2"), (3, "http://example.org/" + "es/" * 20000)]
    pages = spark.createDataFrame([(*r, "r", "v") for r in rows], "page_id long, url string, rule string, verdict string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, urlfilter.rule_table(spark, urlfilter.RULES)).collect())
    assert got == [(1, "example.org/es/", "block"), (2, "org/", "allow"), (2, "org/", "allow"), (3, "example.org/es/", "block")]
    assert urlfilter.judge(pages.where("page_id < 0"), urlfilter.rule_table(spark, urlfilter.RULES)).count() == 0


def test_filter_has_no_false_negatives(spark):
    from pyspark.sql import functions as F

    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    words, blocks = urlfilter.bloom(keys, "key", 2000)
    probe = lambda df: df.withColumn("block", urlfilter.block_of(F.col("key"), blocks)).join(words, "block").where(F.col("word").bitwiseAND(urlfilter.mask_of(F.col("key"))) == urlfilter.mask_of(F.col("key"))).count()
    assert probe(keys) == 2000
    assert probe(spark.range(2000, 12000).select(F.concat(F.lit("k"), "id").alias("key"))) < 2000


@pytest.mark.parametrize("n, block", [(500, 1000), (3000, 1000)])
def test_neighbours(spark, n, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, x[0].tolist()), (n + 1, None), (n + 2, [0.0] * 16), (n + 3, [float("nan")] * 16), (n + 4, [None] * 16), (n + 5, [1.0] * 4), (100, x[100].tolist())]
    rows = [(*r, "q", "b", 1, 2.0, "v") for r in rows]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query string, block string, rank int, score double, vector string")
    q = v.where("vec_id % 100 = 0")
    got = [tuple(r)[:4] for r in collision_ann.nearest(v, q, block=block).collect()]
    want = collision_ann.brute_force(v, q)
    found = {(a, c) for a, _, c, _ in got}
    assert sum((a, c) in found for a, _, c, _ in want) / len(want) >= 0.9
    # The copy under another id, and the row that repeats in whole, are neighbours; the own row is none.
    assert (0, 1, n, 0.0) in got and (100, 1, 100, 0.0) in got and sum(r[0] == r[2] for r in got) == 1 and max(r[1] for r in got) == 10
    few = collision_ann.nearest(v.where("vec_id < 4"), v.where("vec_id = 0")).collect()
    assert [r["rank"] for r in sorted(few)] == [1, 2, 3]
    assert collision_ann.nearest(v.where("vec_id < 0"), q.where("vec_id < 0")).count() == 0


def test_neighbours_of_huge_components_and_shared_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    rows += [(300, [3e38] * 8), (301, [-3e38] * 8), (400, [1e307] * 8), (401, [-1e307, *[1e307] * 7]), (500, [1e-300] * 8), (100, [0.5] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 100 = 0")
    got = collision_ann.nearest(v, q, block=100).collect()
    want = collision_ann.brute_force(v, q)
    assert len(got) == len(want) == 70  # two rows of id 100 ask
    assert sum(r in [tuple(g)[:4] for g in got] for r in want) / len(want) >= 0.9
    assert len({r["vector"] for r in got if r["query_id"] == 100}) == 2
    # With few candidates each row of id 100 finds the other, and not itself.
    few = collision_ann.nearest(v.where("vec_id in (100, 7)"), q.where("vec_id = 100")).collect()
    assert sorted((r["vec_id"], r["score"] > 0) for r in few) == [(7, True), (7, True), (100, True), (100, True)]
    far = sorted(tuple(r)[:4] for r in got if r["query_id"] == 400)
    assert far[0][2:] == (401, pytest.approx(2e307)) and far[-1][3] == pytest.approx(8**0.5 * 1e307)


def test_components_that_have_not_settled_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 13)}
    with pytest.raises(RuntimeError):
        simhash.components(edges, rounds=1)
