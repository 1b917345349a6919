"""Every stage of the corpus pipeline against plain versions, on nulls, repeats, equal ids, empty tables and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN, path

import corpus_pipeline as cp
from candor.llm import bpe, decontaminate, langid, simhash, toxicity
from tests.llm.test_models import prose
from tests.llm.test_search import plain_fingerprint

#: Names that operators use for themselves, as columns of the input.
EXTRA = ["toxicity", "_toxicity", "score", "rejected", "lang_pred", "simhash", "root", "first", "stays", "_own", "_rank", "_key", "_pair", "_id", "_hash", "n_tokens", "token_ids", "decoded", "item_id", "coverage", "c0", "key", "n", "node"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *[f"{c}{i}" for c in EXTRA]) for i, t, lang in rows], SCHEMA)


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(2), str(tmp_path_factory.mktemp("tables"))
    items = [(0, prose("en", 40, "bench0")), (1, prose("de", 40, "bench1")), (2, None), (3, "")]
    rows = []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        words = prose(lang, rng.randint(30, 120), i).split()
        if i % 10 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "zork" + rng.choice(["a", "el", "ish", "um"]))
        rows.append((i, " ".join(words), lang))
    rows += [(1000, rows[31][1], "de"), (1001, rows[33][1].upper(), "en"), (1002, rows[34][1] + " x", "de")]
    rows += [(1003, "de re " + items[0][1] + " th he", "en"), (1004, prose("fr", 60, "z") + " " + items[1][1], "fr")]
    rows += [(None, prose("en", 60, "null"), "en"), (None, prose("de", 60, "null2"), None), (1005, None, None), (1006, "", "en"), (1007, "12 !!", "en")]
    rows += [(1008, prose("en", 50, "a"), "en"), (1008, prose("fr", 50, "b"), "fr"), (1009, prose("de", 50, "c"), "de"), (1009, prose("de", 50, "c"), "de"), (1010, prose("en", 30000, "long"), "en")]
    rows += [(1011, "zorkel zorkish zorka zorkum " * 3, "en"), (1011, prose("en", 70, "clean"), "en")]
    rows += [(1012, items[0][1], "en"), (1012, prose("en", 44, "other"), "en")]
    make(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(240)] + [(1, 1, 0), (None, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_toxicity_stage(spark, folder):
    docs = docs_of(spark, folder)
    kept = cp.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = toxicity.score_texts(model, toxicity.WordScores(model), [r[1] or "" for r in rows])
    assert bag(kept) == sorted((r for r, p in zip(rows, scores, strict=True) if p < 0.5), key=str)
    gone = {r[0] for r, p in zip(rows, scores, strict=True) if p >= 0.5}
    assert {10, 100, 1011} <= gone and 1011 in {r[0] for r in bag(kept)} and not {31, 1005, 1006, 1007} & gone


def test_language_stage(spark, folder):
    docs = docs_of(spark, folder)
    kept = cp.drop_unknown_language(spark, docs, folder)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in docs.collect()]
    model = langid.fit(docs)
    words = [langid.LETTERS((r[1] or "").lower()) for r in rows]
    _, _, rejected = langid.decide(model, *langid.WordLogs(model).sums(words))
    assert bag(kept) == sorted((r for r, x in zip(rows, rejected, strict=True) if not x), key=str)
    assert {1005, 1006, 1007} & {r[0] for r in bag(kept)} == set() and kept.count() > 240


def test_near_duplicate_stage(spark, folder):
    docs = docs_of(spark, folder)
    kept = cp.drop_near_duplicates(spark, docs, folder)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in docs.collect()]
    prints = [plain_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == len(set(group))
    at = {(r[0], r[1]): g for r, g in zip(rows, group, strict=True)}
    assert len({at[r[0], r[1]] for r in got}) == len(got) and set(got) <= set(rows)
    for r in got:  # the smallest doc_id of the group
        assert (r[0] is None, r[0] or 0) == min((x[0] is None, x[0] or 0) for x, g in zip(rows, group, strict=True) if g == at[r[0], r[1]])
    ids = [r[0] for r in got]
    assert ids.count(1008) == 2 and ids.count(1009) == 1 and ids.count(None) == 2 and not {1000, 1001} & set(ids)


def test_benchmark_stage(spark, folder):
    docs = docs_of(spark, folder)
    kept = cp.drop_benchmark_leaks(spark, docs, folder)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in docs.collect()]
    hashes = decontaminate.TokenHashes()
    tokens = lambda t: hashes.array(decontaminate.TOKENS((t or "").lower()))
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["text"]]
    leaks = lambda t: any(sum(x[2] for x in decontaminate.tile(tokens(t), item, 5)) >= 0.5 * len(item) for item in items)
    want = [r for r in rows if not leaks(r[1])]
    assert bag(kept) == sorted(want, key=str) and len(rows) - len(want) == 3
    assert [r[0] for r in bag(kept)].count(1012) == 1


def test_bpe_stage(spark, folder):
    docs = docs_of(spark, folder).where("doc_id is null or doc_id > 900 or doc_id < 20")
    got = cp.encode(spark, docs, folder)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]
    library = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for r in docs.collect():
        ids = np.array(library.encode_ordinary(r["text"] or ""), dtype="<u4").tobytes()
        want.append((r["doc_id"], r["lang"], r["source"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(((r[0], r[1], r[2], r[3], r[5], r[6]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_whole_pipeline_is_its_stages(spark, folder):
    docs = docs_of(spark, folder)
    for _, stage in cp.STAGES[:-1]:
        docs = make_plain(spark, stage(spark, docs, folder))
    want = cp.encode(spark, docs, folder)
    assert bag(cp.run(spark, folder)) == bag(want) and want.count() > 150


def make_plain(spark, df):
    return spark.createDataFrame([tuple(r) for r in df.collect()], df.schema)


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES])
def test_empty_tables(spark, folder, stage, tmp_path):
    docs = docs_of(spark, folder)
    assert stage(spark, docs.where("false"), folder).count() == 0
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    some = docs.where("doc_id < 30")
    assert stage(spark, some, str(tmp_path)).count() == 30


def test_pattern_is_the_library_s():
    assert bpe.PATTERN == PATTERN
