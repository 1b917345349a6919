"""Toxicity, language ID and context mixing: held-out accuracy, exact counts, edge cases."""

import math
import random
import zlib

import numpy as np
import pytest

from candor.llm import langid, mixing, toxicity

LETTERS = {"en": "th he in er an re nd st".split(), "de": "sch ei ch ung ß en ge ü".split(), "fr": "é ou eau aux è tre oi qu".split()}


def prose(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(lang, 5 + 7 * (i % 20), i), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 70)]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "123 !!", "de", "s"), (903, "ei sch ung " * 3000, None, "s"), (None, "th he in", "en", "s"), (3, rows[3][1], "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").cache()


def test_language(docs, spark):
    got = langid.language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    by = {r["doc_id"]: r for r in got}
    for i in (900, 901, 902):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0.0
    assert by[903]["lang_pred"] == "de" and not by[903]["rejected"]
    held = [r for r in got if r["held_out"] and r["lang"] and r["doc_id"] < 900]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "xqzw jkvw " * 40), (2, prose("de", 60, "new"))], "doc_id long, text string")
    assert [r["rejected"] for r in langid.predict(odd, model).orderBy("doc_id").collect()] == [True, False]
    empty = docs.where("doc_id < 0")
    assert langid.language_predictions(empty).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}


def test_kneser_ney_prefers_what_it_saw():
    rows = [("en", "the", 3), ("en", "then", 1), ("en", "he", 2), ("de", "ein", 2)]
    model = langid.build(rows)
    en = model.langs.index("en")
    known = np.exp(langid.word_logs(model, ["the", "then", "he", "ein", "th"]))
    assert known[0, en] > 0.3 > known[1, en] > known[4, en] and known[:3, en].sum() < 1
    assert known[3, model.langs.index("de")] > 0.3 > 1e-3 > known[3, en]


def test_toxicity(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        words = prose("en", rng.randint(20, 200), i).split()
        if i % 3 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), "zork" + rng.choice(["a", "el", "ish", "um"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(900, None), (901, ""), (902, "?!"), (903, "th he in " * 20000 + "zorkox zorkel"), (904, "th he in " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(17, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, lab).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 3 == 0) for i in held) / len(held) > 0.95
    assert [got[i]["predicted"] for i in (900, 901, 902, 903, 904)] == [0, 0, 0, 1, 0]
    none = toxicity.toxicity_scores(docs, lab.where("toxic = 0")).where("predicted = 1")
    assert none.count() == 0 and toxicity.toxicity_scores(docs.where("doc_id < 0"), lab).count() == 0


def test_repetition_is_not_toxicity():
    scores, starts = np.array([9.0] * 8 + [1.0]), np.array([0, 9])
    assert toxicity.without_repeats(scores, toxicity.fresh(scores, starts, 8), -1.0).sum() == 9.0 - 7.0 + 1.0


def test_worst_window_does_not_depend_on_clean_words_before():
    for lead in range(9):
        scores = np.array([0.0] * lead + [4.0] + [0.0] * 6 + [4.0] + [0.0] * 20)
        means, text = toxicity.window_means(scores, np.array([0, len(scores), len(scores) + 0]), 8, -1.0)
        assert means.max() == 1.0 and set(text) == {0}
    short, _ = toxicity.window_means(np.array([4.0, 4.0]), np.array([0, 2]), 8, -1.0)
    assert short.tolist() == [(8.0 - 6.0) / 8]


def test_toxicity_of_repeats_and_clashing_columns(spark):
    rng = random.Random(3)
    rows = [(i, prose("en", 40, i) + (" zorka zorkel zorkish" if i % 2 else ""), 0.0, "x", 1) for i in range(80)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, score double, predicted string, toxic int")
    lab = spark.createDataFrame([(i, i % 2, "t") for i in range(80)], "doc_id long, toxic int, text string")
    got = sorted((r["doc_id"], r["predicted"], r["score"]) for r in toxicity.toxicity_scores(docs, lab).collect())
    assert len(got) == 85 and len({(i, p, round(x, 9)) for i, p, x in got}) == 80 and sum(p == i % 2 for i, p, _ in got) / 85 > 0.9


def test_toxicity_against_a_plain_forward_pass():
    """Every window of every text, word by word and gram by gram."""
    rng = np.random.default_rng(4)
    model = toxicity.SubwordModel(rng.normal(size=1 << 12).astype(np.float32), 0.3, (3, 4), 4, usual=-0.2, scale=1.7, shift=-0.4)
    texts = ["the cat the cat sat on a mat", "word", "", "one two three four five six seven " * 5, "ÄÖ ü ß x", "a a a a a a a b"]

    def word_score(w):
        row, _ = toxicity.buckets([w], model.sizes, len(model.row_score))
        return float(np.mean([float(model.row_score[r]) for r in row]))

    want = []
    for t in texts:
        words = toxicity.WORDS(t.lower())
        if not words:
            want.append(1 / (1 + math.exp(8)))
            continue
        scores = []
        for k, w in enumerate(words):
            x = word_score(w)
            scores.append(min(x, model.usual) if w in words[max(0, k - model.window + 1) : k] else x)
        tops = []
        for k in range(max(1, len(words) - model.window + 1)):
            part = scores[k : k + model.window]
            tops.append((sum(part) + model.usual * (model.window - len(part))) / model.window)
        want.append(1 / (1 + math.exp(-(model.scale * (max(tops) + model.bias) + model.shift))))
    assert toxicity.score_texts(model, toxicity.WordScores(model), texts).tolist() == pytest.approx(want, rel=1e-5)


def plain_kneser_ney(rows, lang, order):
    """Interpolated Kneser-Ney from dictionaries: log-probability of a word's letters and end."""
    words = [("^" * (order - 1) + w + "$", n) for x, w, n in rows if x == lang]
    full, below = {}, [set() for _ in range(order)]
    for w, n in words:
        for k in range(order - 1, len(w)):
            g = w[k - order + 1 : k + 1]
            full[g] = full.get(g, 0) + n
            for m in range(1, order):
                below[m].add(w[k - m : k + 1])
    counts = {order: full}
    for m in range(order - 1, 0, -1):
        counts[m] = {}
        for g in below[m]:
            counts[m][g[1:]] = counts[m].get(g[1:], 0) + 1

    def p(context, c, m):
        if m == 0:
            return math.exp(langid.UNIFORM)
        context = context[len(context) - m + 1 :] if m > 1 else ""
        follow = {g: n for g, n in counts[m].items() if g[:-1] == context}
        lower = p(context[1:], c, m - 1)
        total = sum(follow.values())
        if not total:
            return lower
        return max(follow.get(context + c, 0) - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(follow) / total * lower

    def of_word(w):
        w = "^" * (order - 1) + w + "$"
        return sum(math.log(p(w[k - order + 1 : k], w[k], order)) for k in range(order - 1, len(w)))

    return of_word


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_kneser_ney_against_dictionaries(order):
    rows = [("en", w, n) for w, n in (("the", 9), ("then", 2), ("he", 4), ("a", 7), ("anna", 1), ("hat", 3))] + [("de", w, n) for w, n in (("ein", 5), ("eine", 2), ("heute", 1), ("ei", 1))]
    model = langid.build(rows, order)
    words = ["the", "hen", "eine", "anna", "zz", "a", "heat", "teneth"]
    got = langid.word_logs(model, words)
    for k, lang in enumerate(model.langs):
        plain = plain_kneser_ney(rows, lang, order)
        assert got[:, k].tolist() == pytest.approx([plain(w) for w in words], rel=1e-6)


def stems(text):
    return (text or "").encode().lower().split()


def is_train(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 1


def plain_mixing(rows, common, least, stride, rate):
    """Scores by dictionaries and bit by bit: pairs of words counted as words, without the text's own counts."""
    counts, train = {}, [is_train(i) for i, _ in rows]
    for (_, t), learned in zip(rows, train, strict=True):
        for w in stems(t) if learned else []:
            counts[w] = counts.get(w, 0) + 1
    top = [(w, n) for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n >= least and len(w) <= mixing.LONGEST][:common]
    rest = {w: n for w, n in counts.items() if w not in dict(top)}
    letters = np.zeros(257, dtype=np.int64)
    for w, n in rest.items():
        for b in w:
            letters[b] += n
    letters[256] = sum(rest.values())
    voc = mixing.vocabulary(top, sum(train), int(letters[256]), letters)
    number = {w: i for i, w in enumerate(voc.listed.to_pylist()) if w is not None}
    path = lambda code_at, s: [(int(v) >> 1, int(v) & 1) for v in voc.path[voc.first[code_at + s] : voc.first[code_at + s] + voc.size[code_at + s]]]
    n_words = len(voc.counts)

    def node_counts(by_symbol, at, total):
        met, one = {}, {}
        for s, n in by_symbol.items():
            for v, bit in path(at, s):
                met[v], one[v] = met.get(v, 0) + n, one.get(v, 0) + n * bit
        return met, one

    def dense(by_symbol, at, base):
        """x of a 1 at a node, by counts with the base as prior."""
        met, one = node_counts(by_symbol, at, 0)
        m0, o0 = node_counts(dict(enumerate(base)), at, 0)

        def x(v):
            plain = math.log((o0.get(v, 0) + mixing.PART) / (m0.get(v, 0) - o0.get(v, 0) + mixing.PART))
            if by_symbol:
                sure = 1 / (1 + math.exp(-plain))
                plain = math.log((one.get(v, 0) + mixing.PRIOR * sure) / (met.get(v, 0) - one.get(v, 0) + mixing.PRIOR * (1 - sure)))
            return max(-127, min(127, round(plain * mixing.STEPS))) / mixing.STEPS

        return x

    coded, pairs, own, by_short, by_far, by_all = [], {}, [], {}, {}, {}
    for (_, t), learned in zip(rows, train, strict=True):
        words = [*stems(t), None]
        symbols = [voc.end if w is None else number.get(w, voc.escape) for w in words]
        context = [(*([b"^"] if k < 2 else [words[k - 2]]), *([b"^"] if k < 1 else [words[k - 1]])) for k in range(len(words))]
        short, last = [], mixing.SHORTS - 1
        for s in symbols:
            short.append(last)
            last = int(voc.shorts[s]) if voc.shorts[s] >= 0 else last
        spelled = {}
        for w, s in zip(words, symbols, strict=True):
            if s == voc.escape:
                one = mixing.Slice(np.array([s], np.int32), np.array([1]), [w], np.array([0], np.int32), np.array([True]))
                b, _, far, all_ = one.spelled(voc)
                spelled[w] = list(zip(b.tolist(), far.tolist(), all_.tolist(), strict=True))
        mine = {}
        for w, s, c, h in zip(words, symbols, context, short, strict=True):
            mine.setdefault(c, {})[s] = mine.get(c, {}).get(s, 0) + 1
            if learned:
                pairs.setdefault(c, {})[s] = pairs.get(c, {}).get(s, 0) + 1
                by_short.setdefault(h, {})[s] = by_short.get(h, {}).get(s, 0) + 1
                for b, far, all_ in spelled.get(w, []):
                    by_far.setdefault(far, {})[b] = by_far.get(far, {}).get(b, 0) + 1
                    by_all.setdefault(all_, {})[b] = by_all.get(all_, {}).get(b, 0) + 1
        own.append(mine if learned else {})
        coded.append((words, symbols, context, short, spelled))
    base_bytes = np.zeros(257, dtype=np.int64)
    base_bytes[voc.of_byte] = letters
    short_x = {h: dense(c, 0, voc.counts.tolist()) for h, c in by_short.items()}
    far_x, all_x = ({k: dense(c, n_words, base_bytes.tolist()) for k, c in table.items()} for table in (by_far, by_all))
    none_word, none_byte = dense({}, 0, voc.counts.tolist()), dense({}, n_words, base_bytes.tolist())
    out = []
    for (words, symbols, context, short, spelled), mine in zip(coded, own, strict=True):
        w, squares, total = mixing.first_weights().astype(float), np.full((mixing.GATES, 2), mixing.CALM), 0.0
        right = []
        for at in range(0, len(words), stride):
            slope = np.zeros_like(w)
            for k in range(at, min(len(words), at + stride)):
                seen = pairs.get(context[k], {})
                big = sum(seen.values()) >= mixing.FULL
                less = {} if big else mine.get(context[k], {})
                seen = {s: n - less.get(s, 0) for s, n in seen.items()}
                route = path(0, symbols[k])
                through = [sum(n for s, n in seen.items() if path(0, s)[:d] == route[:d]) for d in range(len(route) + 1)]
                if big:
                    whole = through[0]
                    through = [min(mixing.FULL, math.ceil(n * mixing.FULL / whole - 1e-9)) for n in through]
                level = sum(through[0] >= x for x in (1, 2, 4, 32))
                right.append(through[-1] > 0)
                run = 0 if k == 0 or not right[k - 1] else 1 if k == 1 or not right[k - 2] else 2
                gate = level * mixing.RUNS + run if level else 0
                table = short_x.get(short[k], none_word)
                inputs = [(gate, table(v) * (2 * bit - 1), math.log((n + mixing.PART) / (m - n + mixing.PART)) if m else 0.0) for (v, bit), m, n in zip(route, through, through[1:], strict=False)]
                for j, (b, far, all_) in enumerate(spelled.get(words[k], [])):
                    f, a = far_x.get(far, none_byte), all_x.get(all_, none_byte)
                    inputs += [(mixing.LEVELS * mixing.RUNS + (j > 0), f(v) * (2 * bit - 1), a(v) * (2 * bit - 1)) for v, bit in path(n_words, b)]
                for g, x0, x1 in inputs:
                    p = 1 / (1 + math.exp(-max(-14, min(14, w[g] @ (x0, x1)))))
                    total += math.log10(p)
                    slope[g] += (1 - p) * np.array([x0, x1])
            squares += slope**2
            w += rate * slope / np.sqrt(squares)
        out.append(total)
    return out


@pytest.mark.parametrize("common, slice_bytes, bucket", [(60, 1 << 20, 1 << 20), (60, 600, 300), (5, 5000, 2000)])
def test_mixing_bit_by_bit(spark, common, slice_bytes, bucket):
    rows = [(i, prose(lang, 10 + 3 * (i % 7), i % 17)) for i, lang in enumerate(["en", "de"] * 18)]
    rows += [(50, "of the " * 400), (51, "of the " * 30), (52, rows[3][1]), (53, rows[3][1]), (54, "x " + rows[5][1] + " y"), (None, rows[2][1]), (55, None), (56, ""), (3, rows[3][1]), (57, "Ä ÖÜ\t é\r\n\x0b x" + "y" * 90)]
    docs = spark.createDataFrame([(*r, "t", 1.0) for r in rows], "doc_id long, text string, train string, score double")
    got = mixing.mixing_scores(docs, common=common, slice_bytes=slice_bytes, bucket=bucket, stride=4).collect()
    want = plain_mixing(rows, common, mixing.LEAST, 4, mixing.RATE)
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 2)) for r in got) == sorted((str(i), len(stems(t)) + 1, pytest.approx(x, rel=2e-3, abs=0.02)) for (i, t), x in zip(rows, want, strict=True))


@pytest.mark.parametrize("more", [0, 30, 100000])
def test_mixing_counts_and_base(docs, spark, more):
    got = mixing.mixing_scores(docs, common=5, more=more).collect()
    rows = docs.select("doc_id", "text").collect()
    train = [r for r in rows if is_train(r["doc_id"])]
    counts = {}
    for r in train:
        for w in stems(r["text"]):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    log = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((str(r["doc_id"]), len(stems(r["text"])) + 1, 1 + sum(w in counts for w in stems(r["text"])), round(sum(log(counts.get(w, 0)) for w in stems(r["text"])) + log(len(train)), 6)) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_copies_stand_out(spark):
    """A text with a copy among the training texts costs far fewer bits a byte than others, whether it was learned from or not."""
    rows = [(i, prose("en", 120, i)) for i in range(200)] + [(1000 + i, prose("en", 120, i)) for i in range(0, 200, 4)]
    got = {r["doc_id"]: r["bits_per_byte"] for r in mixing.mixing_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = [i for i in range(0, 200, 4) if is_train(1000 + i)]
    once = [i for i in range(200) if i % 4]
    assert max(got[i] for i in twice) < 0.8 * min(got[i] for i in once)


def test_codes_are_distributions():
    """All paths of a code have probabilities that sum to 1, as their lengths do, and branches of a node that sum to 1."""
    rng = np.random.default_rng(0)
    for counts in (rng.integers(0, 1000, 300), np.array([5, 0]), 2 ** np.arange(40)):
        code = mixing.Code(np.sort(mixing.code_sizes(counts)))
        assert sum(2.0 ** -int(s) for s in code.size) == pytest.approx(1.0)
        assert (code.high[code.node] > code.low[code.node]).all() and ((code.middle > code.low) & (code.middle < code.high)).all()
        paths = [tuple(code.bit[a : a + n]) for a, n in zip(code.first, code.size, strict=True)]
        assert len(set(paths)) == len(counts) and paths == sorted(paths)
    on = mixing.LOOK.reshape(mixing.FULL + 1, -1)
    for all_ in (1, 2, 9, 254):
        for n in range(all_ + 1):
            assert on[all_, n] == pytest.approx(-on[all_, all_ - n], abs=1e-5)


def test_path_counts_against_plain_counting():
    rng = np.random.default_rng(1)
    code = mixing.Code(np.sort(mixing.code_sizes(rng.integers(0, 50, 40))))
    group, symbols = np.sort(rng.integers(0, 12, 200)), rng.integers(0, 40, 200)
    order = np.lexsort((symbols, group))
    group, symbols, counts = group[order], symbols[order], rng.integers(0, 5, 200)
    got, begin = mixing.path_counts(code, group, symbols, counts)
    path = lambda s: code.bit[code.first[s] : code.first[s] + code.size[s]].tolist()
    for k in range(200):
        for d in range(code.size[symbols[k]] + 1):
            assert got[begin[k] + d] == sum(c for g, s, c in zip(group, symbols, counts, strict=True) if g == group[k] and path(s)[:d] == path(symbols[k])[:d])


def test_words_of_slices():
    import pyarrow as pa

    texts = [None, "", " a\x1cb\tC\x0bd\x0c e\r\n ", " x  y", "  ", "É A\x85b\x1f", "w " * 50] * 3
    whole = pa.array(texts)
    for start in range(len(texts)):
        for n in (1, 2, 9):
            flat, sizes = mixing.words_of(whole.slice(start, n))
            want = [stems(t) for t in texts[start : start + n]]
            assert sizes.tolist() == [len(w) for w in want] and mixing.byte_list(flat) == [x for w in want for x in w]


def test_mixing_without_training(spark):
    one = next(i for i in range(100) if not is_train(i))
    docs = spark.createDataFrame([(one, "th he"), (one, None)], "doc_id long, text string")
    got = sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in mixing.mixing_scores(docs).collect())
    assert got == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert mixing.mixing_scores(docs.where("doc_id < 0")).count() == 0
