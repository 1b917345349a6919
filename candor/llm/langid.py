"""Language identification with interpolated Kneser-Ney character models.

Each language has n-gram models of orders 1 to ``order`` over the letters of
words (lower case, with word edges). The counts stand in sorted arrays of
n-gram hashes with one column per language; a lookup is a binary search. The
highest order uses counts, lower orders the number of different letters seen
before (Kneser-Ney), each discounted by ``DISCOUNT`` and interpolated with the
next lower order down to a uniform distribution.

A text goes to the language of the lowest cross-entropy per letter. Posterior
and rejection are calibrated on rows kept aside from training: a temperature
for the posterior, and for each language a limit of cross-entropy, wider for
short texts, past which a text is like no known language.

A word's log-probabilities don't depend on its neighbours, so a worker computes
them once for each different word.

The models are fitted on a bounded sample, about ``per_lang`` rows of each
language with the lowest hashes; every text is then read whole.

Defined results: null texts, and texts without letters, are ``und`` with score
0; equal cross-entropies go to the language that sorts first; without training
rows every text is ``und``; repeated rows are predicted each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.common import column, fold, slices
from candor.llm.subwords import mix, points

LETTERS = re.compile(r"[^\W\d_]+").findall
DISCOUNT = 0.75
UNIFORM = np.log(1 / 512)
#: Rows of a language that are kept aside for calibration, one of this many.
ASIDE = 5


@dataclass
class LanguageModels:
    langs: list[str]
    order: int
    grams: list[np.ndarray] = field(default_factory=list)  # per order: sorted hashes
    counts: list[np.ndarray] = field(default_factory=list)  # per order: hashes x languages
    contexts: list[np.ndarray] = field(default_factory=list)  # per order: sorted hashes
    totals: list[np.ndarray] = field(default_factory=list)  # per order: contexts x languages
    kinds: list[np.ndarray] = field(default_factory=list)  # different letters after a context
    sharpness: float = 1.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    width: float = 8.0
    least: float = 1.0  # nats per letter over the centre that no language's own texts reach


def positions(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For every predicted letter (a word's letters and its end), hashes of the 0 to ``order`` letters that end there
    (index 0: none), each within the word and its left edge, and the word of each.

    A context that would reach over the left edge stays at it, so that near the
    edge several orders see the same letters.
    """
    flat, starts = points(words)
    sizes = np.diff(starts)
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(starts[:-1], sizes)
    predicted = place > 0
    out = [np.zeros(int(predicted.sum()), dtype=np.uint64)]
    with np.errstate(over="ignore"):
        h = np.full(len(flat), 0x51ED27, dtype=np.uint64)
        for k in range(order):
            back = np.zeros(len(flat), dtype=np.uint64)
            back[k:] = flat[: len(flat) - k]
            h = np.where(place >= k, mix(h + (back + np.uint64(1)) * np.uint64(0x100000001B3)), h)
            out.append(h[predicted])
    return out, word[predicted]


def context_hashes(words: list[str], order: int) -> list[np.ndarray]:
    """For every predicted letter, hashes of the 0 to ``order - 1`` letters before it."""
    flat, starts = points(words)
    sizes = np.diff(starts)
    place = np.arange(len(flat)) - np.repeat(starts[:-1], sizes)
    predicted = place > 0
    out = []
    with np.errstate(over="ignore"):
        h = np.full(len(flat), 0x51ED27, dtype=np.uint64)
        out.append(h[predicted])
        for k in range(1, order):
            back = np.zeros(len(flat), dtype=np.uint64)
            back[k:] = flat[: len(flat) - k]
            h = np.where(place >= k, mix(h + (back + np.uint64(1)) * np.uint64(0x100000001B3)), h)
            out.append(h[predicted])
    return out


def build(rows: list[tuple[str, str, int]], order: int = 4) -> LanguageModels:
    """Models from (language, word, count)."""
    langs = sorted({r[0] for r in rows})
    model = LanguageModels(langs, order)
    if not langs:
        return model
    number = {x: i for i, x in enumerate(langs)}
    words = [r[1] for r in rows]
    lang_of = np.fromiter((number[r[0]] for r in rows), dtype=np.int64, count=len(rows))
    weight = np.fromiter((r[2] for r in rows), dtype=np.float64, count=len(rows))
    grams, word = positions(words, order)
    contexts = context_hashes(words, order)
    lang, weight = lang_of[word], weight[word]
    for n in range(1, order + 1):
        if n == order:
            g, c, l, w = grams[n], contexts[n - 1], lang, weight
        else:  # one for each different n-gram of the next order that ends in this one
            with np.errstate(over="ignore"):
                kept = np.unique(mix(grams[n + 1] + lang.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
            g, c, l, w = grams[n][kept], contexts[n - 1][kept], lang[kept], np.ones(len(kept))
        keys, at = np.unique(g, return_inverse=True)
        counts = np.bincount(at * len(langs) + l, w, len(keys) * len(langs)).reshape(-1, len(langs))
        first = np.zeros(len(keys), dtype=np.uint64)
        first[at] = c
        heads, at = np.unique(first, return_inverse=True)
        totals, kinds = np.zeros((len(heads), len(langs))), np.zeros((len(heads), len(langs)))
        np.add.at(totals, at, counts)
        np.add.at(kinds, at, counts > 0)
        for to, x in ((model.grams, keys), (model.counts, counts.astype(np.float32)), (model.contexts, heads), (model.totals, totals.astype(np.float32)), (model.kinds, kinds.astype(np.float32))):
            to.append(x)
    return model


def find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def word_logs(model: LanguageModels, words: list[str]) -> np.ndarray:
    """words x languages: log-probability of each word's letters and end."""
    if not model.langs:
        return np.zeros((len(words), 0))
    grams, word = positions(words, model.order)
    contexts = context_hashes(words, model.order)
    p = np.full((len(word), len(model.langs)), np.exp(UNIFORM))
    for n in range(1, model.order + 1):
        at, there = find(model.contexts[n - 1], contexts[n - 1])
        total, kinds = model.totals[n - 1][at] * there[:, None], model.kinds[n - 1][at]
        at, found = find(model.grams[n - 1], grams[n])
        count = model.counts[n - 1][at] * found[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total > 0, np.maximum(count - DISCOUNT, 0) / total + DISCOUNT * kinds / total * p, p)
    logs = np.log(p)
    return np.stack([np.bincount(word, logs[:, k], len(words)) for k in range(len(model.langs))], 1)


class WordLogs:
    """Log-probabilities of words by place in one array; starts afresh at a bound."""

    def __init__(self, model: LanguageModels, bound: int = 300_000):
        self.model, self.bound = model, bound
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.langs)))

    def sums(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """texts x languages: log-probabilities; and letters (with word ends) of each text."""
        flat = [w for t in texts for w in t]
        new = list({w for w in flat if w not in self.place})
        if new:
            if len(self.place) + len(new) > self.bound:
                self.clear()
                new = list(set(flat))
            parts = [self.rows] + [word_logs(self.model, new[k : k + 20_000]) for k in range(0, len(new), 20_000)]
            self.place.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate(parts)
        at = np.fromiter(map(self.place.__getitem__, flat), dtype=np.int64, count=len(flat))
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        text = np.repeat(np.arange(len(texts)), sizes)
        letters = np.bincount(text, np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)) + 1, len(texts))
        return np.stack([np.bincount(text, self.rows[at, k], len(texts)) for k in range(len(self.model.langs))], 1) if len(self.model.langs) else np.zeros((len(texts), 0)), letters


def decide(model: LanguageModels, sums: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language (-1: none), posterior, and whether the text is past the language's limit."""
    n = len(letters)
    if not model.langs:
        return np.full(n, -1), np.zeros(n), np.ones(n, dtype=bool)
    entropy = -sums / np.maximum(letters, 1)[:, None]
    best = np.argmin(entropy, 1)
    z = -entropy * model.sharpness * np.sqrt(np.maximum(letters, 1))[:, None]
    z -= z.max(1, keepdims=True)
    score = 1 / np.exp(z).sum(1)
    far = np.zeros(n, dtype=bool)
    if model.centre is not None:
        limit = model.centre[best] + np.maximum(model.width * model.spread[best], model.least) * (1 + np.sqrt(50 / np.maximum(letters, 1)))
        far = entropy[np.arange(n), best] > limit
    none = letters == 0
    return np.where(none, -1, best), np.where(none, 0.0, score), none | far


def calibrate(model: LanguageModels, rows: list[tuple[str, list[float], float]]) -> LanguageModels:
    """Set posterior and limits from kept-aside (language, log-probabilities, letters)."""
    number = {x: i for i, x in enumerate(model.langs)}
    rows = [r for r in rows if r[0] in number and r[2] > 0]
    if not rows:
        return model
    y = np.array([number[r[0]] for r in rows])
    letters = np.array([r[2] for r in rows])
    entropy = -np.array([r[1] for r in rows]).reshape(len(rows), -1) / letters[:, None]
    own = entropy[np.arange(len(y)), y]

    def loss(s: float) -> float:
        z = -entropy * s * np.sqrt(letters)[:, None]
        z -= z.max(1, keepdims=True)
        return float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))).mean())

    model.sharpness = min((0.25 * 1.5**k for k in range(14)), key=loss)
    centre, spread = np.full(len(model.langs), np.median(own)), np.full(len(model.langs), max(own.std(), 0.02))
    for k in range(len(model.langs)):
        if (y == k).sum() >= 10:
            centre[k], spread[k] = np.median(own[y == k]), max(1.4826 * np.median(np.abs(own[y == k] - np.median(own[y == k]))), 0.02)
    model.centre, model.spread = centre, spread
    return model


_LOGS: dict[str, WordLogs] = {}


def _logs(key: str, sent) -> WordLogs:
    if key not in _LOGS:
        _LOGS.clear()
        _LOGS[key] = WordLogs(sent.value)
    return _LOGS[key]


def labelled_sample(docs: DataFrame, per_lang: int, held_out: int) -> DataFrame:
    """(doc_id, text, lang, aside): about ``per_lang`` rows of each language outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != held_out)).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("count")))
    spread = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(ASIDE)) == 0
    return known.join(F.broadcast(counts.select("lang", "share")), "lang").where(spread < F.col("share")).select("doc_id", "text", "lang", aside.alias("aside"))


def fit(docs: DataFrame, per_lang: int = 1500, held_out: int = 0, order: int = 4) -> LanguageModels:
    """Train and calibrate on the bounded sample of ``docs`` (doc_id, text, lang)."""
    sample = labelled_sample(docs, per_lang, held_out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter, defaultdict

        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in slices(batches):
            for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                counts[lang].update(LETTERS(text.lower()))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    words = sample.where(~F.col("aside")).select("text", "lang").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = words.toArrow()
    model = build(sorted(zip(*(rows.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)), order)
    if not model.langs:
        return model
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sums, letters = _logs(key, sent).sums([LETTERS(t.lower()) for t in column(batch, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays([column(batch, "lang"), pa.array(list(sums), pa.list_(pa.float64())), pa.array(letters.astype(np.float64))], names=["lang", "logs", "letters"])

    found = sample.where("aside").select("text", "lang").mapInArrow(judge, "lang string, logs array<double>, letters double").collect()
    return calibrate(model, sorted((r["lang"], list(r["logs"]), r["letters"]) for r in found))


def predict(docs: DataFrame, model: LanguageModels, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred string, score double and rejected boolean (replaced if there)."""
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in made}]
    df = docs.select(*[F.col(f"`{c}`") for c in kept])
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, names = _logs(key, sent), [*sent.value.langs, "und"]
        for batch in slices(batches, text):
            sums, letters = logs.sums([LETTERS((t or "").lower()) for t in column(batch, text).to_pylist()])
            best, score, rejected = decide(sent.value, sums, letters)
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in kept] + [pa.array([names[k] for k in best.tolist()], pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=kept + [f.name for f in made])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *made]))


def language_predictions(docs: DataFrame, per_lang: int = 1500) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    found = predict(docs.select("doc_id", "text"), fit(docs, per_lang))
    return found.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
