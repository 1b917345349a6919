"""Toxicity from subword bags: a linear softmax over averaged n-gram embeddings.

A word is the bag of itself and its character n-grams (with edges), each hashed
to a row of an embedding matrix; a window of words is the mean of its words'
means (what a short text lacks counts as usual words, and a word that stood
within the last window's length as a usual word at most: repetition isn't
toxicity); a linear softmax over the window gives the classes. Matrix and softmax
are trained jointly by Adagrad in numpy. As unseen misspellings and endings
share n-grams with seen words, they share their vectors.

A long text says little on the average of all its words, so a text is judged by
its worst window of ``window`` words (all windows are read): in training, after
first passes on the whole of the shorter texts, only the window that scores
highest carries the text's label. A fifth of the sample is kept from training
and calibrates the scores.

Since the softmax is linear, the score of a word is one number, which a worker
computes once and keeps.

Labels are learned from a bounded sample: at most about ``per_class`` labelled
rows of each class, those with the lowest hashes; nothing else is bounded.

Defined results: null and empty texts, and texts without words, have the score
of an empty window (the bias alone, never over the threshold); rows that repeat
are scored each; a row with several labels learns from each; without labels of
both classes every score is 0 (to 12 places).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.common import column, fold, slices, strings
from candor.llm.subwords import ngrams, points

WORDS = re.compile(r"[^\W_]+").findall


@dataclass
class SubwordModel:
    """``row_score``: what a row of the matrix adds to the log-odds; ``bias``; log-odds are ``scale`` * x + ``shift``; ``usual``: the mean score of a word."""

    row_score: np.ndarray
    bias: float
    sizes: tuple[int, ...]
    window: int
    scale: float = 1.0
    shift: float = 0.0
    usual: float = 0.0


def buckets(words: list[str], sizes: tuple[int, ...], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the matrix for each word (the word itself among them) and the word of each."""
    flat, starts = points(words)
    parts = [ngrams(flat, starts, n) for n in sizes]
    whole = np.add.reduceat((flat + np.uint64(7)) * ngram_weights(starts), starts[:-1]) if len(words) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        from candor.llm.subwords import mix

        parts.append((mix(whole), np.arange(len(words))))
    h = np.concatenate([p[0] for p in parts])
    word = np.concatenate([p[1] for p in parts])
    order = np.argsort(word, kind="stable")
    return (h[order] % np.uint64(rows)).astype(np.int64), word[order]


def ngram_weights(starts: np.ndarray) -> np.ndarray:
    """A weight for each place in its word, for a hash of the whole word."""
    sizes = np.diff(starts)
    place = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes)
    from candor.llm.subwords import mix

    with np.errstate(over="ignore"):
        return mix(place.astype(np.uint64) + np.uint64(11)) | np.uint64(1)


def fresh(values: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """False where the same value stands within the last ``window`` places of its stretch."""
    order = np.argsort(values, kind="stable")
    stretch = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    a, b = order[:-1], order[1:]
    again = (values[a] == values[b]) & (b - a <= window) & (stretch[a] == stretch[b])
    out = np.ones(len(values), dtype=bool)
    out[b[again]] = False
    return out


def without_repeats(scores: np.ndarray, first: np.ndarray, usual: float) -> np.ndarray:
    """A repeated word can't say more than a usual word."""
    return np.where(first, scores, np.minimum(scores, usual))


def window_means(scores: np.ndarray, starts: np.ndarray, window: int, usual: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each window of ``window`` values (from each place on, filled up with usual ones) of every stretch, and its stretch."""
    sizes = np.diff(starts)
    count = np.where(sizes > window, sizes - window + 1, (sizes > 0).astype(np.int64))
    text = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = starts[:-1][text] + k
    end = begin + np.minimum(window, sizes[text])
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    return (total[end] - total[begin] + usual * (window - (end - begin))) / window, text


def train(texts: list[str], labels: np.ndarray, sizes: tuple[int, ...] = (3, 4, 5), rows: int = 1 << 18, dim: int = 8, window: int = 8, first: int = 2, epochs: int = 12, rate: float = 0.2, decay: float = 1e-3, seed: int = 7) -> SubwordModel:
    """Fit on texts with labels 0 and 1: ``first`` passes over shorter texts, then ``epochs`` over the highest windows."""
    rng = np.random.default_rng(seed)
    known: dict[str, int] = {}
    ids = [np.fromiter((known.setdefault(w, len(known)) for w in WORDS(t.lower())), dtype=np.int64) for t in texts]
    keep = [i for i, x in enumerate(ids) if len(x)]
    ids, labels = [ids[i] for i in keep], labels[keep].astype(np.float64)
    aside = np.zeros(len(ids), dtype=bool)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(labels == c))
        aside[own[: len(own) // 5]] = True
    if not len(labels) or labels.min() == labels.max():
        return SubwordModel(np.zeros(rows, np.float32), 0.0, sizes, window, shift=-30.0)
    row, word = buckets(list(known), sizes, rows)
    begins = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(known)))])
    matrix = (rng.uniform(-0.1, 0.1, (rows, dim)) / dim).astype(np.float32)
    head, bias = rng.normal(0, 0.5, (2, dim)).astype(np.float32), np.zeros(2)
    seen, seen_head = np.full(rows, 1e-6, np.float32), 1e-6
    lengths = np.array([len(x) for x in ids])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat_words = np.concatenate(ids)
    counts = fresh(flat_words, starts, window)

    def tops() -> tuple[np.ndarray, np.ndarray]:
        """The highest window of each text: its mean score and its first word."""
        scores = np.add.reduceat((matrix @ (head[1] - head[0]))[row], begins[:-1]) / np.diff(begins)
        usual = min(0.0, float(scores[flat_words].mean()))
        means, text = window_means(without_repeats(scores[flat_words], counts, usual), starts, window, usual)
        order = np.lexsort((-means, text))
        best = order[np.unique(text[order], return_index=True)[1]]
        return means[best], best - np.searchsorted(text, text[best])

    short = np.flatnonzero(~aside & (lengths <= max(256, np.quantile(lengths, 0.4))))
    if len(np.unique(labels[short])) < 2:
        short = np.flatnonzero(~aside)
    training = np.flatnonzero(~aside)
    for epoch in range(first + epochs):
        if epoch < first:
            spans = [(i, 0, lengths[i]) for i in short.tolist()]
        else:
            begin = tops()[1]
            spans = [(i, begin[i], begin[i] + min(window, lengths[i])) for i in training.tolist()]
            for _ in range(2):
                other = rng.integers(0, np.maximum(lengths - window, 0) + 1)
                spans += [(i, other[i], other[i] + min(window, lengths[i])) for i in training.tolist() if not labels[i]]
        step = rate * (1 - 0.9 * epoch / (first + epochs))
        for batch in np.array_split(rng.permutation(len(spans)), max(1, len(spans) // 64)):
            bags = [ids[i][a:b][counts[starts[i] + a : starts[i] + b]] for i, a, b in (spans[j] for j in batch)]
            used, flat = np.unique(np.concatenate(bags), return_inverse=True)
            in_bag = np.array([len(b) for b in bags])
            bag, size = np.repeat(np.arange(len(bags)), in_bag), np.maximum(in_bag, window)
            n_rows = begins[used + 1] - begins[used]
            ends = np.cumsum(n_rows)
            r = row[np.arange(ends[-1]) + np.repeat(begins[used] - ends + n_rows, n_rows)]
            vectors = np.add.reduceat(matrix[r], ends - n_rows) / n_rows[:, None].astype(np.float32)
            hidden = np.stack([np.bincount(bag, vectors[flat, d], len(bags)) for d in range(dim)], 1) / size[:, None]
            z = hidden @ head.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[[spans[j][0] for j in batch]]
            error = p - np.stack([1 - y, y], 1)
            down = (error @ head / size[:, None]).astype(np.float32)
            g_word = np.stack([np.bincount(flat, down[bag, d], len(used)) for d in range(dim)], 1)
            g_row = np.repeat((g_word / n_rows[:, None]).astype(np.float32), n_rows, 0)
            touched, place = np.unique(r, return_inverse=True)
            total = np.stack([np.bincount(place, g_row[:, d], len(touched)) for d in range(dim)], 1) + decay * matrix[touched]
            seen[touched] += (total**2).mean(1)
            matrix[touched] -= (step * total / np.sqrt(seen[touched])[:, None]).astype(np.float32)
            g_head = error.T @ hidden + decay * head
            seen_head += float((g_head**2).mean())
            head -= (step * g_head / np.sqrt(seen_head)).astype(np.float32)
            bias -= 0.02 * step * error.mean(0)
    model = SubwordModel((matrix @ (head[1] - head[0])).astype(np.float32), float(bias[1] - bias[0]), sizes, window)
    scores = np.add.reduceat(model.row_score[row], begins[:-1]) / np.diff(begins)
    model.usual = min(0.0, float(scores[flat_words].mean()))
    held = aside if len(np.unique(labels[aside])) == 2 else ~aside
    return calibrated(model, tops()[0][held] + model.bias, labels[held])


def calibrated(model: SubwordModel, x: np.ndarray, y: np.ndarray) -> SubwordModel:
    """Fit scale and shift so that the log-odds of the highest window say how likely label 1 is."""
    a, b = 1.0 / max(x.std(), 1e-6), 0.0
    b = -a * (np.median(x[y == 1]) + np.median(x[y == 0])) / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 1e-2 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
    if not (np.isfinite(a) and np.isfinite(b)) or a <= 0:
        a, b = 1.0, 0.0
    model.scale, model.shift = float(a), float(b)
    return model


class WordScores(dict):
    """Scores of words, computed many at a time and kept up to a bound."""

    def __init__(self, model: SubwordModel, bound: int = 400_000):
        self.model, self.bound = model, bound

    def of(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self})
        if new:
            if len(self) + len(new) > self.bound:
                self.clear()
                new = list(set(words))
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                row, word = buckets(part, self.model.sizes, len(self.model.row_score))
                self.update(zip(part, (np.bincount(word, self.model.row_score[row], len(part)) / np.bincount(word, minlength=len(part))).tolist(), strict=True))
        return np.fromiter(map(self.__getitem__, words), dtype=np.float64, count=len(words))


def score_texts(model: SubwordModel, scores: WordScores, texts: list[str]) -> np.ndarray:
    """Probability of label 1 for each text."""
    words = [WORDS(t.lower()) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    flat = scores.of([w for x in words for w in x])
    means, text = window_means(without_repeats(flat, fresh(flat, starts, model.window), model.usual), starts, model.window, model.usual)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, text, means)
    z = np.where(np.isfinite(top), model.scale * (top + model.bias) + model.shift, -8.0)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = 1500, held_out: int = 0) -> DataFrame:
    """(doc_id, text, toxic) of about ``per_class`` rows of each class outside the held-out fold, by lowest hash.
    So few label rows can be broadcast, and the texts stay where they are."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id") != held_out)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rank = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    share = F.lit(0.0)
    for c in (0, 1):
        share = F.when(F.col("toxic") == c, min(1.0, per_class / max(1, counts.get(c, 0)))).otherwise(share)
    return docs.select("doc_id", "text").join(F.broadcast(known.where(rank < share)), "doc_id").select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, held_out: int = 0, **options) -> SubwordModel:
    """Train on the bounded sample; the rows come to the driver in order of doc_id, so the model is the same for any partitioning."""
    rows = sorted(labelled_sample(docs, labels, per_class, held_out).collect(), key=lambda r: (r["doc_id"], r["toxic"], r["text"] or ""))
    return train([r["text"] or "" for r in rows], np.array([r["toxic"] for r in rows], dtype=np.int64), **options)


_SCORES: dict[str, WordScores] = {}


def score_documents(docs: DataFrame, model: SubwordModel, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a double column ``name`` (replaced if it is there): how likely label 1 is."""
    import uuid

    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    df = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORES:
            _SCORES.clear()
            _SCORES[key] = WordScores(sent.value)
        for batch in slices(batches, text):
            p = score_texts(sent.value, _SCORES[key], strings(batch, text))
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in kept] + [pa.array(p)], names=[*kept, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels, per_class), name="score")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
