"""Benchmark decontamination by greedy string tiling.

Texts become tokens (runs of letters and digits, lower case). A seed is a run
of ``min_match`` tokens, hashed; sorted arrays join the seeds of a document to
those of the benchmark, and only pairs that share a seed are tiled. Tiling is
greedy: the longest match of tokens that no tile covers yet is marked in both
texts, again and again, until none of ``min_match`` tokens is left. Matches are
found from rolling Karp-Rabin hashes of token windows and checked token by token. As tiles may lie in any order, a passage with its
sentences moved about is covered as well as a verbatim one. A pair counts as a
leak when tiles cover ``threshold`` of the item's tokens.

The benchmark is handed to the workers in blocks of bounded size (a stated set
against all rows): one pass over the documents for each block, one for all
benchmarks up to ``block_bytes``.

Defined results: null and empty documents leak nothing; items of fewer than
``min_match`` tokens can't be told from common phrases and match nothing; of
equally long matches the first in the document, then in the item, is marked
first; repeated documents and items are judged each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.common import column, slices, spool, strings
from candor.llm.rowmarks import FILE, ROW, from_files, place, without

TOKENS = re.compile(r"[^\W_]+").findall
BASE = np.uint64(0x9E3779B97F4A7C15)
LEAKS = "item_id bigint, coverage double, tiles int, longest int, item_tokens int"


class TokenHashes(dict):
    """64-bit hashes of tokens, kept up to a bound."""

    def __missing__(self, token: str) -> int:
        h = xxhash.xxh64_intdigest(token)
        if len(self) >= 400_000:
            self.clear()
        self[token] = h
        return h

    def array(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2**64) of every run of ``size`` tokens."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * BASE + tokens[k : k + n]
    return h


class Rolling:
    """Karp-Rabin hashes (modulo 2**64) of the windows of any length of a token array, of which some are marked."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.used = tokens, np.zeros(len(tokens), dtype=bool)
        step = np.full(len(tokens), BASE, dtype=np.uint64)
        step[:1] = 1
        power = np.cumprod(step, dtype=np.uint64)
        back = np.full(len(tokens), pow(int(BASE), -1, 1 << 64), dtype=np.uint64)
        back[:1] = 1
        self.back = np.cumprod(back, dtype=np.uint64)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * power, dtype=np.uint64)])

    def free(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows without a marked token."""
        n = len(self.tokens) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marked = np.concatenate([[0], np.cumsum(self.used)])
        at = np.flatnonzero(marked[size:] == marked[:n])
        return at, (self.total[at + size] - self.total[at]) * self.back[at]


def shared(text: Rolling, item: Rolling, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of free windows in the text that the item has too; places and hashes of the item's, sorted by hash."""
    at, own = text.free(size)
    places, seeds = item.free(size)
    order = np.argsort(seeds, kind="stable")
    places, seeds = places[order], seeds[order]
    if not len(seeds):
        return at[:0], own[:0], places, seeds
    hit = seeds[np.minimum(np.searchsorted(seeds, own), len(seeds) - 1)] == own
    return at[hit], own[hit], places, seeds


def tile(text: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, length). The longest length that both still have is found by halving,
    since what has a window has all shorter ones; memory is that of the two texts, however often they repeat themselves."""
    t, i = Rolling(text), Rolling(item)
    tiles, most = [], min(len(text), len(item))
    while most >= size and len(shared(t, i, size)[0]):
        low = size
        while low < most:
            middle = (low + most + 1) // 2
            if len(shared(t, i, middle)[0]):
                low = middle
            else:
                most = middle - 1
        at, own, places, seeds = shared(t, i, most)
        begin, end = np.searchsorted(seeds, own, "left").tolist(), np.searchsorted(seeds, own, "right").tolist()
        next_of: dict[int, int] = {}  # the first place of a hash in the item that may still be free
        past = -1
        for x, a, b in zip(at.tolist(), begin, end, strict=True):  # those of one length, while still unmarked
            if x < past:
                continue
            k = next_of.get(a, a)
            while k < b and i.used[places[k] : places[k] + most].any():
                k += 1
            next_of[a] = k
            if k < b and (text[x : x + most] == item[places[k] : places[k] + most]).all():
                y = int(places[k])
                t.used[x : x + most] = i.used[y : y + most] = True
                tiles.append((x, y, most))
                past = x + most
        most -= 1
    return tiles


class SeedIndex:
    """Seeds of a block of items in one sorted array."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        self.size, self.hashes = size, TokenHashes()
        self.ids = [i for i, _ in items]
        self.tokens = [self.hashes.array(TOKENS(t.lower())) for _, t in items]
        parts = [np.unique(windows(t, size)) for t in self.tokens]
        seeds = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], owner[order]

    def candidates(self, text: np.ndarray) -> np.ndarray:
        """Items that share a seed with the text."""
        own = windows(text, self.size)
        if not len(self.seeds) or not len(own):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.seeds, own), len(self.seeds) - 1)
        hit = np.unique(own[self.seeds[at] == own])
        low, high = np.searchsorted(self.seeds, hit, "left"), np.searchsorted(self.seeds, hit, "right")
        return np.unique(np.concatenate([self.owner[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])) if len(hit) else np.zeros(0, dtype=np.int64)


_INDEX: dict[str, SeedIndex] = {}


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5, block_bytes: int = 16 << 20, ids: list[str] | None = None) -> DataFrame:
    """One row for each (document, item) with tiles over ``threshold`` of the item: doc_id (or the columns ``ids``),
    item_id, coverage, tiles, longest (tokens of the longest tile), item_tokens."""
    ids = ids or ["doc_id"]
    docs = docs.select(*ids, "text")
    items = benchmark.select("item_id", "text").where(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    if not blocks:
        return docs.sparkSession.createDataFrame([], _schema(docs, ids))
    if blocks == 1:
        return _leaks_of_block(docs, ids, items, min_match, threshold)[0]
    # One block after another: its rows are written and its broadcast is given up before the next one is read, so neither
    # driver nor executors hold more than a block at a time.
    parts = []
    for k in range(blocks):
        found, sent = _leaks_of_block(docs, ids, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), min_match, threshold)
        parts.append(spool(found, "leaks"))
        sent.destroy()
    return reduce(DataFrame.unionByName, parts)


def _schema(docs: DataFrame, ids: list[str]) -> T.StructType:
    return T.StructType([*docs.select(*ids).schema.fields, *T.StructType.fromDDL(LEAKS).fields])


def _leaks_of_block(docs: DataFrame, ids: list[str], block: DataFrame, min_match: int, threshold: float) -> tuple[DataFrame, Broadcast]:
    """Leaks of the items of ``block``, whose texts are bounded by the caller, and the broadcast that holds them."""
    sent, key = docs.sparkSession.sparkContext.broadcast(sorted(map(tuple, block.collect()), key=str)), uuid.uuid4().hex
    types = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
    names = [*ids, "item_id", "coverage", "tiles", "longest", "item_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _INDEX:
            if len(_INDEX) > 4:
                _INDEX.clear()
            _INDEX[key] = SeedIndex(sent.value, min_match)
        index = _INDEX[key]
        for batch in slices(batches):
            rows: list[tuple] = []
            for at, text in enumerate(strings(batch)):
                tokens = index.hashes.array(TOKENS(text.lower()))
                for k in index.candidates(tokens).tolist():
                    item = index.tokens[k]
                    tiles = tile(tokens, item, min_match)
                    covered = sum(x[2] for x in tiles) / len(item)
                    if covered >= threshold:
                        rows.append((at, index.ids[k], covered, len(tiles), max(x[2] for x in tiles), len(item)))
            if rows:
                own = pa.array([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays([column(batch, c).take(own) for c in ids] + [pa.array([r[j + 1] for r in rows], t) for j, t in enumerate(types)], names=names)

    return docs.mapInArrow(run, _schema(docs, ids)), sent


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that leak an item. A clean row that shares its doc_id with a leaking one stays, as
    rows are named by their file and place; see ``rowmarks``."""
    docs = from_files(docs)
    rows = docs.select(*place(docs), docs["text"].alias("text"))
    found = leaks(rows, benchmark, min_match, threshold, ids=[FILE, ROW]).select(FILE, ROW)
    return without(docs, found)
