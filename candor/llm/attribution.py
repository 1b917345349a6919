"""Token counts by section, from one encoding of the whole document.

A document is encoded once; the lengths of its tokens add up to byte spans that
tile the text. Sections (by default its lines, each with its line end) tile it
too, so both are sorted intervals and a merge by binary search joins them. A
token over a boundary is given out by an explicit rule:

* ``start``: to the section that holds its first byte;
* ``majority``: to the section that holds most of its bytes, the earlier one on
  a tie (it may span more than two sections);
* ``share``: to each section in proportion to the bytes there.

Under every rule the counts of a document add up to its tokens.

Defined results: a null or empty text has one empty section with 0 tokens;
empty lines are sections; repeated rows are counted each; spans are given in
characters, end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from candor.llm.bpe import PATTERN, encoder
from candor.llm.common import column, slices, strings

RULES = ("start", "majority", "share")
SECTIONS = "doc_id bigint, section int, char_start bigint, char_end bigint, n_tokens double, n_crossing bigint"


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Byte offsets where sections begin, and the end: a section ends after its line end."""
    cuts = np.flatnonzero(data == 10) + 1
    cuts = cuts[cuts < len(data)]
    return np.concatenate([[0], cuts, [len(data)]])


def attribute(bounds: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many tokens that it shares with another section reach into it."""
    n = len(bounds) - 1
    if not len(ends):
        return np.zeros(n), np.zeros(n, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    inside = first == last
    counts = np.bincount(first if rule == "start" else first[inside], minlength=n)[:n].astype(float)
    crossing = np.zeros(n, dtype=np.int64)
    for t in np.flatnonzero(~inside).tolist():
        over = np.arange(first[t], last[t] + 1)
        crossing[over] += 1
        if rule == "start":
            continue
        share = np.minimum(bounds[over + 1], ends[t]) - np.maximum(bounds[over], starts[t])
        if rule == "share":
            counts[over] += share / share.sum()
        else:
            counts[over[np.argmax(share)]] += 1
    return counts, crossing


def token_counts(docs: DataFrame, rule: str = "majority", vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str = PATTERN) -> DataFrame:
    """One row per section of every document of ``docs`` (doc_id, text)."""
    if rule not in RULES:
        raise ValueError(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, pattern, "library")
        for batch in slices(batches):
            parts: list[tuple] = []
            ids_of, texts = column(batch, "doc_id"), strings(batch)
            sections = np.zeros(len(texts), dtype=np.int64)
            for i, t in enumerate(texts):
                raw = t.encode()
                data = np.frombuffer(raw, dtype=np.uint8)
                bounds = line_bounds(data)
                ends = np.cumsum(bpe.length_of[np.frombuffer(bpe.encode(t), dtype="<u4")])
                counts, crossing = attribute(bounds, ends, rule)
                chars = bounds if len(t) == len(raw) else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                sections[i] = len(counts)
                parts.append((np.arange(len(counts)), chars[:-1], chars[1:], counts, crossing))
            section, start, end, counts, crossing = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [ids_of.take(pa.array(np.repeat(np.arange(len(texts)), sections))), pa.array(section, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(counts, pa.float64()), pa.array(crossing, pa.int64())],
                names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SECTIONS)
