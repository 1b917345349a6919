"""Scoring texts by online logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens (words between ASCII white space, A-Z lowered,
then one end). Every token is a path of bits. The most common training words
have a Huffman code of their own, in canonical order; any other word is an
escape, spelled by a Huffman code of bytes and closed by a stop. As the symbols
below a node of a code are neighbours in canonical order, the zeros and ones
that a context saw at a node are range sums over the symbols that it saw.

Three predictors say something about each bit of a word: no context; the last
short word (such words tell the language); and the hash of the two words before.
Bits of spelled bytes have the previous byte with its place, and the hashes of
the last three bytes and of all bytes of the word so far. The stretched predictions are added up with weights that a gate
selects (how often the hashed pair of words was seen, and for how many words it
has been right). Each text starts from the same weights and moves them online,
by a gradient step after every ``STRIDE`` words, before the next ones are
predicted. The sum of the bits' log probabilities is the score.

What is gathered grows with the corpus: pairs of words with the word after them are counted
exactly in a table partitioned by the pair's hash, never on one machine. Texts are coded in slices;
a slice sends each different (pair, word) once, with its count, to the bucket of the pair, and gets the counts along the word's path back. A frequent pair
is thus one entry a slice and word, not one a place. The other contexts are bounded by
parameters (the common words, ``SHORTS`` contexts, hashed bytes) and counted in dense tables.

A training text is never predicted from itself: its own counts are taken off
those of the pairs that come back (not off the dense tables, where they hardly weigh). So
texts score alike whether they were learned from or not, and a text with a copy elsewhere stands out.

The base score needs each token's count. Common words and a bounded number of further ones have theirs
at the workers; all others meet them in a join.

Defined results: a null text is empty and has one token, its end; without
training documents all counts are 0 and only the code's shape counts; a null doc_id
is never learned from and not held out; repeated rows are scored (and learned
from) each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import column, fold, release, slices, split_count, spool

HELD_OUT = 1
#: Bits of a symbol in a key; two symbols are the end and the escape, the others common words of up to LONGEST bytes.
SYMBOL_BITS = 17
COMMON, LONGEST = (1 << SYMBOL_BITS) - 2, 64
#: A common word was seen at least so often; the others show how new words are spelled.
LEAST = 2
#: Words after the common ones whose counts the workers get too, for the base score alone.
MORE = 3 << 17
#: Bits of the hash of a pair of words in a key: so many more than those of the number of training tokens, up to MOST_BITS.
SPARE_BITS, MOST_BITS = 6, 46
#: Contexts of the last short word: the most common ones, and one for all else.
SHORTS = 32
#: Hashed contexts of the last three bytes.
BYTES = 1 << 14
STOP = 256
#: Words between two steps of a text's weights, and the size of the first steps.
STRIDE, RATE = 16, 0.3
#: What the squared slopes of a weight start from; a step is RATE times the slope over the root of all squares so far.
CALM = 100.0
#: Tokens of texts that go on together (or one longer text).
TOGETHER = 1 << 15
#: Bytes of text in a slice, and of coded slices whose pairs make up a bucket.
SLICE, BUCKET = 3 << 20, 1 << 20
#: Counts from FULL on are given as shares of FULL.
FULL = 255
#: Weight of the context-free prediction in that of a short word, and the part of a count that every branch has.
PRIOR, PART = 1.0, 0.4
#: Stretched predictions of the dense tables are kept in steps of 1 / STEPS.
STEPS = 10
LEVELS, RUNS = 5, 3
GATES = LEVELS * RUNS + 2
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_BEGIN = np.uint64(0x165667B19E3779F9)


def byte_list(words: pa.Array) -> list[bytes]:
    """A large binary array as a list."""
    if not len(words):
        return []
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64, count=len(words) + 1, offset=8 * words.offset).tolist()
    data = words.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if offsets[-1] > offsets[0] else b""
    return [data[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2 ** 64."""
    out = np.full(n, 0x100000001B3, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each has; a null has none."""
    # Not cast before: the kernels misread a cast slice.
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, sizes = parts.flatten(), np.diff(parts.offsets.to_numpy())
    some = pc.greater(pc.binary_length(flat), 0)  # white space around a text leaves empty words
    owner = np.repeat(np.arange(len(sizes)), sizes)[some.to_numpy(zero_copy_only=False)]
    return flat.filter(some).cast(pa.binary()).cast(pa.large_binary()), np.bincount(owner, minlength=len(sizes))


def code_sizes(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths; every symbol has one, seen or not."""
    n = len(counts)
    if n == 1:
        return np.ones(1, dtype=np.int64)
    counts = np.maximum(counts, int(counts.sum()) >> 28)  # keeps codes within Code.WIDTH
    heap = [(int(c) + 1, i) for i, c in enumerate(counts.tolist())]
    heapq.heapify(heap)
    parent = np.zeros(2 * n - 1, dtype=np.int64)
    for new in range(n, 2 * n - 1):
        (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = new
        heapq.heappush(heap, (x + y, new))
    size = np.zeros(2 * n - 1, dtype=np.int64)
    for k in range(2 * n - 3, -1, -1):
        size[k] = size[parent[k]] + 1
    return size[:n]


class Code:
    """A canonical prefix code of symbols whose ``sizes`` never fall. ``first``: where the path of a symbol begins in
    ``node`` and ``bit``; ``low``, ``middle``, ``high``: the symbols below a node, those with bit 1 from ``middle`` on."""

    WIDTH = 56

    def __init__(self, sizes: np.ndarray):
        if (np.diff(sizes) < 0).any() or sizes.max() > self.WIDTH:
            raise ValueError("code lengths out of order or too long")
        step = np.uint64(1) << (self.WIDTH - sizes).astype(np.uint64)
        self.codes = (np.cumsum(step, dtype=np.uint64) - step).astype(np.uint64)
        self.size = sizes.astype(np.int32)
        self.first = (np.cumsum(sizes) - sizes).astype(np.int32)
        depth = np.arange(sizes.sum()) - np.repeat(self.first.astype(np.int64), sizes)
        code = np.repeat(self.codes, sizes)
        shift = (self.WIDTH - depth).astype(np.uint64)
        begin = code >> shift << shift
        _, some, node = np.unique(begin << np.uint64(6) | depth.astype(np.uint64), return_index=True, return_inverse=True)
        self.node, self.nodes = node.astype(np.int32), len(some)
        half = np.uint64(1) << (shift - np.uint64(1))
        self.bit = (code & half > 0).astype(np.int8)
        begin, half = begin[some], half[some]
        self.low, self.middle, self.high = (np.searchsorted(self.codes, x) for x in (begin, begin + half, begin + half + half))

    def told(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often a node was met, and how often it went on with 1, by the counts of the symbols."""
        total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return total[self.high] - total[self.low], total[self.high] - total[self.middle]


def stretched(one: np.ndarray, all_: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """log(p / (1 - p)) of a 1."""
    if prior is None:
        return np.log((one + PART) / (all_ - one + PART))
    return np.log((one + PRIOR * prior) / (all_ - one + PRIOR * (1 - prior)))


def _small(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round(x * STEPS), -127, 127).astype(np.int8)


#: LOOK[all * (FULL + 1) + on]: what ``on`` of ``all`` earlier words on the path say of the branch taken.
LOOK = np.where(np.arange(FULL + 1)[:, None] > 0, stretched(np.minimum.outer(np.arange(FULL + 1), np.arange(FULL + 1)) * 1.0, np.arange(FULL + 1.0)[:, None]), 0).astype(np.float32).ravel()


def first_weights() -> np.ndarray:
    """Weights of (last short word or three bytes, pair or all bytes) that every text starts with, by gate."""
    w = np.zeros((GATES, 2), dtype=np.float32)
    words = w[: LEVELS * RUNS].reshape(LEVELS, RUNS, 2)
    words[0] = (1.0, 0.0)
    words[1:] = [(0.9, 0.15), (0.4, 1.6), (0.2, 3.0)]
    w[LEVELS * RUNS :] = 0.5
    return w


@dataclass
class Vocabulary:
    """The common words in the order of their symbols, with all that follows from them. ``shorts``: context of each symbol as last short word, or -1."""

    words: list[bytes] | None
    counts: np.ndarray  # of the symbols
    byte_counts: np.ndarray
    end: int
    escape: int
    pair_bits: int
    #: Further words, and log10 of their counts and 0.5.
    more: pa.Array | None = None
    more_log: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.code, self.spelling = Code(np.sort(code_sizes(self.counts))), Code(np.sort(code_sizes(self.byte_counts)))
        order = np.argsort(code_sizes(self.byte_counts), kind="stable")
        self.of_byte = np.empty(STOP + 1, dtype=np.int64)
        self.of_byte[order] = np.arange(STOP + 1)
        n = len(self.counts)
        # One space of symbols, path places and nodes for words and bytes.
        self.size = np.concatenate([self.code.size, self.spelling.size])
        self.first = np.concatenate([self.code.first, self.spelling.first + len(self.code.node)])
        self.path = np.concatenate([self.code.node * 2 + self.code.bit, self.spelling.node * 2 + self.spelling.bit])
        self.code.node = self.code.bit = self.spelling.node = self.spelling.bit = None  # the paths hold them
        self.lengths = np.array([len(w) if w is not None else 0 for w in self.words], dtype=np.int64)
        self.listed = pa.array(self.words, pa.large_binary())
        self.hashes = np.array([xxhash.xxh64_intdigest(w) if w is not None else 0 for w in self.words], dtype=np.uint64)
        self.hashes[self.end] = _K1
        self.shorts = np.full(n, -1, dtype=np.int64)
        short = [i for i, w in enumerate(self.words) if w is not None and len(w) <= 3]
        self.shorts[short] = np.minimum(np.arange(len(short)), SHORTS - 1)
        self.words = None  # ``listed`` holds them


def vocabulary(top: list[tuple[bytes, int]], n_docs: int, rare: int, byte_counts: np.ndarray) -> Vocabulary:
    """``top``: common words with their counts, falling; ``rare``: tokens of all other words, spelled by ``byte_counts``."""
    words: list = [w for w, _ in top] + [None, None]
    counts = np.array([c for _, c in top] + [n_docs, rare], dtype=np.int64)
    sizes = code_sizes(counts)
    order = np.lexsort((-counts, sizes))
    back = np.argsort(order)
    bits = min(MOST_BITS, max(16, int(counts.sum()).bit_length() + SPARE_BITS))
    return Vocabulary([words[i] for i in order.tolist()], counts[order], byte_counts, int(back[-2]), int(back[-1]), bits)


@dataclass
class Slice:
    """Coded texts: symbol of each token, tokens of each text, the different rare words, and which of them each escape stands for."""

    symbols: np.ndarray
    sizes: np.ndarray
    rare: list[bytes]
    which: np.ndarray
    train: np.ndarray  # of each text

    @staticmethod
    def of(voc: Vocabulary, texts: pa.Array, train: list[bool]) -> Slice:
        flat, sizes = words_of(texts)
        found = flat.dictionary_encode()
        number = pc.fill_null(pc.index_in(found.dictionary, voc.listed), voc.escape).to_numpy(zero_copy_only=False).astype(np.int32)
        at = found.indices.to_numpy()
        symbols = np.full(len(at) + len(sizes), voc.end, dtype=np.int32)
        ends = np.zeros(len(symbols), dtype=bool)
        ends[np.cumsum(sizes + 1) - 1] = True
        symbols[~ends] = number[at]
        unknown = np.flatnonzero(number == voc.escape)
        name = np.zeros(len(number), dtype=np.int32)
        name[unknown] = np.arange(len(unknown))
        return Slice(symbols, sizes + 1, byte_list(found.dictionary.take(pa.array(unknown))), name[at[number[at] == voc.escape]], np.array(train, dtype=bool))

    def packed(self) -> bytes:
        head = np.array([len(self.sizes), len(self.symbols), len(self.which)], dtype="<i8").tobytes()
        planes = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3]).tobytes() for a in (self.symbols, self.which)]
        return zstandard.ZstdCompressor(level=3).compress(head + self.sizes.astype("<i8").tobytes() + self.train.tobytes() + b"".join(planes) + b"\n".join(self.rare))

    @staticmethod
    def unpacked(data: bytes) -> Slice:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n, m, r = np.frombuffer(raw, dtype="<i8", count=3).tolist()
        sizes, train = np.frombuffer(raw, dtype="<i8", count=n, offset=24), np.frombuffer(raw, dtype=bool, count=n, offset=24 + 8 * n)
        at, numbers = 24 + 9 * n, []
        for k in (m, r):
            planes = np.zeros((k, 4), dtype=np.uint8)
            planes[:, :3] = np.frombuffer(raw, dtype=np.uint8, count=3 * k, offset=at).reshape(3, k).T
            numbers.append(planes.view("<i4").ravel())
            at += 3 * k
        return Slice(numbers[0], sizes, raw[at:].split(b"\n") if r else [], numbers[1], train)

    def places(self, voc: Vocabulary) -> np.ndarray:
        """The text of each escape."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)[self.symbols == voc.escape]

    def listed(self, voc: Vocabulary) -> np.ndarray:
        """Where each rare word stands among the vocabulary's further words; -1 if it doesn't."""
        if not self.rare or voc.more is None or not len(voc.more):
            return np.full(len(self.rare), -1, dtype=np.int64)
        return pc.fill_null(pc.index_in(pa.array(self.rare, pa.large_binary()), voc.more), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def keys(self, voc: Vocabulary) -> np.ndarray:
        """(hash of the two words before, symbol) of each token."""
        h = voc.hashes[self.symbols]
        if self.rare:
            h[self.symbols == voc.escape] = np.fromiter(map(xxhash.xxh64_intdigest, self.rare), dtype=np.uint64, count=len(self.rare))[self.which]
        starts = self.starts()
        one, two = np.empty_like(h), np.empty_like(h)
        one[1:], two[2:] = h[:-1], h[:-2]
        one[starts] = two[starts] = _BEGIN
        two[(starts + 1)[self.sizes > 1]] = _BEGIN
        with np.errstate(over="ignore"):
            mix = one * _K1 + two * _K2
            mix = (mix ^ mix >> np.uint64(29)) * _K3 >> np.uint64(64 - voc.pair_bits)
        return mix << np.uint64(SYMBOL_BITS) | self.symbols.astype(np.uint64)

    def last_shorts(self, voc: Vocabulary) -> np.ndarray:
        """Context of the last short word before each token, in its text."""
        at = np.arange(len(self.symbols))
        some = np.where(voc.shorts[self.symbols] >= 0, at, -1)
        last = np.concatenate([[-1], np.maximum.accumulate(some)[:-1]])
        known = last >= np.repeat(self.starts(), self.sizes)
        return np.where(known, voc.shorts[self.symbols[np.maximum(last, 0)]], SHORTS - 1)

    def spelled(self, voc: Vocabulary) -> tuple[np.ndarray, ...]:
        """The bytes of the different rare words, each closed by a stop: symbols, sizes of the words, and the contexts of
        the last three bytes and of all bytes of the word so far."""
        sizes = np.array([len(w) + 1 for w in self.rare], dtype=np.int64)
        data = np.frombuffer(b"".join(w + b"\0" for w in self.rare), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        data[ends - 1] = STOP
        at = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        powers = _powers(int(at.max()) + 1)
        back = []
        for k in (1, 2, 3):
            b = np.zeros_like(data)
            b[k:] = data[:-k] + 1
            back.append(np.where(at >= k, b, 0))
        far = ((back[0] + 257 * back[1] + 257 * 257 * back[2]).astype(np.uint64) * _K1 >> np.uint64(64 - (BYTES.bit_length() - 1))).astype(np.int64)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[at], out=total[1:])
            prefix = total[:-1] - np.repeat(total[ends - sizes], sizes)
            all_ = ((prefix ^ prefix >> np.uint64(29)) * _K3 >> np.uint64(64 - (BYTES.bit_length() - 1))).astype(np.int64)
        return voc.of_byte[data], sizes, far, all_


def dense_counts(sent: Broadcast, coded: DataFrame) -> DataFrame:
    """(tab, block, data): counts of symbols in the training texts by last short word (tab 0), of bytes by three
    bytes (1) and by all bytes of the word so far (2); one row a block of contexts and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, n = sent.value, len(sent.value.counts)
        tables = [np.zeros(k, dtype=np.uint32) for k in (SHORTS * n, BYTES * (STOP + 1), BYTES * (STOP + 1))]
        for batch in batches:
            for data in column(batch, "data"):
                s = Slice.unpacked(data.as_py())
                learned = np.repeat(s.train, s.sizes)
                np.add.at(tables[0], (s.last_shorts(v) * n + s.symbols)[learned], np.uint32(1))
                if s.rare:
                    symbol, sizes, *contexts = s.spelled(v)
                    times = np.repeat(np.bincount(s.which[learned[s.symbols == v.escape]], minlength=len(s.rare)), sizes)
                    for table, context in zip(tables[1:], contexts, strict=True):
                        np.add.at(table, context * (STOP + 1) + symbol, times.astype(np.uint32))
        pack = zstandard.ZstdCompressor(level=1)
        for tab, (table, blocks) in enumerate(zip(tables, (SHORTS, BYTES // 64, BYTES // 64), strict=True)):
            rows = [(b, pack.compress(part.tobytes())) for b, part in enumerate(table.reshape(blocks, -1)) if part.any()]
            yield _block_rows(tab, rows)
        del tables, table
        release()

    return coded.select("data").mapInArrow(run, "tab int, block int, data binary")


def _block_rows(tab: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tab] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["tab", "block", "data"])


def summed(blocks: DataFrame) -> DataFrame:
    """One row for each (tab, block). A task adds up blocks as they come in, holding only the sums."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for tab, block, data in zip(*(column(batch, c) for c in ("tab", "block", "data")), strict=True):
                part = np.frombuffer(unpack.decompress(data.as_py()), dtype=np.uint32)
                key = (tab.as_py(), block.as_py())
                if key in sums:
                    np.minimum(sums[key].astype(np.uint64) + part, 0xFFFFFFFF, out=sums[key], casting="unsafe")
                else:
                    sums[key] = part.copy()
        for (tab, block), part in sums.items():
            yield _block_rows(tab, [(block, pack.compress(part.tobytes()))])

    return blocks.repartition(n, "tab", "block").mapInArrow(run, "tab int, block int, data binary")


@dataclass
class MixingModel:
    voc: Vocabulary
    #: Stretched predictions of a 1 at a node, flat and in steps of 1 / STEPS: words by last short word, bytes by three
    #: bytes, bytes by all bytes of the word so far.
    dense: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.far_at = self.voc.code.nodes * SHORTS
        self.all_at = self.far_at + BYTES * self.voc.spelling.nodes


def dense_tables(voc: Vocabulary, counts: DataFrame) -> np.ndarray:
    """The tables as the workers use them, from one row a block at a time."""
    words, bytes_ = voc.code, voc.spelling
    plain = stretched(*_turned(words.told(voc.counts)))
    sure, letters = 1 / (1 + np.exp(-plain)), 1 / (1 + np.exp(-stretched(*_turned(bytes_.told(voc.byte_counts[np.argsort(voc.of_byte)])))))
    short = np.tile(_small(plain), (SHORTS, 1))
    tables = [np.tile(_small(np.log(letters / (1 - letters))), (k, 1)) for k in (BYTES, BYTES)]
    unpack = zstandard.ZstdDecompressor()
    for r in counts.toLocalIterator():
        part = np.frombuffer(unpack.decompress(r["data"]), dtype=np.uint32)
        if r["tab"] == 0:
            all_, one = words.told(part)
            short[r["block"]] = _small(stretched(one, all_, sure))
        else:
            each = part.reshape(-1, STOP + 1)
            for k, row in enumerate(each):
                if row.any():
                    all_, one = bytes_.told(row)
                    tables[r["tab"] - 1][r["block"] * len(each) + k] = _small(stretched(one, all_, letters))
    return np.concatenate([short.ravel(), *[t.ravel() for t in tables]])


def _turned(told: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return told[1], told[0]


def path_counts(code: Code, group: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of (group, symbol): for each, how many of its group share its path, before its first bit and
    after each of its bits. Flat, and where each entry's numbers begin."""
    size = code.size[symbols].astype(np.int64)
    begins = first = np.cumsum(size + 1) - size - 1
    out = np.zeros(int((size + 1).sum()), dtype=np.int64)
    left = code.codes[symbols]
    for depth in range(int(size.max()) + 1 if len(size) else 0):
        bits = left >> np.uint64(Code.WIDTH - depth)
        new = np.ones(len(group), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (bits[1:] != bits[:-1])
        begin = np.flatnonzero(new)
        many = np.diff(np.append(begin, len(group)))
        out[first + depth] = np.repeat(np.add.reduceat(counts, begin), many)
        # Who is alone on the path stays so; who is at its end stands beside none but its like.
        alone = begin[many == 1]
        rest = size[alone] - depth
        out[_ranges(first[alone] + depth + 1, rest)] = np.repeat(counts[alone], rest)
        on = size > depth
        on[alone] = False
        group, left, counts, first, size = group[on], left[on], counts[on], first[on], size[on]
        if not len(group):
            break
    return out, begins


def _delta(keys: np.ndarray) -> bytes:
    """Sorted keys as the bytes of their differences, by significance."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def entries(sent: Broadcast, coded: DataFrame, buckets: int) -> DataFrame:
    """(bucket, slice, n, data): the different keys of a slice, in order, with their counts in training texts."""
    most = 1 << sent.value.pair_bits
    cuts = np.array([k * most // buckets for k in range(buckets + 1)], dtype=np.uint64)
    cuts <<= np.uint64(SYMBOL_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for number, data in zip(column(batch, "slice").to_pylist(), column(batch, "data"), strict=True):
                s = Slice.unpacked(data.as_py())
                keys, counts = slice_entries(s, sent.value)
                at = np.searchsorted(keys, cuts).tolist()
                rows = [(b, number, j - i, pack.compress(_delta(keys[i:j]) + np.ascontiguousarray(counts[i:j].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())) for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "slice", "n", "data"])
        release()

    return coded.select("slice", "data").mapInArrow(run, "bucket int, slice bigint, n bigint, data binary")


def slice_entries(s: Slice, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, in order, and for each twice its count in training texts, plus 1 if it stands in another text."""
    both = np.sort(s.keys(voc) << np.uint64(1) | np.repeat(s.train, s.sizes).astype(np.uint64))
    keys = both >> np.uint64(1)
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    learned = both & np.uint64(1)
    return keys[begin], np.add.reduceat(learned.astype(np.int64), begin) * 2 + (learned[begin] == 0)


def answers(sent: Broadcast, asked: DataFrame, buckets: int) -> DataFrame:
    """(slice, bucket, data): for the entries of a slice in a bucket, in order, whether their pair is known from more than
    themselves, and if so the counts along the path of the word after it."""

    def run(table: pa.Table) -> pa.Table:
        unpack, pack, code = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=6), sent.value.code
        keys, counts = [], []
        for n, data in zip(table.column("n").to_pylist(), table.column("data"), strict=True):
            raw = np.frombuffer(unpack.decompress(data.as_py()), dtype=np.uint8)
            keys.append(np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64))
            counts.append(np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel())
        found = answered(code, keys, counts)
        release()
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"slice": table.column("slice"), "bucket": pa.array([bucket] * len(found), pa.int32()), "n": table.column("n"), "data": pa.array([pack.compress(np.packbits(flag).tobytes() + path.tobytes()) for flag, path in found], pa.binary())})

    return asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, "slice bigint, bucket int, n bigint, data binary")


def answered(code: Code, keys: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each list of entries: which have an answer, and the numbers of those that have (1 + bits of the word each)."""
    ends = np.cumsum([len(k) for k in keys])
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    asked, all_counts = all_counts & 1 > 0, all_counts >> 1
    order = np.argsort(all_keys, kind="stable")
    in_order = all_keys[order]
    begin = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
    place = np.empty(len(all_keys), dtype=np.int64)
    place[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    different, total = in_order[begin], np.add.reduceat(all_counts[order], begin)
    del in_order, order
    group, symbols = different >> np.uint64(SYMBOL_BITS), (different & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    many = np.diff(np.append(new, len(group)))
    known = np.repeat(np.add.reduceat(total, new), many)
    flag = (known[place] > 1) | ((known[place] == 1) & (asked | (all_counts == 0)))
    wanted = np.zeros(len(different), dtype=bool)
    wanted[place[flag]] = True
    wanted = np.repeat(np.logical_or.reduceat(wanted, new), many)
    alone = np.repeat(many == 1, many)
    size = code.size[symbols].astype(np.int64) + 1
    size[~wanted] = 0
    at = np.cumsum(size) - size
    paths = np.empty(int(size.sum()), dtype=np.uint8)
    some = wanted & alone
    paths[_ranges(at[some], size[some])] = np.repeat(np.minimum(total[some], FULL), size[some])
    some = wanted & ~alone
    told, _ = path_counts(code, group[some], symbols[some], total[some])
    share = np.where(known[some] >= FULL, FULL / np.maximum(known[some], 1), 1.0)
    paths[_ranges(at[some], size[some])] = np.minimum(np.ceil(told * np.repeat(share, size[some]) - 1e-9), FULL)
    out, start = [], 0
    for end in ends.tolist():
        own, there = place[start:end], flag[start:end]
        own = own[there]
        out.append((there, paths[_ranges(at[own], size[own])]))
        start = end
    return out


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _by_text(text: np.ndarray, n: int) -> np.ndarray:
    """Stable order by text; small numbers are sorted by radix."""
    return np.argsort(text.astype(np.uint16) if n <= 1 << 16 else text, kind="stable")


def pair_paths(voc: Vocabulary, s: Slice, flags: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token: how often its pair was seen in other texts, whether the word ever followed it there, where the
    pair's predictions for the bits of the word begin (-1 without), and all these predictions."""
    code, n = voc.code, len(s.sizes)
    text = np.repeat(np.arange(n), s.sizes)
    keys = s.keys(voc)
    order = np.argsort(keys)
    in_order = keys[order]
    new = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    flag = np.repeat(flags, np.diff(np.append(np.flatnonzero(new), len(keys))))
    size = np.where(flags, code.size[(in_order[new] & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.int64)] + 1, 0)
    path_at = (np.cumsum(size) - size)[np.cumsum(new)[flag] - 1]
    some = order[flag]
    level, right, bit_at = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool), np.full(len(keys), -1, dtype=np.int64)
    if not len(some):
        return level, right, bit_at, np.zeros(0, dtype=np.float32)
    turn = _by_text(text[some], n)
    some, path_at = some[turn], path_at[turn]
    wide = code.size[s.symbols[some]].astype(np.int64) + 1
    at = np.cumsum(wide) - wide
    told = paths[_ranges(path_at, wide)].astype(np.int16)
    # Less the text's own, where that shows.
    pair, owner = in_order[flag][turn] >> np.uint64(SYMBOL_BITS), text[some]
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])])
    many = np.diff(np.append(np.flatnonzero(new), len(some)))
    own, single = s.train[owner] & (told[at] < FULL), np.repeat(many == 1, many)
    told -= np.repeat((own & single).astype(np.int16), wide)
    rest = own & ~single
    if rest.any():
        less, _ = path_counts(code, np.cumsum(new)[rest], s.symbols[some[rest]].astype(np.int64), np.ones(int(rest.sum()), dtype=np.int64))
        told[_ranges(at[rest], wide[rest])] -= less.astype(np.int16)
    level[some] = np.searchsorted([1, 2, 4, 32], told[at], side="right")
    right[some] = told[at + wide - 1] > 0
    bit_at[some] = at - np.arange(len(some))
    inner = np.ones(len(told), dtype=bool)
    inner[at + wide - 1] = False
    inner = inner[:-1]
    return level, right, bit_at, LOOK.take(told[:-1][inner].astype(np.int64) * (FULL + 1) + told[1:][inner])


def score_slice(m: MixingModel, s: Slice, flags: np.ndarray, paths: np.ndarray, stride: int = STRIDE, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability and coded bytes of each text. ``flags`` and ``paths`` are the answers to the slice's entries, in
    order. Texts of like length go on together by ``stride`` words a step, each with weights of its own."""
    voc, n, m_tokens = m.voc, len(s.sizes), len(s.symbols)
    text = np.repeat(np.arange(n), s.sizes)
    level, right, bit_at, x_pair = pair_paths(voc, s, flags, paths)
    # For how many words the pairs have been right up to this one: none, one, more.
    starts = s.starts()
    before = np.concatenate([[False], right[:-1]])
    before[starts] = False
    earlier = np.concatenate([[False], before[:-1]])
    earlier[starts] = False
    gate = np.where(level > 0, level * RUNS + np.where(before, 1 + earlier, 0), 0)
    # Symbols of words and then those of spelled bytes; the dense table of each, and the second one of bytes.
    step = (np.arange(m_tokens) - np.repeat(starts, s.sizes)) // stride
    symbols, dense = s.symbols.astype(np.int64), s.last_shorts(voc) * voc.code.nodes
    per, second = voc.lengths[s.symbols], np.zeros(0, dtype=np.int64)
    if s.rare:
        spelled, widths, far, all_ = s.spelled(voc)
        escapes = np.flatnonzero(s.symbols == voc.escape)
        each = _ranges((np.cumsum(widths) - widths)[s.which], widths[s.which])
        owner = np.repeat(escapes, widths[s.which])
        per[escapes] = widths[s.which] - 1
        symbols = np.concatenate([symbols, spelled[each] + len(voc.code.size)])
        dense = np.concatenate([dense, (m.far_at + far * voc.spelling.nodes)[each]])
        second = (m.all_at + all_ * voc.spelling.nodes)[each]
        gate = np.concatenate([gate, np.where(np.arange(len(each)) > 0, np.concatenate([[False], owner[1:] == owner[:-1]]), False) + LEVELS * RUNS])
        step, text = np.concatenate([step, step[owner]]), np.concatenate([text, text[owner]])
    coded = np.add.reduceat(per, starts) + np.maximum(s.sizes - 1, 1)
    # Texts in groups of like length; in a group step by step; in a step by cells, one for each text and gate.
    order = np.argsort(-s.sizes, kind="stable")
    group = np.empty(n, dtype=np.int64)
    group[order] = (np.cumsum(s.sizes[order]) - s.sizes[order]) // TOGETHER
    steps = int(step.max()) + 1
    key = ((group[text] * steps + step) * n + text) * GATES + gate
    turn = np.argsort(key)
    key = key[turn]
    weights = np.tile(m.weights, (n, 1))
    slope, squares = np.zeros_like(weights), np.full_like(weights, CALM)
    total = np.zeros(n)
    round_of = key // (n * GATES)
    ends = np.append(np.flatnonzero(np.diff(round_of // steps)) + 1, len(turn))
    begin = 0
    for end in ends.tolist():
        own = turn[begin:end]
        x, width = _inputs(m, symbols[own], dense[own], bit_at, x_pair, second, own, m_tokens)
        bits = np.concatenate([[0], np.cumsum(width)])
        cell = np.flatnonzero(np.concatenate([[True], np.diff(key[begin:end]) != 0]))
        first, where = bits[cell], key[begin + cell] % (n * GATES)
        rounds = round_of[begin + cell]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(rounds)) + 1, [len(cell)]])
        first = np.append(first, bits[-1])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            low, at, start, wide = first[a], where[a:b], first[a:b] - first[a], np.diff(first[a : b + 1])
            x0, x1, w = x[0, low : first[b]], x[1, low : first[b]], weights[at]
            z = x0 * np.repeat(w[:, 0], wide)
            z += x1 * np.repeat(w[:, 1], wide)
            np.clip(z, -14, 14, out=z)
            q = np.exp(np.negative(z, out=z), out=z)
            more = q + np.float32(1)
            q /= more  # the probability of the branch not taken
            np.subtract.at(total, at // GATES, np.add.reduceat(np.log(more, out=more), start).astype(np.float64))
            moved = np.stack([np.add.reduceat(q * x0, start), np.add.reduceat(q * x1, start)], 1)
            squares[at] += moved * moved
            weights[at] = w + np.float32(rate) * moved / np.sqrt(squares[at])
        begin = end
    return total / np.log(10), coded


def _inputs(m: MixingModel, symbols: np.ndarray, dense: np.ndarray, bit_at: np.ndarray, x_pair: np.ndarray, second: np.ndarray, own: np.ndarray, m_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """What the two predictors say of the branches taken at all bits of some symbols, and the bits of each symbol."""
    voc = m.voc
    width = voc.size.take(symbols).astype(np.int64)
    start = np.cumsum(width) - width
    k = np.repeat(voc.first.take(symbols) - start, width)
    k += np.arange(len(k))
    path = voc.path.take(k)
    sign, node = (path & 1).astype(np.float32) * np.float32(2 / STEPS) - np.float32(1 / STEPS), path >> 1
    x = np.zeros((2, len(k)), dtype=np.float32)
    np.multiply(m.dense.take(np.repeat(dense, width) + node), sign, out=x[0])
    word = np.flatnonzero(own < m_tokens)
    word = word[bit_at[own[word]] >= 0]
    x[1, _ranges(start[word], width[word])] = x_pair.take(_ranges(bit_at[own[word]], width[word]))
    byte = np.flatnonzero(own >= m_tokens)
    there = _ranges(start[byte], width[byte])
    x[1, there] = m.dense.take(np.repeat(second[own[byte] - m_tokens], width[byte]) + node[there]) * sign[there]
    return x, width


def token_table(docs: DataFrame) -> DataFrame:
    """(word, c): counts of the words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 * SLICE):
            found = pc.value_counts(words_of(column(batch, "text"))[0])
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def byte_counts(words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """How often each byte stands in words with counts."""
    total = np.zeros(STOP, dtype=np.int64)
    np.add.at(total, np.frombuffer(b"".join(words), dtype=np.uint8), np.repeat(counts, [len(w) for w in words]))
    return total


def table_bytes(table: DataFrame) -> np.ndarray:
    """Counts of the 256 bytes in all words of a token table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STOP, dtype=np.int64)
        for batch in batches:
            total += byte_counts(column(batch, "word").to_pylist(), column(batch, "c").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STOP), pa.int32()), pa.array(total)], names=["byte", "n"])

    counts = np.zeros(STOP, dtype=np.int64)
    for r in table.mapInArrow(run, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[r["byte"]] = r["n"]
    return counts


def coded_slices(sent: Broadcast, docs: DataFrame, size: int) -> DataFrame:
    """(slice, ids, data): texts as symbols, ``size`` bytes of text or one longer text a row. ``docs`` has doc_id, text, train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36  # slices are numbered by their first text
        for batch in slices(batches, limit=size):
            s = Slice.of(sent.value, column(batch, "text"), column(batch, "train").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([column(batch, "doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([s.packed()], pa.binary())], names=["slice", "ids", "data"])
            at += batch.num_rows

    return docs.mapInArrow(run, "slice bigint, ids array<bigint>, data binary")


def rare_words(sent: Broadcast, coded: DataFrame) -> DataFrame:
    """(text, word): the words whose counts the workers don't have, each time they stand in a text; ``text`` is ``text_number``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(column(batch, "slice").to_pylist(), column(batch, "data"), strict=True):
                s = Slice.unpacked(data.as_py())
                asked = s.listed(sent.value)[s.which] < 0 if s.rare else np.zeros(0, dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(text_number(number, s.places(sent.value)[asked])), pa.array(s.rare, pa.binary()).take(pa.array(s.which[asked]))], names=["text", "word"])

    return coded.select("slice", "data").mapInArrow(run, "text bigint, word binary")


def text_number(number: int, place: np.ndarray) -> np.ndarray:
    """One number for each text: (task, slice in the task, place in the slice)."""
    return number + place.astype(np.int64)


SCORED = "text bigint, doc_id bigint, n_tokens bigint, seen bigint, common_log double, score double, bits_per_byte double"


def scored_slices(model: Broadcast, coded: DataFrame, told: DataFrame, parts: int, stride: int = STRIDE, rate: float = RATE) -> DataFrame:
    """The rows of all slices, which meet the answers to their entries."""

    def run(table: pa.Table) -> pa.Table:
        m = model.value
        unpack = zstandard.ZstdDecompressor()
        bucket = table.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable").tolist()
        s = Slice.unpacked(table.column("data")[order[0]].as_py())
        n, flags, paths = table.column("n").to_pylist(), [], []
        for k in order[1:]:
            raw = np.frombuffer(unpack.decompress(table.column("data")[k].as_py()), dtype=np.uint8)
            head = -(-n[k] // 8)
            flags.append(np.unpackbits(raw[:head], count=n[k]).astype(bool)), paths.append(raw[head:])
        score, coded_bytes = score_slice(m, s, np.concatenate(flags), np.concatenate(paths), stride, rate)
        release()
        log = np.log10(m.voc.counts + 0.5)
        log[m.voc.escape] = 0
        starts, number = s.starts(), table.column("slice")[0].as_py()
        known = (s.symbols != m.voc.escape) & (m.voc.counts[s.symbols] > 0)
        at = s.listed(m.voc)[s.which] if s.rare else np.zeros(0, dtype=np.int64)
        place, n_texts = s.places(m.voc)[at >= 0], len(s.sizes)
        more_log = np.bincount(place, m.voc.more_log[at[at >= 0]], n_texts) if len(place) else np.zeros(n_texts)
        return pa.table(
            {
                "text": pa.array(text_number(number, np.arange(len(s.sizes)))),
                "doc_id": table.column("ids")[order[0]].values,
                "n_tokens": pa.array(s.sizes),
                "seen": pa.array(np.add.reduceat(known.astype(np.int64), starts) + np.bincount(place, minlength=n_texts)),
                "common_log": pa.array(np.add.reduceat(log[s.symbols], starts) + more_log),
                "score": pa.array(score),
                "bits_per_byte": pa.array(-score * np.log2(10) / coded_bytes),
            }
        )

    both = coded.select("slice", F.lit(-1).alias("bucket"), F.lit(0).cast("bigint").alias("n"), "ids", "data").unionByName(told.select("slice", "bucket", "n", F.lit(None).cast("array<bigint>").alias("ids"), "data"))
    return both.repartition(parts, "slice").groupBy("slice").applyInArrow(run, SCORED)


def mixing_scores(docs: DataFrame, common: int = COMMON, more: int = MORE, least: int = LEAST, slice_bytes: int = SLICE, bucket: int = BUCKET, stride: int = STRIDE, rate: float = RATE) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(fold("doc_id") != HELD_OUT, F.lit(False)).alias("train"))
    train = docs.where("train")
    table = spool(token_table(train), "tokens")
    n_docs = train.count()
    known = table.agg(F.count("*"), F.sum("c")).first()
    n_tokens, n_kinds = (known[1] or 0) + n_docs, known[0] + (n_docs > 0)
    top = table.where((F.octet_length("word") <= LONGEST) & (F.col("c") >= least)).orderBy(F.desc("c"), "word").limit(common + more).toArrow().combine_chunks()
    words, counts = top.column("word").slice(0, common).to_pylist(), top.column("c").slice(0, common).to_numpy()
    rare = int((known[1] or 0) - counts.sum())
    letters = np.append(table_bytes(table) - byte_counts(words, counts), rare)
    voc = vocabulary(list(zip(words, counts.tolist(), strict=True)), n_docs, rare, letters)
    voc.more = pa.array(top.column("word").slice(common).to_pylist(), pa.large_binary())
    voc.more_log = np.log10(top.column("c").slice(common).to_numpy() + 0.5)
    del top, words
    sent = spark.sparkContext.broadcast(voc)
    # Small row groups, so that the few large rows are read by many tasks.
    coded = spool(coded_slices(sent, docs, slice_bytes), "coded", **{"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4})
    n_slices = coded.count()
    model = spark.sparkContext.broadcast(MixingModel(voc, dense_tables(voc, summed(dense_counts(sent, coded))), first_weights()))
    buckets = split_count(coded.agg(F.sum(F.octet_length("data"))).first()[0], bucket)
    told = answers(sent, entries(sent, coded, buckets), buckets)
    scored = scored_slices(model, coded, told, split_count(n_slices, 2), stride, rate)
    per_text = rare_words(sent, coded).join(table, "word", "left").groupBy("text").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"), F.count("c").alias("rare_seen"))
    norm = float(np.log10(n_tokens + 0.5 * (n_kinds + 1)))
    return scored.join(per_text, "text", "left").select(
        "doc_id",
        F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("seen") + F.coalesce("rare_seen", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("common_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
        "bits_per_byte",
    )
