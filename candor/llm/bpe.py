"""Byte-level BPE from rank files: exact encoding and decoding of whole texts.

The encoder maps bytes to Latin-1 so that an Aho-Corasick automaton over the
vocabulary finds, in one scan, the longest token at every offset. It then walks
the piece with backtracking: a token may follow another only if the merges of
their joined bytes give back just these two (memoised), and an offset from
which no walk can go on is never tried again, so the work is linear in the
piece. Every prefix of a piece has exactly one such walk, which is what the
merges in rank order produce.

Defined results: null counts as the empty text (no ids, empty decoding); ids
are little-endian unsigned 32-bit; text that looks like a special token is
ordinary text; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.common import SLICE_BYTES, column, slices, strings

#: The split pattern of the public rank files (a fixed value; the driver of this query passes the library's own).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: The pattern in terms of the standard library's faster engine, whose classes are the same as the
#: pattern's for the characters outside _OTHER: ASCII without its separators, and Latin letters.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile(r"[^\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")


class _Pieces(dict):
    """Encoded pieces by text, starting afresh at a bound."""

    def __init__(self, encode_piece, bound: int):
        self.encode_piece, self.bound = encode_piece, bound

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[piece] = ids
        return ids


class BytePairEncoder:
    """Encoder and decoder for one rank file. ``engine`` is ``automaton`` (the
    method above) or ``library`` (tiktoken merges the pieces)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, engine: str = "automaton", cache: int = 700_000):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length_of = np.fromiter(map(len, self.bytes_of), dtype=np.int64, count=len(self.bytes_of))
        self._lengths = self.length_of.tolist()
        self._library = None
        self._shorter: dict[int, int] = {}
        self._pairs: dict[int, bool] = {}
        self._made_of: dict[int, tuple[int, int]] = {}
        if engine == "automaton":
            self.automaton = ahocorasick.Automaton()
            for token, rank in ranks.items():
                self.automaton.add_word(token.decode("latin-1"), rank)
            self.automaton.make_automaton()
            encode_piece = self.encode_piece
        elif engine == "library":
            import tiktoken

            self._library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            encode_piece = self._library._core_bpe.encode_single_piece
        else:
            raise ValueError(engine)
        self._plain = _PLAIN.findall if pattern == PATTERN else None
        self._pieces = _Pieces(encode_piece, cache)

    def merges(self, data: bytes, stop: int = 0) -> list[int]:
        """The tokens that merging in rank order leaves, done plainly, for short inputs.
        With ``stop`` 2: the last two before a merge makes them one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None or len(parts) == stop:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``, given its bytes alone; (-1, -1) if
        merging doesn't end in it."""
        known = self._made_of.get(token)
        if known is None:
            data = self.bytes_of[token]
            left = self.merges(data, stop=2)
            known = self._made_of[token] = (left[0], left[1]) if len(left) == 2 else (-1, -1)
        return known

    def _reachable(self, token: int) -> bool:
        return self._lengths[token] == 1 or self._parts(token)[0] >= 0

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two reachable tokens gives these two back.

        Undo their merges from the latest to the earliest; wherever the parts that
        then touch could merge before the merge just undone, they would have.
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is not None:
            return known
        ranks, data, lengths, before = self.ranks, self.bytes_of, self._lengths, len(self.bytes_of)
        a, b, known = left, right, True
        while True:
            joined = ranks.get(data[a] + data[b])
            if joined is not None and joined < before:
                known = False
                break
            if lengths[a] > 1 and (a > b or lengths[b] == 1):
                before, a = a, self._parts(a)[1]
            elif lengths[b] > 1:  # of equal ranks the left merge comes first
                before, b = b + 1, self._parts(b)[0]
            else:
                break
        if len(self._pairs) >= 500_000:
            self._pairs.clear()
        self._pairs[key] = known
        return known

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if none."""
        known = self._shorter.get(token)
        if known is None:
            data = self.bytes_of[token]
            known = next((self.ranks[data[:k]] for k in range(len(data) - 1, 0, -1) if data[:k] in self.ranks), -1)
            self._shorter[token] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece in the vocabulary is one token, whatever the merges say
            return [whole]
        lengths, n, marks = self._lengths, len(piece), piece.decode("latin-1")
        scan, due = self.automaton.iter_long(marks), 0  # the scan's next match begins at due

        def longest(at: int) -> int:
            nonlocal scan, due
            if at != due:
                scan = self.automaton.iter_long(marks, at)
            end, token = next(scan)
            due = end + 1
            return token

        open_at = bytearray(b"\1") * (n + 1)
        walk: list[int] = []
        at, token = 0, longest(0)
        while at < n:
            end = at + lengths[token]
            if open_at[end] and self._reachable(token) and (not walk or self._compatible(walk[-1], token)):
                walk.append(token)
                at = end
                token = longest(at) if at < n else -1
                continue
            token = self._next_shorter(token)
            while token < 0:
                open_at[at] = 0
                token = walk.pop()
                at -= lengths[token]
                token = self._next_shorter(token)
        return walk

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self._library is not None:
            return array("I", self._library.encode_ordinary(text)).tobytes()
        find = self._plain if self._plain and not _OTHER.search(text) else self.find
        return b"".join(map(self._pieces.__getitem__, find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[tuple, BytePairEncoder] = {}


def encoder(vocabulary: str, pattern: str = PATTERN, engine: str = "automaton") -> BytePairEncoder:
    """The encoder of a vocabulary file, built once in each Python worker."""
    key = (vocabulary, pattern, engine)
    if key not in _LOADED:
        _LOADED[key] = BytePairEncoder(load_ranks(tokenizer_path(vocabulary)), pattern, engine)
    return _LOADED[key]


def encode_documents(df: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str = PATTERN, text: str = "text", decoded: bool = True) -> DataFrame:
    """``df`` with ``n_tokens`` long, ``token_ids`` binary and, unless switched
    off, ``decoded`` binary (the bytes that the ids stand for). Columns of
    these names in ``df`` are replaced."""
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())] + [T.StructField("decoded", T.BinaryType())] * decoded
    names = {f.name.lower() for f in made}
    kept = [c for c in df.columns if c.lower() not in names]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*df.schema.fields, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, pattern)
        for batch in slices(batches, text, SLICE_BYTES):
            ids = [bpe.encode(t) for t in strings(batch, text)]
            more = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                more.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in kept] + more, names=kept + [f.name for f in made])

    return df.mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str = PATTERN) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_documents(docs.select("doc_id", "text"), vocabulary, pattern).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
