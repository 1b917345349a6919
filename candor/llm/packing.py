"""Token-id packing into fixed-length training rows.

Documents are encoded, cut losslessly into pieces of at most ``length`` tokens,
dealt to shards by a hash of (document, piece, ids), and packed shard by shard with
best-fit-decreasing. A segment tree over residual capacities answers "the
fullest row that still has room" in log(length) steps. The number of shards
follows the bytes of the corpus, so a shard stays of one size however large
the corpus is, and no single document or source can fill one, nor the rows of one
null or repeated doc_id: their pieces are spread by what they hold. With few shards (a small
corpus) the largest may hold twice the median.

A packed row holds the id matrix row (padded with ``pad``), the cumulative
segment lengths, the position ids that restart at every segment, and for each
segment where it came from, so that the documents can be put together again.

Defined results: null and empty texts have no tokens and take no room (they are
in no row); equal lengths are packed in order of (doc_id, piece); repeated rows
are packed each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.bpe import PATTERN, encoder
from candor.llm.common import column, slices, split_count, strings

#: Bytes of text whose tokens make up one shard.
SHARD_BYTES = 12 << 20
PACKED = (
    "shard int, row int, n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, position_ids binary, "
    "segments array<struct<doc_id: bigint, piece: int, length: int>>"
)


class CapacityTree:
    """Segment tree over capacities 0..size: which of them some open row has."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.some = bytearray(2 * self.base)

    def set(self, capacity: int, there: bool) -> None:
        node = self.base + capacity
        self.some[node] = there
        node >>= 1
        while node:
            now = self.some[2 * node] | self.some[2 * node + 1]
            if self.some[node] == now:
                break
            self.some[node] = now
            node >>= 1

    def least_at_least(self, capacity: int) -> int:
        """The smallest capacity in the tree that is not under ``capacity``; -1 if none."""
        node = self.base + capacity
        if self.some[node]:
            return capacity
        while node > 1:
            if not node & 1 and self.some[node + 1]:
                node += 1
                while node < self.base:
                    node *= 2
                    node += not self.some[node]
                return node - self.base
            node >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes into ``lengths``. ``lengths`` must be in decreasing order, each 1..capacity."""
    tree, open_rows, rows = CapacityTree(capacity), {}, []
    for i, length in enumerate(lengths):
        room = tree.least_at_least(length)
        if room < 0:
            row = len(rows)
            rows.append([i])
            room = capacity
        else:
            row = open_rows[room].pop()
            if not open_rows[room]:
                tree.set(room, False)
            rows[row].append(i)
        left = room - length
        if left:
            stack = open_rows.setdefault(left, [])
            stack.append(row)
            if len(stack) == 1:
                tree.set(left, True)
    return rows


def pack_documents(docs: DataFrame, length: int = 2048, vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str = PATTERN, pad: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packed rows (see the module) of ``docs`` (doc_id, text).

    input_ids and position_ids are little-endian unsigned 32-bit, ``length``
    each; positions go on to count from 0 in the padding.
    """
    docs = docs.select("doc_id", "text")
    shards = split_count(docs.agg(F.sum(F.octet_length("text"))).first()[0], shard_bytes)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, step = encoder(vocabulary, pattern, "library"), 4 * length
        for batch in slices(batches):
            doc, piece, size, ids = [], [], [], []
            for d, t in zip(column(batch, "doc_id").to_pylist(), strings(batch), strict=True):
                whole = bpe.encode(t)
                for k, at in enumerate(range(0, len(whole), step)):
                    part = whole[at : at + step]
                    doc.append(d), piece.append(k), size.append(len(part) // 4), ids.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(size, pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "length", "ids"])

    def pack(table: pa.Table) -> pa.Table:
        order = table.select(["doc_id", "piece", "length", "ids", "shard"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids", "ascending")])
        doc, piece, size = (order.column(c).to_pylist() for c in ("doc_id", "piece", "length"))
        ids = order.column("ids")
        shard = order.column("shard")[0].as_py()
        out: dict[str, list] = {k: [] for k in ("shard", "row", "n_tokens", "n_segments", "input_ids", "cu_seqlens", "position_ids", "segments")}
        for r, row in enumerate(best_fit_decreasing(size, length)):
            cumulative = np.concatenate([[0], np.cumsum([size[i] for i in row])]).astype(np.int32)
            n = int(cumulative[-1])
            matrix = np.full(length, pad, dtype="<u4")
            matrix[:n] = np.frombuffer(b"".join(ids[i].as_py() for i in row), dtype="<u4")
            starts = np.append(cumulative[:-1], n) if n < length else cumulative[:-1]
            reset = np.zeros(length, dtype=np.int64)
            reset[starts] = starts
            positions = (np.arange(length) - np.maximum.accumulate(reset)).astype("<u4")
            for k, v in zip(out, (shard, r, n, len(row), matrix.tobytes(), cumulative.tolist(), positions.tobytes(), [{"doc_id": doc[i], "piece": piece[i], "length": size[i]} for i in row]), strict=True):
                out[k].append(v)
        return pa.table(
            [pa.array(v, t) for v, t in zip(out.values(), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("length", pa.int32())]))), strict=True)],
            names=list(out),
        )

    cut = docs.mapInArrow(pieces, "doc_id bigint, piece int, length int, ids binary")
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(pack, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the rows as Parquet, one row a sequence."""
    packed.write.mode("overwrite").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """The pieces that a table of packed rows holds: doc_id, piece, ids binary."""
    seg = F.posexplode("segments").alias("k", "seg")
    start = F.element_at("cu_seqlens", F.col("k") + 1)
    return packed.select("input_ids", "cu_seqlens", seg).select(
        F.col("seg.doc_id").alias("doc_id"), F.col("seg.piece").alias("piece"), F.substring(F.col("input_ids"), start * 4 + 1, F.col("seg.length") * 4).alias("ids")
    )
