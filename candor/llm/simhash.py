"""SimHash fingerprints and exact near-duplicate groups within a radius.

Fingerprints come from the XXH64 (seed 42) of word 3-gram shingles: a bit is 1
if it is set in more than half of them. Equal fingerprints are merged first, so
copies cost nothing later. The different fingerprints are dealt to tiles by the
population counts of their equal parts. As flipping a bit moves one count by
one, two fingerprints within the radius lie in tiles whose counts differ by the
radius at most in sum: all other pairs of tiles are skipped unseen, and the
rest are compared exactly, with numpy exclusive-or and bit counts, in blocks.
The number of parts follows the number of fingerprints, so tiles stay small.

A tile gives out a spanning forest of its links, not all pairs, which loses no
component. Components are then found by large-star/small-star rounds over
(distinct fingerprint) edges, each round written to the shared folder.

Defined results: null, empty and blank texts have fingerprint zero, which links
like any other; fewer than 3 words are one shingle; a null doc_id gets a
component like any row but is never one's name unless nothing else is there;
repeated rows stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.common import column, slices, split_count, spool, strings
from candor.llm.rowmarks import FILE, ROW, bitmaps, from_files, marked, place

SEED = 42
#: Fingerprints of a tile that are compared with a tile at once.
BLOCK = 2048


def shingle_hashes(text: str, size: int = 3) -> list[int]:
    """XXH64 of each shingle of ``size`` words, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[: -size].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """Bits set in over half of the hashes; zero without any."""
    if not hashes:
        return 0
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):  # bounded memory for long texts
        part = np.array(hashes[k : k + (1 << 15)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, size: int = 3, text: str = "text", name: str = "simhash") -> DataFrame:
    """``docs`` without the text, with a long ``name``: the 64 bits, read as signed."""
    kept = [c for c in docs.columns if c.lower() not in {name.lower(), text.lower()}]
    df = docs.select(*[F.col(f"`{c}`") for c in [*kept, text]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = np.array([fingerprint(shingle_hashes(t, size)) for t in strings(batch, text)], dtype="<u8")
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in kept] + [pa.array(found.view("<i8"))], names=[*kept, name])

    return df.mapInArrow(run, T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(name, T.LongType())]))


def part_counts(prints: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of the ``parts`` equal parts of each fingerprint (uint64)."""
    width = np.uint64(64 // parts)
    mask = np.uint64((1 << (64 // parts)) - 1) if parts > 1 else np.uint64(2**64 - 1)
    return np.stack([np.bitwise_count((prints >> (np.uint64(k) * width)) & mask) for k in range(parts)], 1).astype(np.int64)


def tile_numbers(counts: np.ndarray, parts: int) -> np.ndarray:
    base = 64 // parts + 1
    out = np.zeros(len(counts), dtype=np.int64)
    for k in range(parts):
        out = out * base + counts[:, k]
    return out


def offsets(parts: int, radius: int) -> np.ndarray:
    """Differences of counts between two tiles that may hold a pair, one of each pair of opposites, zero left out."""
    some = [d for d in product(range(-radius, radius + 1), repeat=parts) if 0 < sum(map(abs, d)) <= radius and next(x for x in d if x) > 0]
    return np.array(sorted(some), dtype=np.int64).reshape(-1, parts)


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Spanning edges of the links between two arrays (or within one), by exact comparison in blocks."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for i in range(0, len(a), BLOCK):
        for j in range(i if same else 0, len(b), BLOCK):
            near = np.bitwise_count(a[i : i + BLOCK, None] ^ b[None, j : j + BLOCK]) <= radius
            for x, y in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
                x, y = int(a[i + x]), int(b[j + y])
                if x != y:
                    p, q = root(x), root(y)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        edges.append((x, y))
    return edges


def links(prints: DataFrame, radius: int = 2, name: str = "simhash", tile: int = 512) -> DataFrame:
    """(a, b): spanning edges, tile by tile, of the graph that joins different fingerprints within ``radius`` bits."""
    distinct = prints.select(F.col(name).alias("p")).distinct()
    distinct = spool(distinct, "fingerprints")
    n = distinct.count()
    # Tiles that hold most fingerprints: about so many values of a part's count, to the power of the parts.
    parts = next((k for k, tiles in ((1, 10), (2, 60), (4, 1500)) if n <= tile * tiles), 8)
    chunks = split_count(n, tile * 200_000)  # only with tens of billions of fingerprints do tiles need splitting
    moves = offsets(parts, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 12):
                p = column(batch, "p").slice(k, 1 << 12).to_numpy().view("<u8")
                counts = part_counts(p, parts)
                home = tile_numbers(counts, parts)
                to = counts[:, None, :] + moves[None]
                fits = ((to >= 0) & (to <= 64 // parts)).all(2)
                row, _ = np.nonzero(fits)
                guest = tile_numbers(to[fits], parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([home, guest])), pa.array(np.concatenate([p, p[row]]).view("<i8")), pa.array(np.concatenate([np.ones(len(home), bool), np.zeros(len(guest), bool)]))], names=["tile", "p", "home"]
                )

    dealt = distinct.mapInArrow(deal, "tile bigint, p bigint, home boolean")
    mine = F.pmod(F.xxhash64("p"), F.lit(chunks)).cast("int")
    if chunks > 1:  # each chunk of a tile meets every chunk of it once, as (home chunk, other chunk)
        every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
        homes = dealt.where("home").select("tile", "p", "home", mine.alias("x"), every.alias("y"))
        others = dealt.select("tile", "p", F.lit(False).alias("home"), every.alias("x"), mine.alias("y"))
        dealt = homes.unionByName(others)
    else:
        dealt = dealt.select("tile", "p", "home", F.lit(0).alias("x"), F.lit(0).alias("y"))

    def compare(table: pa.Table) -> pa.Table:
        p, home = table.column("p").to_numpy().view("<u8"), table.column("home").to_numpy()
        a, b = np.sort(p[home]), np.sort(p[~home])
        edges = forest(a, a, radius, True) if chunks == 1 else []
        if len(a) and len(b):
            edges += forest(a, b, radius, False)
        both = np.array(edges, dtype="<u8").reshape(-1, 2).view("<i8")
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return dealt.groupBy("tile", "x", "y").applyInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each component, by large-star and small-star in turn; an error if ``rounds`` are too few."""
    edges = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = spool(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """One row per document: doc_id, simhash long, fingerprint string, component_id."""
    prints = spool(with_fingerprints(docs.select("doc_id", "text"), size), "prints")
    groups = prints.groupBy("simhash").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(groups, radius))
    placed = groups.join(roots, groups["simhash"] == roots["node"], "left").select("simhash", "first_id", F.coalesce("root", "simhash").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.join(named, "root").select("simhash", "component_id")
    return prints.join(classes, "simhash").select("doc_id", "simhash", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """``docs`` (with doc_id, text) without the rows that another row of their group stands for: the one of the smallest
    doc_id stays (null ids last), of rows with one doc_id the one whose text has the smallest hash, of equal texts under
    one id the first by the other columns, of rows that repeat all columns the first by file and place. What goes is marked
    in bitmaps of the files' rows, so no text moves; see ``rowmarks``."""
    docs = from_files(docs)
    t = F.coalesce(docs["text"], F.lit(""))
    rest = F.xxhash64(*[docs[f"`{c}`"].cast("string") for c in docs.columns])
    rows = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("text"), F.xxhash64(t).alias("_hash"), rest.alias("_rest"), *place(docs))
    prints = spool(with_fingerprints(rows, size), "prints")
    placed = spool(_placed(prints, radius), "placed")
    name = F.struct(F.col("_id").isNull(), "_id", "_hash", "_rest", FILE, ROW)
    # Of one fingerprint, then of the whole group: a group's first row is found by partial sums.
    first = prints.groupBy("simhash").agg(F.min(name).alias("first")).join(placed, "simhash")
    kept = first.groupBy("root").agg(F.min("first").alias("kept"))
    # Rows that stay are few beside large groups; a row goes unless it is one of them, by file and place.
    stay = spool(kept.select(F.col(f"kept.{FILE}").alias(FILE), F.col(f"kept.{ROW}").alias(ROW)), "stay")
    marks = bitmaps(stay, {"_stays": F.lit(True)})
    return marked(docs, marks, ["_stays"], "_stays", [F.col(f"`{c}`") for c in docs.columns])


def _placed(prints: DataFrame, radius: int) -> DataFrame:
    """(simhash, root) of every different fingerprint."""
    distinct = prints.select("simhash").distinct()
    roots = components(links(distinct, radius))
    return distinct.join(roots, distinct["simhash"] == roots["node"], "left").select("simhash", F.coalesce("root", "simhash").alias("root"))
