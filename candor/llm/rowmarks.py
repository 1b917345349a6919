"""Rows of file tables, named by their file and place, and sets of such rows as bitmaps.

A decision on rows (drop, keep, scan) is a bitmap for every 32,768 rows of a file, made by ``bitmap_construct_agg``; whoever
reads the table looks its rows up by file and bucket, so that texts stay where they are and never meet a list in a shuffle.
Bitmaps are broadcast in batches of files of at most ``BATCH`` bytes each: one batch for small tables, more for larger ones,
each a scan of its own files only. A row is named even if others repeat it in every column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.common import split_count, spool

FILE, ROW = "_file", "_row"
#: Bytes of bitmaps that one scan gets by broadcast, and of one bitmap with its name.
BATCH, BITMAP = 64 << 20, 4096 + 256


def from_files(df: DataFrame) -> DataFrame:
    """``df`` if its rows are those of files, else a copy of it in the shared folder."""
    try:
        df.metadataColumn("_metadata")
        df.select(df.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return spool(df, "rows")
    return df


def place(df: DataFrame) -> list[Column]:
    """(file, row) of each row of a table of files, as ``FILE`` and ``ROW``."""
    meta = df.metadataColumn("_metadata")
    return [meta["file_path"].alias(FILE), meta["row_index"].alias(ROW)]


def bitmaps(places: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """Bitmaps of ``places`` (FILE, ROW and what the conditions ask for), one column for each condition of ``sets``; spooled."""
    at = F.bitmap_bit_position(F.col(ROW) + 1)
    made = places.groupBy(FILE, F.bitmap_bucket_number(F.col(ROW) + 1).alias("_bucket")).agg(*[F.bitmap_construct_agg(F.when(on, at)).alias(name) for name, on in sets.items()])
    return spool(made, "bitmaps")


def marked(df: DataFrame, marks: DataFrame, sets: list[str], keep: str, columns: list[Column]) -> DataFrame:
    """``columns`` of the rows of ``df``, a table of files, for which the SQL condition ``keep`` holds; it can ask for each of
    ``sets`` as a boolean, false for rows that no bitmap names. ``columns`` are of ``df``, or of ``sets``."""
    batches = split_count(marks.count() * BITMAP * len(sets), BATCH)
    own = [f"_c{k}" for k in range(len(df.columns))]
    meta = df.metadataColumn("_metadata")
    rows = df.select(*[df[f"`{c}`"].alias(o) for c, o in zip(df.columns, own, strict=True)], meta["file_path"].alias(FILE), (meta["row_index"] + 1).alias(ROW))
    parts = []
    for k in range(batches):
        mine = F.pmod(F.xxhash64(FILE), F.lit(batches)) == k
        some, bits = (rows, marks) if batches == 1 else (rows.where(mine), marks.where(mine))
        bits = bits.select(F.col(FILE).alias("_f"), F.col("_bucket").alias("_b"), *sets)
        found = some.join(F.broadcast(bits), (F.col(FILE) == F.col("_f")) & (F.bitmap_bucket_number(ROW) == F.col("_b")), "left")
        at = f"bitmap_bit_position({ROW})"
        on = {s: F.expr(f"coalesce(getbit(cast(conv(hex(substring({s}, cast({at} div 8 as int) + 1, 1)), 16, 10) as int), cast({at} % 8 as int)) = 1, false)") for s in sets}
        parts.append(found.select(*own, *[c.alias(s) for s, c in on.items()]).where(keep))
    whole = reduce(DataFrame.unionByName, parts)
    return whole.withColumnsRenamed(dict(zip(own, df.columns, strict=True))).select(*columns)


def without(df: DataFrame, places: DataFrame) -> DataFrame:
    """``df``, a table of files, without the rows that ``places`` (FILE, ROW) names."""
    marks = bitmaps(places, {"_gone": F.lit(True)})
    return marked(df, marks, ["_gone"], "not _gone", [F.col(f"`{c}`") for c in df.columns])
