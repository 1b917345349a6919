"""File sources: CSV and zipped CSV, labelled datasets by manifest, the store registry, price history, pictures."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header and quoted line ends; a byte order mark is left out of the first name."""
    df = spark.read.option("multiLine", True).option("escape", '"').csv(path, header=True, schema=schema)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_zipped_csv(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    """The one CSV of a zip archive, or of each of a folder's archives; more or fewer than one is an error. Archives are
    read by the workers, line by line; only the header comes to the driver."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                names, lines = _csv_lines(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([len(names)]), pa.array([next(lines, []) if len(names) == 1 else []], pa.list_(pa.string()))], names=["n", "head"])

    heads = files.mapInArrow(header, "n bigint, head array<string>").distinct().limit(2).collect()
    if any(r["n"] != 1 for r in heads):
        raise ValueError("an archive has no or several CSV files, not one")
    if len(heads) > 1:
        raise ValueError("the archives have different headers")
    head = [c.strip() for c in heads[0]["head"]]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(c, pa.string()) for c in head])
        for batch in batches:
            for data in batch.column(0):
                lines = _csv_lines(data.as_py())[1]
                next(lines, None)
                while part := list(itertools.islice(lines, rows)):
                    # A short line lacks its last cells, a long one has more than the header names: both are rows.
                    whole = [r for r in part if r]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] if k < len(r) else None for r in whole], pa.string()) for k in range(len(head))], schema=kind)

    return files.mapInArrow(cells, ", ".join(f"`{c}` string" for c in head))


def _csv_lines(data: bytes) -> tuple[list[str], Iterator[list[str]]]:
    """Names of an archive's CSV files, and the lines of the first."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = [n for n in z.namelist() if n.lower().endswith(".csv")]
    return names, csv.reader(io.TextIOWrapper(z.open(names[0]), "utf-8-sig", newline="")) if names else iter(())


def imported_reviews(raw: DataFrame, text_names: tuple[str, ...] = ("text", "review_text")) -> DataFrame:
    """(text, rating, label) from either name of the text column; blank texts are left out."""
    from candor.functions import text as tx

    have = [F.col(c) for c in text_names if c in raw.columns]
    label = F.col("label") if "label" in raw.columns else F.lit(None).cast("string")
    rating = tx.imported_rating(F.col("rating").try_cast("double")) if "rating" in raw.columns else F.lit(None).cast("int")
    return raw.select(tx.clean(F.coalesce(*have)).alias("text"), rating.alias("rating"), label.alias("label")).where("text is not null")


def labelled(spark: SparkSession, manifest: Mapping[str, Mapping]) -> DataFrame:
    """Rows (dataset, role, text, label) of the datasets that a manifest lists: path, format, text_col, label_col, label_map, role."""
    out = None
    for name, m in manifest.items():
        df = read_csv(spark, m["path"]) if m.get("format", "parquet") == "csv" else spark.read.parquet(m["path"])
        table = F.create_map(*[F.lit(x) for k, v in m["label_map"].items() for x in (str(k), int(v))])
        rows = df.select(F.lit(name).alias("dataset"), F.lit(m.get("role", "train")).alias("role"), F.col(m["text_col"]).alias("text"), F.try_element_at(table, F.col(m["label_col"]).cast("string")).alias("label")).where("label is not null and trim(text) <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "dataset string, role string, text string, label int")


def store_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry file {name: {host, categories, brand?, enabled?}} as a table."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string, struct<host: string, search: string, categories: array<string>, brand: string, enabled: boolean>>"
    return text.select(F.posexplode(F.from_json("value", kind)).alias("ordinal", "store", "s")).select("store", "ordinal", "s.host", "s.search", "s.categories", "s.brand", F.coalesce("s.enabled", F.lit(True)).alias("enabled"))


def price_history(spark: SparkSession, path: str) -> DataFrame:
    """Stored observations (url, observed_at, price); empty if there is no table yet."""
    kind = "url string, observed_at timestamp, price double"
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(kind).parquet(path).select("url", "observed_at", "price")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """Pictures of a sound size with their path."""
    return spark.read.format("binaryFile").load(path).where("length > 100 and length <= 8388608").select("path", "content")
