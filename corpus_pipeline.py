"""From raw documents to token ids in five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents, whatever these are called.

Defined results, for every stage: a null text counts as empty and a row with a null doc_id is a
document like any other, but is never learned from; empty tables give empty tables of the same columns; more columns
than those of documents go through unchanged, also those with names that operators use. Rows that share a doc_id are
documents of their own unless they are alike. Each stage's docstring says the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.llm import bpe, decontaminate, langid, simhash, toxicity
from candor.llm.common import free_name, read, spool


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that score 0.5 or more go. Labels are learned from the stage's own documents; without
    labels of both classes, and for texts without words, nothing goes. Repeated rows are judged each, and alike."""
    name = free_name(docs, "toxicity")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, name=name).where(F.col(name) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents without letters (null and empty ones too), or unlike every learned language, go; without
    labelled languages all do. Repeated rows are judged each, and alike; very long texts are read whole."""
    names = {c: f"_{k}_{c}" for k, c in enumerate(docs.columns)}  # no column can clash with those that the operator adds
    found = langid.predict(docs.withColumnsRenamed(names), langid.fit(docs), text=names["text"])
    return found.where(~F.col("rejected")).select(*[F.col(f"`{v}`").alias(c) for c, v in names.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each near-duplicate group stays, that of the smallest doc_id (null ids last), then of
    the smallest hash of the text. Rows with one doc_id but unlike texts all stay; null, empty and blank texts are one
    group; of rows that repeat id and text one stays."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold half of a benchmark item or more go, all rows that repeat them too. Null and empty
    texts, and all with an empty benchmark, stay; so does a clean text that shares the doc_id of one that goes."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token ids of the documents that are left, with digests of ids and of the decoded bytes; one row for
    each. A null or empty text has no tokens. Of other columns only doc_id, lang and source are returned."""
    made = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"))
    return made.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark_leaks),
    ("bpe", encode),
]

#: No stage's decisions are plain SQL (learned scores, fingerprints, tiles, merges); tests/llm/test_pipeline.py holds them
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
