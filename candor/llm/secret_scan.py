"""Secret scans over the history of files, by a ledger of what was read before.

Every version of a path is named by the SHA-256 of its content. The ledger is a table of (blob, kind, rule version, spans):
what a rule of one version finds in one content never changes, so a scan reads only pairs of blob and rule version that the
ledger lacks, each blob once however many paths and versions hold it, and appends what it found, empty results too. Findings
then go back to all versions by a join on the blob. Texts never move: which row of the versions stands for a blob is a
bitmap of rows (see ``rowmarks``), and the task that reads the file scans it.

An append is committed as a whole by Spark, so a lost executor repeats tasks and a lost driver leaves the ledger as it was;
of pairs that two runs scanned at once one is read. A new version of a rule is scanned anew and older findings are not read.

Defined results: null and empty texts are one blob without findings; rows with a null path and repeated rows are versions
like any other; spans count code points, the end exclusive, so text beyond the basic plane counts one each; very long texts
are scanned whole; an empty table gives no rows and appends nothing; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.common import column, slices, spool, strings
from candor.llm.rowmarks import FILE, ROW, bitmaps, from_files, marked, place


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that don't overlap; those whose ``group`` is shorter than ``least`` are dropped afterwards."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False  # ASCII letters in either case

    def spans(self) -> re.Pattern[str]:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: Kinds in the order in which spans of one start are listed. The first three are the base kinds.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=6, group=2, any_case=True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", 1, r"[0-9a-f]{24,}", least=24),  # a maximal run either way, without a match for each short one
)
#: Kinds with a stated form of their own: key blocks, signed web tokens, addresses that hold a password.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("address", 1, r"[a-z]{2,12}://[A-Za-z0-9_.-]{1,64}:[^\s:/@]{6,64}@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE

LEDGER = "blob string, kind string, version int, spans array<struct<start: bigint, stop: bigint>>"


def found_spans(text: str, rule: Rule) -> list[tuple[int, int]]:
    return [m.span() for m in rule.spans().finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark, ledger: str) -> DataFrame:
    """What was scanned so far; empty before the first scan."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def current(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The ledger's rows of the rules' present versions."""
    keep = [f"{r.kind}:{r.version}" for r in rules]
    return ledger.where(F.concat_ws(":", "kind", "version").isin(keep))


def named_versions(versions: DataFrame, path: str, text: str) -> DataFrame:
    """(path, blob, FILE, ROW) of every version, spooled."""
    return spool(versions.select(versions[f"`{path}`"].alias("path"), content_address(versions[f"`{text}`"]).alias("blob"), *place(versions)), "versions")


def extend_ledger(versions: DataFrame, named: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text: str = "text") -> None:
    """Scan what the ledger lacks of ``versions``, a table of files whose rows ``named`` lists, and append it."""
    spark = versions.sparkSession
    bit = {r.kind: 1 << k for k, r in enumerate(rules)}
    code = F.element_at(F.create_map(*[F.lit(x) for kv in bit.items() for x in kv]), F.col("kind"))
    # Rules scanned of each blob, as bits; of the same pair scanned twice one counts.
    done = current(read_ledger(spark, ledger), rules).groupBy("blob").agg(F.bit_or(code).alias("done"))
    blobs = named.groupBy("blob").agg(F.min(F.struct(FILE, ROW)).alias("at"))
    every = sum(bit.values())
    needs = blobs.join(done, "blob", "left").select("at.*", (F.lit(every) - F.coalesce("done", F.lit(0))).alias("need")).where("need > 0")
    sets = {f"_need{k}": F.col("need").bitwiseAND(1 << k) > 0 for k in range(len(rules))}
    marks = bitmaps(needs, sets)
    if marks.isEmpty():
        return
    need = total_bits([F.col(s).cast("int") * (1 << k) for k, s in enumerate(sets)])
    own = F.coalesce(versions[f"`{text}`"], F.lit(""))
    rows = marked(versions.select(own.alias("text")), marks, list(sets), " or ".join(sets), [content_address(F.col("text")).alias("blob"), F.col("text"), need.alias("need")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            blob, kind, version, spans = [], [], [], []
            for b, t, n in zip(column(batch, "blob").to_pylist(), strings(batch), column(batch, "need").to_pylist(), strict=True):
                for k, rule in enumerate(rules):
                    if n >> k & 1:
                        blob.append(b)
                        kind.append(rule.kind)
                        version.append(rule.version)
                        spans.append([{"start": x, "stop": y} for x, y in found_spans(t, rule)])
            yield pa.RecordBatch.from_arrays([pa.array(blob, pa.string()), pa.array(kind, pa.string()), pa.array(version, pa.int32()), pa.array(spans, SPANS)], names=["blob", "kind", "version", "spans"])

    rows.mapInArrow(run, LEDGER).write.mode("append").parquet(ledger)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def total_bits(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each version: path, blob, spans array<struct<start, place, kind, stop>>, by start, then by the order of
    the rules. ``ledger`` is a folder that executors share; it is created by the first scan."""
    versions = from_files(versions)
    named = named_versions(versions, path, text)
    extend_ledger(versions, named, ledger, rules, text)
    place_of = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)]), F.col("kind"))
    hits = current(read_ledger(versions.sparkSession, ledger), rules).where(F.size("spans") > 0)
    one = hits.groupBy("blob", "kind").agg(F.first("spans").alias("spans"))  # equal wherever a pair was scanned twice
    marks = one.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place_of.alias("place"), F.col("kind"), s["stop"].alias("stop"))).alias("s"))
    found = marks.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans"))  # one entry a rule
    # A blob of very many versions: its few findings meet them in a join that is split where it is skewed.
    return named.join(found, "blob", "left").select("path", "blob", F.coalesce("spans", F.array()).alias("spans"))


def digests(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``scan`` of documents with counts of the base kinds, the hash of their spans, and all spans as text."""
    base = [r.kind for r in BASE]
    found = scan(docs, ledger, rules)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in base], F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "blob"
    )
