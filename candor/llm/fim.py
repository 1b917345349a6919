"""Fill-in-the-middle: texts cut between units, rearranged around a middle, and rebuilt.

A unit grammar is a list of boundaries, each a pair of classes of neighbouring characters: what ends a unit and what may
follow it. It becomes one zero-width regular expression of lookbehinds and lookaheads, so Spark's ``split`` cuts there and
loses no character: the pieces joined are the text. Everything is column expressions, so a text never leaves its row.

Defined results: null and empty texts have no units, form ``plain`` and no middle (``split`` would give one empty piece, so
they are set apart); a text that holds a marker stays plain; texts of one unit are cut before or after it; a null id hashes
as no digits; repeated rows are cut alike; very long texts are one array of pieces; other columns don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = r"[\s\S]"
#: Unit grammars: (class that a unit ends with, class that may follow), read as neighbouring characters.
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    "lines": ((r"\n", ANY),),
    "paragraphs": ((r"\n\n", r"[^\n]"),),
    "words": ((r"\S", r"\s"),),  # a word with the white space before it
    "sentences": ((r"[.!?]", r"\s"),),
}


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        if len({self.prefix, self.suffix, self.middle}) < 3 or not all(re.fullmatch(r"<[^<>]+>", m) for m in (self.prefix, self.suffix, self.middle)):
            raise ValueError("markers must be three different names in angle brackets, so that none can begin within another")


def boundary(grammar: str | tuple[tuple[str, str], ...]) -> str:
    """The zero-width regular expression that matches between units, never at the ends of a text."""
    pairs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return "|".join(f"(?<={before})(?={after})" for before, after in pairs)


def units(text: Column, grammar: str | tuple[tuple[str, str], ...] = "lines") -> Column:
    """The units of a text as an array; none for null and empty texts."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text from an output and its form. Pieces hold no marker and none can arise across a join, so the first one found is the real one."""
    quoted = {k: re.escape(v) for k, v in vars(markers).items()}
    first, second = {"psm": ("prefix", "suffix"), "spm": ("suffix", "prefix")}, {}
    for kind, (a, b) in first.items():
        head = F.split(F.substr(output, F.lit(len(getattr(markers, a)) + 1)), quoted[b], 2)
        tail = F.split(head[1], quoted["middle"], 2)
        own = {a: head[0], b: tail[0], "middle": tail[1]}
        second[kind] = F.concat(own["prefix"], own["middle"], own["suffix"])
    return F.when(form == "plain", output).when(form == "psm", second["psm"]).otherwise(second["spm"])


def transform(docs: DataFrame, grammar: str | tuple[tuple[str, str], ...] = "lines", seed: int = 7, rate: int = 100, spm: int = 50, markers: Markers = Markers(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output. ``rate`` percent of the texts are cut,
    ``spm`` percent of these suffix first. Cuts come from the hash of seed and id alone, so a rerun on other executors
    cuts alike."""
    marks = (markers.prefix, markers.suffix, markers.middle)
    own = docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("_t"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("_d", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    cut = own.withColumn("_d", digest).withColumn("_u", units(F.col("_t"), grammar)).withColumn("n", F.size("_u").cast("long"))
    cut = cut.withColumns({"_x": h[0] % (F.col("n") + 1), "_y": h[1] % (F.col("n") + 1)}).withColumns({"_a": F.least("_x", "_y").cast("int"), "_b": F.greatest("_x", "_y").cast("int")})
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("_t", F.lit(m))
    form = F.when((F.col("_t") == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    joined = lambda start, length: F.array_join(F.slice("_u", start, length), "")
    cut = cut.withColumn("form", form).withColumns(
        {"_p": joined(F.lit(1), F.col("_a")), "_m": joined(F.col("_a") + 1, F.col("_b") - F.col("_a")), "_s": joined(F.col("_b") + 1, F.size("_u") - F.col("_b"))}
    )
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "plain", F.col("_t")).when(F.col("form") == "psm", F.concat(p, F.col("_p"), s, F.col("_s"), m, F.col("_m"))).otherwise(F.concat(s, F.col("_s"), p, F.col("_p"), m, F.col("_m")))
    chars = lambda c: F.when(F.col("form") != "plain", F.char_length(c).cast("long"))
    return cut.select("doc_id", "n", "form", chars("_p").alias("prefix_chars"), chars("_m").alias("middle_chars"), output.alias("output"))


def digests(docs: DataFrame) -> DataFrame:
    """``transform`` with hashes of the output and of the text rebuilt from it."""
    made = transform(docs)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
