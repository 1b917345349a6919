"""URL rules through a blocked Bloom filter and an exact hash join, in DataFrame functions only.

A list holds canonical URLs, (host, path) with a verdict; an entry stands for
its host with all subdomains and every path that starts with its own. A URL is
expanded to the entries that could fit it: each suffix of its host that is
listed (only those with as many labels as some listed host) with each
prefix of its path of a length that this host's entries have. Every expansion is probed
in a blocked Bloom filter: one 64-bit word per block, in which an entry sets a
few bits, so a probe reads one word. What the filter passes goes on to an exact
hash join with the list, which removes the false positives; nothing that is
listed is ever lost. The longest fitting entry decides: longest host first
among equal total lengths, then ``allow``.

The filter is a join on the block number, broadcast only if its measured size
is under ``broadcast_bytes``; else Spark shuffles both sides.

Defined results: a null url, or one without ``://``, has empty host and path
and no rule; no rule means ``allow``; an empty list lets everything pass;
repeated pages are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a block's word that an entry sets, and entries per block (10 bits each or more).
PROBES, PER_BLOCK = 4, 5
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a list of canonical URLs."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path (see the module)."""
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return pages.withColumns({"host": ascii_lower(host), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def mask_of(key: Column) -> Column:
    """The bits of one entry: PROBES places from one hash."""
    h = F.xxhash64(key, F.lit("mask"))
    out = F.lit(0).cast("long")
    for k in range(PROBES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return out


def bloom(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """(block, word) rows of the blocked filter, and its number of blocks."""
    blocks = max(1, -(-n // PER_BLOCK))
    marked = keys.select(block_of(F.col(key), blocks).alias("block"), mask_of(F.col(key)).alias("mask"))
    return marked.groupBy("block").agg(F.bit_or("mask").alias("word")), blocks


def judge(pages: DataFrame, rules: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule (host and path of the entry that decides) and verdict."""
    listed = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy(ascii_lower(F.col("host")).alias("host"), "path")
        .agg(F.min("verdict").alias("verdict"))
        .select(F.concat("host", "path").alias("rule"), "verdict", F.length("path").alias("n"), F.length("host").alias("h"))
    )
    known = listed.agg(F.count("*").alias("c"), F.sum(F.octet_length("rule") + 48).alias("bytes")).first()
    parsed = with_parts(pages.select("page_id", "url")).select("page_id", "url", "host", "path")
    if not known["c"]:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    filter_, blocks = bloom(listed, "rule", known["c"])
    if blocks * 16 <= broadcast_bytes:
        filter_ = F.broadcast(filter_)
    # Listed hosts with the lengths of their paths, and how many labels listed hosts have: what a URL is expanded to.
    hosts = listed.groupBy(F.left("rule", "h").alias("suffix")).agg(F.collect_set("n").alias("lengths"))
    sizes = [r["k"] for r in hosts.select(F.size(F.split("suffix", r"\.")).alias("k")).distinct().collect()]
    if known["bytes"] <= broadcast_bytes:
        listed, hosts = F.broadcast(listed), F.broadcast(hosts)
    # Each different (host, path) is judged once; the pages of a hot site don't meet in one task.
    urls = parsed.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    fitting = F.filter(F.array(*[F.lit(k) for k in sorted(sizes)]), lambda k: k <= F.size(labels))
    suffixes = F.transform(fitting, lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    ends = urls.select("host", "path", F.explode(suffixes).alias("suffix")).join(hosts, "suffix")
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = ends.select("host", "path", F.explode(F.transform(prefixes, lambda p: F.concat("suffix", p))).alias("key"))
    passed = tried.withColumn("block", block_of(F.col("key"), blocks)).join(filter_, "block").where(F.col("word").bitwiseAND(mask_of(F.col("key"))) == mask_of(F.col("key")))
    exact = passed.select("host", "path", "key").join(listed, F.col("key") == F.col("rule"))
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "h", F.when(F.col("verdict") == "allow", 1).otherwise(0))).alias("best"))
    found = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    joined = parsed.join(found, (parsed["host"] == found["_h"]) & (parsed["path"] == found["_p"]), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), u AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT DISTINCT host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, verdict) AS r
  FROM (SELECT DISTINCT host, path FROM u) AS x JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
FROM u LEFT JOIN fit ON u.host = fit.host AND u.path = fit.path AND fit.r = 1
"""
