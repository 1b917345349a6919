"""Queries on pages, values, dates and labels, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.functions import dates, identifiers, urls
from candor.functions import text as tx
from candor.operators import extract, labels
from candor.sources import tables as src

HOST_SQL = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
PATH_SQL = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
UNESCAPED = lambda x: f"replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&')"
CLEAN = lambda x: rf"nullif(trim(regexp_replace({x}, '\s+', ' ', 'g')), '')"


def page_heading_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "pages").select("page_id", extract.heading("html").alias("heading"))


_PICK = lambda tag: CLEAN(UNESCAPED(rf"regexp_replace(regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', ' ', 'g')"))
HEADING = f"SELECT page_id, coalesce(CASE WHEN length({_PICK('h1')}) >= 6 THEN {_PICK('h1')} END, CASE WHEN length({_PICK('title')}) >= 6 THEN {_PICK('title')} END) AS heading FROM pages"


VISIBLE_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script\b.*?</script|style\b.*?</style|noscript\b.*?</noscript)\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


def page_wall_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a made-up status by id; some texts begin with the words of a wall or are cut short."""
    k = F.col("page_id")
    status = F.when(k % 17 == 0, 403).when(k % 23 == 0, 500).when(k % 29 == 0, 404).otherwise(200)
    lead = F.when(k % 5 == 0, "Please log in to continue. ").when(k % 7 == 0, "Robot check: enter the characters you see. ").otherwise("")
    text = F.concat(lead, F.when(k % 2 == 0, F.left(extract.page_text("html"), F.lit(700))).otherwise(extract.page_text("html")))
    return src.table(spark, sf_dir, "pages").select("page_id", F.coalesce(extract.wall(status, text), F.lit("open")).alias("wall"))


WALL = rf"""
WITH v AS (SELECT page_id, {VISIBLE_SQL} AS v, CASE WHEN page_id % 17 = 0 THEN 403 WHEN page_id % 23 = 0 THEN 500 WHEN page_id % 29 = 0 THEN 404 ELSE 200 END AS status FROM pages),
t AS (SELECT page_id, status, left(CASE WHEN page_id % 5 = 0 THEN 'Please log in to continue. ' WHEN page_id % 7 = 0 THEN 'Robot check: enter the characters you see. ' ELSE '' END || CASE WHEN page_id % 2 = 0 THEN left(v, 700) ELSE v END, 2500) AS t FROM v)
SELECT page_id, CASE WHEN regexp_matches(lower(t), 'captcha|access denied|are you a robot|unusual traffic|verify you are human|robot check|enter the characters you see|request blocked|pardon our interruption|checking your browser') AND length(t) < 2500 THEN 'blocked'
  WHEN status IN (401, 403, 429) THEN 'blocked' WHEN status >= 400 THEN 'http_' || status
  WHEN regexp_matches(lower(left(t, 600)), '\b(?:sign in|log in|login)\b.{{0,60}}\b(?:to continue|to view|to see|required)\b') AND length(t) < 900 THEN 'login' ELSE 'open' END AS wall FROM t
"""


def page_link_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as links of a listing, with status, address, markup and listing made by id so that every rule is met."""
    k = F.col("page_id")
    tag = lambda t: F.regexp_extract("html", rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1)
    status = F.when(k % 13 == 0, 404).when(k % 11 == 0, 503).when(k % 31 == 0, 418).when(k % 37 == 0, 302).when(k % 41 == 0, 202).otherwise(200)
    site = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    final = F.when(k % 19 == 0, F.concat(site, F.lit("/"))).when(k % 17 == 0, F.concat(site, F.lit("/search/x?q=1"))).otherwise(F.col("url"))
    title = F.when(k % 23 == 0, "Just a moment...").when(k % 29 == 0, "Oops! Page not found").otherwise(tag("title"))
    listing = F.when(k % 7 == 0, "Buy Quartz Lantern Kettle 2l online").when(k % 7 == 1, F.lit(None).cast("string")).otherwise(tag("title"))
    names = F.when(k % 14 == 0, F.array(F.lit("quartz lantern"))).otherwise(F.array().cast("array<string>"))
    p = src.table(spark, sf_dir, "pages")
    return p.select("page_id", extract.link_state(status, "url", final, title, F.lit(None).cast("string"), tag("h1"), names, k % 3 == 0, listing).alias("s")).select("page_id", "s.state", "s.reason")


_TAG = lambda t: f"regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1)"
_BARE = lambda u: f"regexp_replace({PATH_SQL.replace('url', u)}, '/+$', '')"
_NAMED = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('buy', 'online', 'price', 'best', 'india', 'offers', 'with', 'and', 'the', 'for', 'new', 'from', 'free', 'delivery'))"
_VERIFY = "captcha|robot check|are you a (?:human|robot)|access denied|just a moment|attention required|security check|unusual traffic|verify you are|request blocked|forbidden"
_MISSING = r"\b(?:404|page not found|not found|page (?:does ?n[o'']t|does not) exist|no longer (?:exists?|available on)|(?:can['' ]?t|could ?n[o'']t|cannot) (?:find|be found)|looking for (?:is )?(?:not|no longer)|link (?:is )?(?:broken|expired)|oops|something went wrong|product (?:is )?(?:removed|discontinued|not found))\b"
_LIST = "/(?:search|s|c|category|categories|collections?|shop|browse|list|listing|catalog|results)(?:/|$)"
LINK = rf"""
WITH a AS (SELECT page_id AS k, url, CASE WHEN page_id % 13 = 0 THEN 404 WHEN page_id % 11 = 0 THEN 503 WHEN page_id % 31 = 0 THEN 418 WHEN page_id % 37 = 0 THEN 302 WHEN page_id % 41 = 0 THEN 202 ELSE 200 END AS status,
  CASE WHEN page_id % 19 = 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' WHEN page_id % 17 = 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/search/x?q=1' ELSE url END AS landed,
  CASE WHEN page_id % 23 = 0 THEN 'Just a moment...' WHEN page_id % 29 = 0 THEN 'Oops! Page not found' ELSE {_TAG("title")} END AS title, {_TAG("h1")} AS h1,
  CASE page_id % 7 WHEN 0 THEN 'Buy Quartz Lantern Kettle 2l online' WHEN 1 THEN '' ELSE {_TAG("title")} END AS listing, CASE WHEN page_id % 14 = 0 THEN 'quartz lantern' ELSE '' END AS named, page_id % 3 = 0 AS declared FROM pages),
b AS (SELECT *, {_BARE("url")} <> {_BARE("landed")} AS moved, list_distinct({_NAMED("title || ' ' || h1 || ' ' || named")}) AS seen, len({_NAMED("title || ' ' || h1")}) AS headline FROM a),
w AS (SELECT k, i, w FROM (SELECT k, generate_subscripts({_NAMED("listing")}, 1) AS i, unnest({_NAMED("listing")}) AS w FROM b)),
w1 AS (SELECT k, w, min(i) AS i, regexp_matches(w, '^\d+(?:\.\d+)?[a-z]{{0,3}}$') AS size FROM w GROUP BY k, w),
w2 AS (SELECT *, bool_and(size) OVER (PARTITION BY k) AS sizes, count(*) FILTER (NOT size) OVER (PARTITION BY k ORDER BY i) AS r FROM w1),
want AS (SELECT k, list(w) AS ws FROM w2 WHERE sizes OR NOT size AND r <= 3 GROUP BY k),
c AS (SELECT b.*, coalesce(ws, []) AS ws, len(list_intersect(coalesce(ws, []), seen)) AS shared FROM b LEFT JOIN want USING (k)),
r AS (SELECT k, CASE WHEN status IN (404, 410) THEN 'not found' WHEN status IN (202, 401, 403, 407, 429) OR status >= 500 THEN 'refused' WHEN status >= 400 THEN 'rejected' WHEN status >= 300 THEN 'unexpected answer'
  WHEN moved AND trim({PATH_SQL.replace("url", "landed")}, '/') = '' AND trim({PATH_SQL}, '/') <> '' THEN 'redirected to the front page'
  WHEN moved AND (regexp_matches(lower({PATH_SQL.replace("url", "landed")}), '{_LIST}') OR contains(regexp_extract(landed, '^[^?#]*\?([^#]*)', 1), 'q=')) AND NOT regexp_matches(lower({PATH_SQL}), '{_LIST}') THEN 'redirected to a list'
  WHEN regexp_matches(lower(title), '{_VERIFY}') OR regexp_matches(lower(h1), '{_VERIFY}') THEN 'wall' WHEN regexp_matches(lower(title), '{_MISSING}') OR regexp_matches(lower(h1), '{_MISSING}') THEN 'says not found'
  WHEN listing = '' THEN CASE WHEN declared OR title <> '' THEN 'opens' ELSE 'built by script' END
  WHEN len(ws) > 0 AND shared >= least(2, len(ws)) THEN 'shows the product' WHEN (declared OR named <> '') AND headline >= 2 THEN 'another product' ELSE 'built by script' END AS reason FROM c)
SELECT k AS page_id, CASE WHEN reason IN ('refused', 'unexpected answer', 'wall', 'built by script') THEN 'unchecked' WHEN reason IN ('opens', 'shows the product') THEN 'ok' ELSE 'dead' END AS state, reason FROM r
"""


def page_canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "pages").select("page_id", urls.canonical_key("url", ("page", "sku")).alias("key"))


CANONICAL = rf"""
WITH p AS (SELECT page_id, regexp_replace({HOST_SQL}, '^www\.', '') AS h, {PATH_SQL} AS path, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1) IN ('page', 'sku'))) AS q FROM pages)
SELECT page_id, CASE WHEN regexp_extract(path, '/(?:dp|gp/product)/([A-Za-z0-9]{{10}})', 1) <> '' THEN h || '/dp/' || upper(regexp_extract(path, '/(?:dp|gp/product)/([A-Za-z0-9]{{10}})', 1))
  ELSE h || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS key FROM p
"""


def page_store_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = spark.createDataFrame([("example.com", "Com"), ("example.org", "Org"), ("spam-farm.example.org", "Farm"), ("blog.example.net", "Blog"), ("net", "Net")], "domain string, store string")
    return urls.with_store(src.table(spark, sf_dir, "pages").select("page_id", "url"), "url", stores, "page_id").select("page_id", "store")


STORES = rf"""
WITH p AS (SELECT page_id, {HOST_SQL} AS h FROM pages), s(domain, store) AS (VALUES ('example.com', 'Com'), ('example.org', 'Org'), ('spam-farm.example.org', 'Farm'), ('blog.example.net', 'Blog'), ('net', 'Net'))
SELECT page_id, store FROM p LEFT JOIN s ON h = domain OR ends_with(h, '.' || domain) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) = 1
"""


def url_public_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls, and addresses made from page ids, some of them private."""
    p = src.table(spark, sf_dir, "pages")
    made = F.concat(F.lit("http://"), F.concat_ws(".", *[(F.col("page_id") * k % 256).cast("string") for k in (1, 7, 13, 29)]), F.lit("/x"))
    return p.select("page_id", urls.is_public("url").alias("public_page"), made.alias("made"), urls.is_public(made).alias("public_made"))


PUBLIC = rf"""
WITH p AS (SELECT page_id, url, page_id * 1 % 256 AS a, page_id * 7 % 256 AS b, page_id * 13 % 256 AS c, page_id * 29 % 256 AS d FROM pages)
SELECT page_id, coalesce(regexp_matches(url, '^(?i)https?://[^/?#\s]+') AND contains({HOST_SQL}, '.') AND NOT regexp_matches({HOST_SQL}, '(^localhost$|\.(local|localhost|internal|lan|home|intranet|corp)$)'), FALSE) AS public_page,
  'http://' || a || '.' || b || '.' || c || '.' || d || '/x' AS made,
  NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19))) AS public_made
FROM p
"""


def slug_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = src.table(spark, sf_dir, "part")
    url = F.concat(F.lit("https://shop.example/p/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), (F.col("p_size") % 10).cast("string"), F.lit("-5-inch"))
    return p.select("p_partkey", urls.slug_words(url).alias("words"))


SLUG = "SELECT p_partkey, replace(p_name, ' ', ' ') || ' ' || (p_size % 10) || '.5 inch' AS words FROM part"


def parse_price_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = src.table(spark, sf_dir, "part")
    text = F.concat(F.when(F.col("p_partkey") % 3 == 0, "Rs. ").when(F.col("p_partkey") % 3 == 1, "₹").otherwise("-"), F.format_number("p_retailprice", 2), F.when(F.col("p_partkey") % 5 == 0, " only").otherwise(""))
    return p.select("p_partkey", tx.parse_price(text).alias("price"), tx.price_value(F.col("p_retailprice") - 1000).alias("less"), tx.parse_int(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".5 reviews").otherwise(" reviews"))).alias("count"))


PRICES = """
SELECT p_partkey, CASE WHEN round(p_retailprice, 2) > 0 THEN round(p_retailprice, 2) END AS price, CASE WHEN p_retailprice - 1000 > 0 THEN p_retailprice - 1000 END AS less, CASE WHEN p_partkey % 2 = 1 THEN CAST(p_size AS BIGINT) END AS count FROM part
"""


def availability_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    later = F.when(F.col("l_linenumber") % 2 == 0, "https://schema.org/PreSale").otherwise("Pre-Order, available soon")
    raw = F.when(flag == "R", "http://schema.org/OutOfStock").when(flag == "A", later).when(F.col("l_linestatus") == "O", "https://soldout.example/InStock").otherwise("ask us")
    return src.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", tx.availability(raw).alias("in_stock")).groupBy("l_returnflag", "l_linestatus", "in_stock").agg(F.count("*").alias("n"))


AVAILABILITY = "SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'R' THEN FALSE WHEN l_returnflag = 'A' THEN NULL WHEN l_linestatus = 'O' THEN TRUE END AS in_stock, count(*) AS n FROM lineitem GROUP BY ALL"


def rating_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_size") / 8.0
    return src.table(spark, sf_dir, "part").select("p_partkey", tx.review_rating(v).alias("whole"), tx.collected_rating(v).alias("collected"), tx.imported_rating(v).alias("imported"), tx.rescaled_rating(F.col("p_size"), F.lit(50)).alias("rescaled"))


RATING = """
WITH v AS (SELECT p_partkey, p_size, p_size / 8.0::DOUBLE AS v, CAST(round_even(p_size / 8.0::DOUBLE, 0) AS INTEGER) AS r FROM part)
SELECT p_partkey, CASE WHEN v = floor(v) AND v BETWEEN 1 AND 5 THEN CAST(v AS INTEGER) END AS whole, CASE WHEN v BETWEEN 1 AND 5 THEN r END AS collected, CASE WHEN r BETWEEN 1 AND 5 THEN r END AS imported, CAST(floor(p_size / 50.0::DOUBLE * 5 + 0.5) AS INTEGER) AS rescaled FROM v
"""


def parse_review_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = src.table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    text = (
        F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 5 == 1, F.concat(F.lit("Reviewed in India on "), F.date_format(d, "d MMMM yyyy"))).when(k % 5 == 2, F.date_format(d, "MMM d, yyyy"))
        .when(k % 5 == 3, F.concat((k % 40).cast("string"), F.lit(" days ago"))).otherwise("2 months ago")
    )
    return o.select("o_orderkey", dates.parse_review_date(text, F.lit("2000-06-15 10:30:00").cast("timestamp")).cast("timestamp_ntz").alias("day"))


DATES = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) WHEN o_orderkey % 5 = 3 THEN TIMESTAMP '2000-06-15' - to_days(CAST(o_orderkey % 40 AS INTEGER)) END AS day FROM orders"


def format_inr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "part").select("p_partkey", tx.format_inr(F.col("p_retailprice") * 1000).alias("whole"), tx.format_inr(F.when(F.col("p_partkey") % 7 != 0, F.floor("p_retailprice") + 0.25)).alias("part"))


GROUPED = lambda w: f"CASE WHEN length({w}) <= 3 THEN {w} ELSE CASE WHEN length({w}) <= 5 THEN left({w}, length({w}) - 3) WHEN length({w}) <= 7 THEN left({w}, length({w}) - 5) || ',' || substr({w}, length({w}) - 4, 2) ELSE left({w}, length({w}) - 7) || ',' || substr({w}, length({w}) - 6, 2) || ',' || substr({w}, length({w}) - 4, 2) END || ',' || right({w}, 3) END"
INR = f"""
WITH p AS (SELECT p_partkey, p_retailprice * 1000 AS v, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS h FROM part),
q AS (SELECT *, split_part(CASE WHEN v = floor(v) THEN printf('%.0f', v) ELSE printf('%.2f', v) END, '.', 1) AS w, split_part(CASE WHEN v = floor(v) THEN printf('%.0f', v) ELSE printf('%.2f', v) END, '.', 2) AS t FROM p)
SELECT p_partkey, 'Rs ' || {GROUPED("w")} || CASE WHEN t <> '' THEN '.' || t ELSE '' END AS whole, CASE WHEN p_partkey % 7 = 0 THEN 'price not read' ELSE 'Rs ' || {GROUPED("h")} || '.25' END AS part FROM q
"""


def gtin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 13 digits with the right check digit for two parts of three."""
    p = src.table(spark, sf_dir, "part")
    body = F.lpad((F.col("p_partkey") * 7919 + 400000000000).cast("string"), 13, "0")
    digit = (identifiers.check_digit(body) + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)) % 10
    return p.select("p_partkey", identifiers.normal_gtin(F.concat(body, digit.cast("string"))).alias("gtin"))


GTIN = """
WITH b AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 + 400000000000 AS VARCHAR), 13, '0') AS b FROM part),
d AS (SELECT p_partkey, b, (10 - list_sum(list_transform(range(1, 14), lambda k: CAST(substr(b, k, 1) AS INTEGER) * CASE WHEN k % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10 AS d FROM b)
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN b || CAST(CAST(d AS INTEGER) AS VARCHAR) END AS gtin FROM d
"""


def mpn_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat(F.lit("sm-"), F.col("p_size").cast("string"), F.lit("x"), F.col("p_partkey").cast("string"))
    b = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper(a), F.lit("/IN"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("SM"), F.col("p_size").cast("string"))).otherwise(F.lit("none"))
    return src.table(spark, sf_dir, "part").select("p_partkey", identifiers.mpn_agree(a, b).alias("agree"))


MPN = r"""
WITH p AS (SELECT p_partkey, upper(regexp_replace('sm' || p_size || 'x' || p_partkey, '[^a-z0-9]', '', 'g')) AS x, CASE p_partkey % 3 WHEN 0 THEN upper('sm' || p_size || 'x' || p_partkey) || 'IN' WHEN 1 THEN 'SM' || p_size END AS y FROM part),
q AS (SELECT p_partkey, x, CASE WHEN length(y) >= 4 THEN y END AS y FROM p WHERE TRUE)
SELECT p_partkey, CASE WHEN y IS NOT NULL AND length(x) >= 4 THEN x = y OR CASE WHEN length(x) <= length(y) THEN length(x) >= 6 AND starts_with(y, x) ELSE length(y) >= 6 AND starts_with(x, y) END END AS agree FROM q
"""


def label_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents, then a batch that changes some, clears some and adds some."""
    d, l = src.table(spark, sf_dir, "documents"), src.table(spark, sf_dir, "labels")
    first = d.join(l, "doc_id").groupBy(tx.review_hash("text").alias("review_hash")).agg(F.max(F.when(F.col("quality") == 1, "real").otherwise("fake")).alias("label"))
    batch = d.where("doc_id % 4 = 0").select("text", F.when(F.col("doc_id") % 12 == 0, "clear").when(F.col("doc_id") % 8 == 0, "fake").otherwise("real").alias("label"), F.col("doc_id").alias("ordinal"))
    return labels.save_labels(first, batch)


UPSERT = r"""
WITH h AS (SELECT *, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS k FROM documents),
a AS (SELECT k, max(CASE WHEN quality = 1 THEN 'real' ELSE 'fake' END) AS old FROM h JOIN labels USING (doc_id) GROUP BY k),
b AS (SELECT k, arg_max(CASE WHEN doc_id % 12 = 0 THEN 'clear' WHEN doc_id % 8 = 0 THEN 'fake' ELSE 'real' END, doc_id) AS new FROM h WHERE doc_id % 4 = 0 AND trim(text) <> '' AND length(text) <= 5000 GROUP BY k)
SELECT coalesce(a.k, b.k) AS review_hash, coalesce(new, old) AS label FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(new, old) <> 'clear'
"""


def observation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as stored rows, later ones as a batch: the last wins, but the first date stays."""
    o = src.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.col("o_orderdate").alias("first_seen"), F.col("o_totalprice").alias("price"))
    old = o.where("o_orderkey % 3 <> 0").groupBy("o_custkey", "o_orderpriority").agg(F.max_by(F.struct("o_orderkey", "first_seen", "price"), "o_orderkey").alias("x")).select("o_custkey", "o_orderpriority", "x.*")
    return labels.upsert(old, o.where("o_orderkey % 3 = 0"), ["o_custkey", "o_orderpriority"], "o_orderkey", keep_first=("first_seen",))


OBSERVED = """
WITH a AS (SELECT o_custkey, o_orderpriority, max(o_orderkey) AS k, arg_max(o_orderdate, o_orderkey) AS d, arg_max(o_totalprice, o_orderkey) AS p FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL),
b AS (SELECT o_custkey, o_orderpriority, max(o_orderkey) AS k, arg_max(o_orderdate, o_orderkey) AS d, arg_max(o_totalprice, o_orderkey) AS p FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, coalesce(b.k, a.k) AS o_orderkey, coalesce(a.d, b.d) AS first_seen, coalesce(b.p, a.p) AS price
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority
"""


def train_eval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text key isn't a benchmark item's, the first of each key."""
    d = src.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").alias("ordinal"))
    return labels.unknown_texts(d, src.table(spark, sf_dir, "benchmark")).select("doc_id")


OVERLAP = r"""
WITH k AS (SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS k FROM documents)
SELECT min(doc_id) AS doc_id FROM k WHERE k NOT IN (SELECT sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) FROM benchmark) GROUP BY k
"""

QUERIES = {
    f.__name__: f
    for f in (page_heading_extract, page_wall_class, page_link_judgement, page_canonical_key, page_store_resolution, url_public_gate, slug_text, parse_price_values, availability_map, rating_rules, parse_review_dates, format_inr, gtin_check, mpn_agree, label_upsert, observation_upsert, train_eval_overlap)
}
ORACLE_SQL = {
    "page_heading_extract": HEADING, "page_wall_class": WALL, "page_link_judgement": LINK, "page_canonical_key": CANONICAL, "page_store_resolution": STORES, "url_public_gate": PUBLIC, "slug_text": SLUG, "parse_price_values": PRICES, "availability_map": AVAILABILITY,
    "rating_rules": RATING, "parse_review_dates": DATES, "format_inr": INR, "gtin_check": GTIN, "mpn_agree": MPN, "label_upsert": UPSERT, "observation_upsert": OBSERVED, "train_eval_overlap": OVERLAP,
}
