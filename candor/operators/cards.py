"""Product cards and review blocks of saved pages, from a table of their nodes.

``page_nodes`` reads each page once into rows numbered in document order: a node spans the numbers ``pre`` to ``last`` of all
that it holds. Everything after that is DataFrame work. What a node holds (links, texts, prices) is the difference of two
running totals, so an ancestor costs two look-ups however much it holds; what belongs to a card is found by the last card
begun before it. Nothing pairs a page's nodes with one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.functions import text as tx
from candor.operators.extract import VOID

NODE = pa.schema([("pre", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("up", pa.list_(pa.int32())), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("named", pa.int32()), ("hooked", pa.int32())])
NODE_SQL = "pre int, last int, depth int, up array<int>, tag string, attrs map<string, string>, text string, named int, hooked int"
#: Attributes that are kept (fixed values), tags that hold a name, tags whose text isn't shown.
KEPT = ("href", "class", "title", "alt", "src", "data-src", "srcset", "aria-label", "data-hook")
NAMING, HIDDEN = ("h1", "h2", "h3", "h4"), ("script", "style", "noscript", "template")
#: How many ancestors of a link can be its card.
CLIMB = 8


class Nodes(HTMLParser):
    """Rows of a page's nodes. ``named`` and ``hooked`` of a text are the nearest nodes around it that hold a name, or a data-hook."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self._open: list[tuple[str, int, int, int]] = []  # tag, row, nearest naming node, nearest hook
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError):
            pass
        for _, row, _, _ in self._open:
            self.rows[row][1] = len(self.rows) - 1

    def _add(self, tag: str, attrs: dict, text: str | None) -> int:
        n = len(self.rows)
        around = [r for t, r, _, _ in self._open[-CLIMB + 1 :] if t not in ("html", "body")][::-1]
        _, _, named, hooked = self._open[-1] if self._open else ("", 0, -1, -1)
        self.rows.append([n, n, len(self._open), ([n] if text is None else []) + around, tag, [(k, v) for k, v in attrs.items() if k in KEPT], text, named, hooked])
        return n

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        n = self._add(tag, a, None)
        if tag not in VOID:
            _, _, named, hooked = self._open[-1] if self._open else ("", 0, -1, -1)
            calls = tag in NAMING or any(w in a.get("class", "").lower() for w in ("title", "name"))
            self._open.append((tag, n, n if calls else named, n if a.get("data-hook") else hooked))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(tag, {k: v or "" for k, v in attrs}, None)

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _, _ in self._open):
            while self._open:
                t, row, _, _ = self._open.pop()
                self.rows[row][1] = len(self.rows) - 1
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if data.strip() and not any(t in HIDDEN for t, _, _, _ in self._open[-1:]):
            self._add("#text", {}, data)


def page_nodes(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(``key``, pre, last, depth, up, tag, attrs, text, named, hooked) of every page; null and empty pages have no nodes."""
    rows = pages.select(key, html)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in enumerate(batch.column(1)):
                found = Nodes(page.as_py() or "").rows
                for k in range(0, len(found), 20_000):
                    part = found[k : k + 20_000]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(part)))] + [pa.array([r[j] for r in part], f.type) for j, f in enumerate(NODE)], names=[key, *NODE.names])

    return rows.mapInArrow(run, f"`{key}` {kind}, {NODE_SQL}")


def prices(text: Column, signs: str = "₹|Rs\\.?|INR") -> Column:
    """Amounts after a currency sign, without those that a saving, an instalment or a start price names."""
    pattern = rf"(?i)((?:emi|save|off|extra|cashback|from|starting|per month)\s*[:\-]?\s*)?(?:{signs})\s*([\d,]+(?:\.\d{{1,2}})?)"
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda noise, v: F.when(noise == "", F.regexp_replace(v, ",", "").try_cast("double")))
    return F.filter(found, lambda v: v > 0)


def canonical_link(href: Column) -> Column:
    """An address without its fragment and tracking parameters."""
    bare = F.regexp_replace(F.regexp_replace(href, "#.*$", ""), r"(?i)/ref=[^/?]*", "")
    bare = F.regexp_replace(bare, r"(?i)[?&](?:ref|pf_rd_[a-z]+|pd_rd_[a-z]+|qid|sr|sprefix|crid|lid|otracker\d*|marketplace|spid|srno|fm|iid|ssid|cmpid|cmp)=[^&]*", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\?&", "?"), r"[?&]$", "")


def product_link(href: Column) -> Column:
    """Whether an address looks like a product's: long enough, no list or service page, and a product folder, number or code."""
    path = F.regexp_extract(href, r"^(?:[a-z]+://[^/?#]+)?([^?#]*)", 1)
    service = path.rlike(r"(?i)/(search|cart|login|account|wishlist|checkout|help|about|contact|offers?|stores?|brands?|categor(y|ies)|collections?|blogs?|pages?)(/|$)")
    return F.coalesce((F.length(path) >= 14) & ~service & (path.rlike(r"(?i)/(products?|p|pd|item|buy)/") | path.rlike(r"\d{4,}") | path.rlike(r"(?i)-[a-z0-9]{8,}$")), F.lit(False))


def card_spans(nodes: DataFrame, key: str, most_chars: int = 1800, link: Column | None = None) -> DataFrame:
    """(``key``, address, href, pre, last): the card of each product address, once: the widest of the ``CLIMB`` nearest nodes
    around its first link that holds no other product, ``most_chars`` characters at most, and a price (R6)."""
    c, by = F.col, Window.partitionBy(key).orderBy("pre")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    href = F.try_element_at("attrs", F.lit("href"))
    is_product = product_link(href) if link is None else link
    d = nodes.withColumn("address", F.when((c("tag") == "a") & is_product, canonical_link(href)))
    d = d.withColumns({"_chars": F.coalesce(F.char_length("text"), F.lit(0)), "_prices": F.coalesce(F.size(prices(c("text"))), F.lit(0)), "_link": c("address").isNotNull().cast("int")})
    # A run: neighbouring links of one address. A node holds one product if all its links are of one run.
    before = F.last("address", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_new", F.when(c("address").isNotNull() & ~c("address").eqNullSafe(before), 1).otherwise(0))
    total = {n: F.sum(f"_{n}").over(so_far) for n in ("chars", "prices", "link", "new")}
    d = d.withColumns(total).withColumn("_run_from", F.last(F.when(c("_new") == 1, c("link") - 1), ignorenulls=True).over(so_far))
    at = d.select(key, "pre", "last", *[c(n).alias(n) for n in total], *[(c(n) - c(f"_{n}")).alias(f"{n}_before") for n in ("chars", "prices", "link")])
    ends = d.select(c(key).alias("_k"), c("pre").alias("_p"), *[c(n).alias(f"{n}_end") for n in total])
    spans = at.join(ends, (c(key) == c("_k")) & (c("last") == c("_p"))).select(key, c("pre").alias("node"), c("last").alias("node_last"), (c("chars_end") - c("chars_before")).alias("n_chars"), (c("prices_end") - c("prices_before")).alias("n_prices"), c("new_end").alias("run_end"), c("link_before").alias("links_before"))
    links = d.where("address is not null").select(key, c("pre").alias("link_pre"), "address", href.alias("href"), c("new").alias("run"), "_run_from", F.posexplode("up").alias("step", "node"))
    fits = (c("run_end") == c("run")) & (c("_run_from") <= c("links_before")) & (c("n_chars") <= most_chars) & (c("n_prices") > 0)
    widest = links.join(spans, [key, "node"]).where(fits).groupBy(key, "address", "link_pre").agg(F.max_by(F.struct("href", c("node").alias("pre"), c("node_last").alias("last")), "step").alias("x"))
    return widest.groupBy(key, "address").agg(F.min_by("x", "link_pre").alias("x")).select(key, "address", "x.*")


def inside(nodes: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Nodes that lie in one of a page's ``spans`` (pre, last), which don't overlap: ``span`` is its pre. The last span begun
    before a node is the only one that can hold it."""
    starts = spans.select(F.col(key).alias("_at"), F.col("pre").alias("_start"), F.col("last").alias("_end"))
    marked = nodes.join(starts, (F.col(key) == F.col("_at")) & (F.col("pre") == F.col("_start")), "left").drop("_at")
    w = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    both = F.last(F.when(F.col("_start").isNotNull(), F.struct("_start", "_end")), ignorenulls=True).over(w)
    return marked.withColumn("_s", both).where(F.col("pre") <= F.col("_s._end")).withColumn("span", F.col("_s._start")).drop("_s", "_start", "_end")


JUNK = (
    r"(?i)^(?:onlyonline|sponsored|ad|add to compare|new|bestseller|best seller|trending|hot|limited deal|deal of the day|out of stock|compare)$"
    r"|extra deals|price, product page|product page|or fastest delivery|free delivery|add to cart|buy now|view details"
)


def cards(nodes: DataFrame, key: str, **options) -> DataFrame:
    """(``key``, address, url, title, price, mrp, rating, image_url, out_of_stock) of the product cards of pages (R6). A title
    is the longest name among headings, titles and picture texts, else the longest line without a price."""
    c = F.col
    spans = card_spans(nodes, key, **options)
    own = inside(nodes, spans, key)
    tidy = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?i)^\s*sponsored ad\s*[-–:]\s*", ""), r"(?i)^\s*(?:product )?image of\s+", ""), r"\s+", " "))
    valid = lambda t: F.when(F.char_length(t).between(6, 200) & ~t.rlike(JUNK) & t.rlike("(?i)[a-z]{3}"), t)
    ordered = lambda on: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("pre", "text")))), lambda s: s["text"]), " ")
    headings = own.where("named >= 0 and text is not null").groupBy(key, "span", "named").agg(ordered(F.lit(True)).alias("t")).select(key, "span", valid(tidy(c("t"))).alias("t"))
    attrs = own.where("text is null").select(key, "span", valid(tidy(F.when(c("tag") == "img", F.try_element_at("attrs", F.lit("alt"))).when(c("tag") == "a", F.try_element_at("attrs", F.lit("title"))))).alias("t"))
    longest = lambda d, name: d.where("t is not null").groupBy(key, "span").agg(F.max_by("t", F.struct(F.char_length("t"), "t")).alias(name))
    trusted = longest(headings.union(attrs), "_trusted")
    lines = longest(own.where("text is not null").select(key, "span", F.when(F.size(prices(c("text"))) == 0, valid(tidy(c("text")))).alias("t")), "_line")
    picture = F.coalesce(*[F.try_element_at("attrs", F.lit(a)) for a in ("src", "data-src")])
    whole = own.groupBy(key, "span").agg(ordered(c("text").isNotNull()).alias("text"), F.max_by(F.when(c("tag") == "img", picture), F.when(c("tag") == "img", F.coalesce(F.char_length(F.try_element_at("attrs", F.lit("alt"))), F.lit(0)))).alias("image_url"), F.max(F.regexp_extract(F.try_element_at("attrs", F.lit("aria-label")), r"(?i)([1-5](?:\.\d)?)\s*out of 5", 1)).alias("_label"))
    d = spans.withColumnsRenamed({"pre": "span"}).join(whole, [key, "span"]).join(trusted, [key, "span"], "left").join(lines, [key, "span"], "left")
    found = prices(c("text"))
    rating = F.coalesce(F.nullif(F.regexp_extract("text", r"(?i)(?:^|\s)([1-5](?:\.\d)?)\s*(?:★|out of 5|stars?)", 1), F.lit("")), F.nullif("_label", F.lit("")))
    return d.select(
        key, "address", c("href").alias("url"), F.left(F.coalesce("_trusted", "_line"), F.lit(220)).alias("title"), F.get(found, F.lit(0)).alias("price"), F.when(F.size(found) > 1, F.array_max(found)).alias("mrp"), rating.try_cast("double").alias("rating"),
        F.when(~c("image_url").startswith("data:"), c("image_url")).alias("image_url"), c("text").rlike("(?i)out of stock|currently unavailable|sold out").alias("out_of_stock"),
    ).where("title is not null")


def hooked_reviews(nodes: DataFrame, key: str) -> DataFrame:
    """(``key``, ordinal, text, rating, date, verified_purchase) of blocks marked ``data-hook="review"`` (S6); texts of under
    four characters are left out."""
    c = F.col
    hook = F.try_element_at("attrs", F.lit("data-hook"))
    blocks = nodes.where(hook == "review").select(key, "pre", "last")
    own = inside(nodes, blocks, key)
    marks = own.where(hook.isNotNull() & (hook != "review")).select(key, "span", c("pre").alias("hooked"), hook.alias("hook"))
    texts = own.where("text is not null").select(key, "span", "hooked", "pre", "text").join(marks, [key, "span", "hooked"])
    told = texts.groupBy(key, "span", "hook", "hooked").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda s: F.trim(s["text"])), " ").alias("t"))
    first = lambda *hooks: F.min_by(F.when(c("hook").isin(*hooks), c("t")), F.when(c("hook").isin(*hooks), c("hooked")))
    badge = marks.groupBy(key, "span").agg(F.max((c("hook") == "avp-badge").cast("int")).alias("_badge"))
    r = told.groupBy(key, "span").agg(first("review-body").alias("text"), first("review-star-rating", "cmps-review-star-rating").alias("_stars"), first("review-date").alias("date")).join(badge, [key, "span"], "left")
    return r.where(F.char_length("text") >= 4).select(key, c("span").alias("ordinal"), "text", tx.collected_rating(F.regexp_extract("_stars", r"(\d+(?:\.\d+)?)", 1).try_cast("double")).alias("rating"), "date", (F.coalesce("_badge", F.lit(0)) == 1).alias("verified_purchase"))
