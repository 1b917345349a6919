"""Column functions on text and values: cleaning, parsing, keys, lexicon sentiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """White space collapsed and cut off; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(col(c), r"(?U)\s+", " ")), F.lit(""))


def first_number(c: Column) -> Column:
    """The first run of digits with separators, as double."""
    return F.regexp_replace(F.regexp_extract(c, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")


def number(c: str | Column) -> Column:
    """A number with or without a rupee mark in front (F2)."""
    return F.regexp_replace(F.regexp_extract(col(c), r"(?i)(?:₹|rs\.?|inr)?\s*(\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")


def parse_price(c: str | Column) -> Column:
    """The first number in a text, its sign ignored; null unless over 0."""
    n = first_number(col(c).cast("string"))
    return F.when(n > 0, n)


def price_value(c: str | Column) -> Column:
    """A price that is a number already: null unless over 0."""
    return F.when(col(c) > 0, col(c).cast("double"))


def parse_int(c: str | Column) -> Column:
    """A whole number; null for a fraction."""
    n = first_number(col(c).cast("string"))
    return F.when(n == F.floor(n), n.cast("long"))


def parse_rating(c: str | Column) -> Column:
    """A rating in (0, 5]."""
    n = first_number(col(c).cast("string"))
    return F.when((n > 0) & (n <= 5), n)


def review_rating(c: str | Column) -> Column:
    """Whole ratings 1..5 only."""
    n = col(c).cast("double")
    return F.when((n == F.floor(n)) & n.between(1, 5), n.cast("int"))


def collected_rating(c: str | Column) -> Column:
    """In 1..5, then rounded half to even."""
    n = col(c).cast("double")
    return F.when(n.between(1, 5), F.bround(n, 0).cast("int"))


def imported_rating(c: str | Column) -> Column:
    """Rounded half to even, then in 1..5."""
    n = F.bround(col(c).cast("double"), 0)
    return F.when(n.between(1, 5), n.cast("int"))


def rescaled_rating(value: str | Column, most: str | Column) -> Column:
    """A rating on a scale of up to 100 brought to 5, half up (F8)."""
    v, m = col(value).cast("double"), col(most).cast("double")
    return F.when((m > 5) & (m <= 100), F.floor(v / m * 5 + 0.5)).otherwise(F.floor(v + 0.5)).cast("int")


def availability(c: str | Column) -> Column:
    """True, false or unknown by the first rule that fits the last part of an address or words: out, then orderable
    later (unknown), then in (F9)."""
    t = F.regexp_replace(F.lower(F.element_at(F.split(col(c), "/"), -1)), r"[^a-z]", "")
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
    return (
        F.when(has("outofstock", "soldout", "unavailable", "discontinued", "notavailable"), False)
        .when(has("preorder", "presale", "backorder"), F.lit(None).cast("boolean"))
        .when(has("instock", "limitedavailability", "instoreonly", "onlineonly", "available"), True)
    )


def clean_brand(c: str | Column) -> Column:
    """Without "Visit the ... Store" and "Brand:" (F10)."""
    inner = F.regexp_replace(F.regexp_replace(clean(c), r"(?i)^(?:visit the|brand:?)\s*", ""), r"(?i)\s+store$", "")
    return F.nullif(F.btrim(inner, F.lit(" -|:")), F.lit(""))


#: Titles that are templates or walls, and what shops put around a name (fixed values).
PLACEHOLDER_TITLE = r"(?i)\b(?:undefined|null|nan)\b|^\W*(?:home|loading|just a moment|404|page not found)\W*$"
SEPARATORS = r"\-|–—"


def clean_title(c: str | Column, site: str | Column | None = None) -> Column:
    """A title without its site name and shop talk; placeholders are null."""
    whole = clean(c)
    t = whole
    if site is not None:
        # The site's name with a separator, at either end, is cut by length: it is data, not a pattern.
        name = F.lower(clean(site))
        n = F.length(name)
        edge = rf"[{SEPARATORS}:]"
        inner = F.rtrim(F.left(t, F.length(t) - n))
        t = F.when(F.lower(t).endswith(name) & inner.rlike(edge + "$"), F.rtrim(F.left(inner, F.length(inner) - 1))).otherwise(t)
        rest = F.ltrim(F.substring(t, n + 1, F.length(t)))
        t = F.when(F.lower(t).startswith(name) & rest.rlike("^" + edge), F.ltrim(F.substring(rest, F.lit(2), F.length(rest)))).otherwise(t)
        t = F.coalesce(t, whole)
    t = F.regexp_replace(t, rf"(?i)\s*[{SEPARATORS}]\s*(?:buy|shop)\b.*$", "")
    named = F.regexp_extract(t, r"(?i)^(.{8,}?)\s+online\b.{0,50}$", 1)
    t = F.when(named != "", F.regexp_replace(named, r"(?i)^\s*buy\s+(?=\S)", "")).otherwise(t)
    return F.when(~whole.rlike(PLACEHOLDER_TITLE), F.nullif(F.btrim(t, F.lit(" -|:")), F.lit("")))


def folded(c: str | Column) -> Column:
    """Lower case with the sharp s spelled out, as case folding has it."""
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def review_key(c: str | Column) -> Column:
    """White space collapsed, case folded."""
    return F.trim(F.regexp_replace(folded(c), r"\s+", " "))


def review_hash(c: str | Column) -> Column:
    """SHA-256 of the review key."""
    return F.sha2(review_key(c), 256)


def word_key(c: str | Column) -> Column:
    """Words only: runs of other characters become one space."""
    return F.trim(F.regexp_replace(folded(c), r"[^\p{L}\p{N}_]+", " "))


def words(c: Column) -> Column:
    """Words between spaces, without empty ones."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def word_count(c: str | Column) -> Column:
    """Words between any white space."""
    return F.size(F.filter(F.split(col(c), r"\s+"), lambda w: w != ""))


def latin_share(c: str | Column) -> Column:
    """Share of A-Z among the letters; 0 without letters."""
    letters = F.length(F.regexp_replace(col(c), r"\P{L}", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(col(c), r"[^A-Za-z]", "")) / letters).otherwise(0.0)


def latin_gate(c: str | Column, share: float = 0.9, least_words: int = 6) -> Column:
    """Whether the text model may judge a text: Latin and long enough."""
    return F.coalesce((latin_share(c) >= share) & (word_count(c) >= least_words), F.lit(False))


def hits(c: Column, lexicon: Sequence[str]) -> Column:
    """How many of the lexicon's entries occur in the text."""
    return F.aggregate(F.array(*map(F.lit, lexicon)), F.lit(0), lambda n, w: n + F.contains(c, w).cast("int"))


def sentiment(c: str | Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """(positive - negative) / both by lexicon entries present; 0 without any."""
    low = F.lower(col(c))
    p, n = hits(low, positive), hits(low, negative)
    return F.when(p + n > 0, F.round((p - n) / (p + n), 2)).otherwise(0.0)


def format_inr(c: str | Column) -> Column:
    """Rupees with Indian grouping."""
    v = F.abs(col(c))
    whole = v == F.floor(v)
    fixed = F.when(whole, F.format_string("%.0f", v)).otherwise(F.format_string("%.2f", v))
    head, tail = F.split_part(fixed, F.lit("."), F.lit(1)), F.split_part(fixed, F.lit("."), F.lit(2))
    grouped = F.when(F.length(head) > 3, F.regexp_replace(head, r"(?<=\d)(?=(?:\d\d)+\d$)", ",")).otherwise(head)
    text = F.concat(F.lit("Rs "), grouped, F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""))
    return F.when(col(c).isNull(), "price not read").otherwise(text)


def unescaped(c: str | Column) -> Column:
    """The common HTML entities as text."""
    out = col(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out
