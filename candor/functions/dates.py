"""Dates of reviews as shops write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candor.functions.text import col

NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Full names, their first three letters, and one more short form.
MONTHS = {n: k for k, n in enumerate(NAMES, 1)} | {n[:3]: k for k, n in enumerate(NAMES, 1)} | {"sept": 9}
#: Days that a unit of "ago" stands for; longer units give no day.
UNITS = {"second": 0, "minute": 0, "hour": 0, "day": 1, "week": 7, "month": None, "year": None}
SAID = {"today": 0, "just now": 0, "yesterday": 1}


def _table(values: dict, kind: str) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))])


def pieces(c: Column) -> Column:
    """The words and numbers of a text in order, in lower case; an ending on a number ("3rd") stays with it."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+|[0-9]+[a-z]*)"), F.lit(1))


def month_of(piece: Column) -> Column:
    return F.try_element_at(_table(MONTHS, "int"), piece)


def day_of(piece: Column) -> Column:
    """A number of one or two places, alone or as an ordinal."""
    bare = F.when(F.right(piece, F.lit(2)).isin("st", "nd", "rd", "th"), F.left(piece, F.length(piece) - 2)).otherwise(piece)
    return F.when(F.length(bare) <= 2, bare.try_cast("int"))


def year_of(piece: Column) -> Column:
    return F.when(F.length(piece) == 4, piece.try_cast("int"))


def named_day(p: Column) -> Column:
    """The first day, month and year that stand side by side, the day or the month first; null if there is no such day."""
    at = F.sequence(F.lit(0), F.greatest(F.size(p) - 3, F.lit(0)))
    piece = lambda i: F.coalesce(F.get(p, i), F.lit(""))
    ymd = lambda y, m, d: F.array(y, m, d)
    day_first = F.transform(at, lambda i: ymd(year_of(piece(i + 2)), month_of(piece(i + 1)), day_of(piece(i))))
    month_first = F.transform(at, lambda i: ymd(year_of(piece(i + 2)), month_of(piece(i)), day_of(piece(i + 1))))
    whole = F.filter(F.concat(day_first, month_first), lambda x: F.forall(x, lambda v: v.isNotNull()))
    found = F.get(whole, F.lit(0))
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", found[0], found[1], found[2]), F.lit("yyyy-MM-dd"))


def days_ago(text: Column, p: Column) -> tuple[Column, Column]:
    """Whether a text says how long ago, and how many days that is."""
    unit = F.regexp_replace(F.coalesce(F.get(p, F.lit(1)), F.lit("")), "s$", "")
    counted = (F.size(p) == 3) & (F.coalesce(F.get(p, F.lit(2)), F.lit("")) == "ago") & unit.isin(list(UNITS)) & F.get(p, F.lit(0)).try_cast("int").isNotNull()
    said = text.isin(list(SAID))
    n = F.get(p, F.lit(0)).try_cast("int") * F.try_element_at(_table(UNITS, "int"), unit)
    return F.coalesce(said | counted, F.lit(False)), F.when(said, F.try_element_at(_table(SAID, "int"), text)).when(counted, n)


def parse_review_date(c: str | Column, now: Column) -> Column:
    """Timestamp of a review's date text, read at ``now``.

    Days are taken where the text gives them exactly (also "3 days ago"); months
    and years ago give no day and so null.
    """
    t = F.trim(col(c))
    p = pieces(t)
    ago, days = days_ago(F.lower(t), p)
    is_iso = F.substring(t, 5, 1).isin("-") & F.substring(t, 8, 1).isin("-") & F.left(t, F.lit(4)).try_cast("int").isNotNull()
    iso = F.when(is_iso, F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(F.left(t, F.lit(10)), F.lit("yyyy-MM-dd"))))
    return F.when(ago, F.date_trunc("day", now) - F.make_dt_interval(days)).otherwise(F.coalesce(iso, named_day(p)))
