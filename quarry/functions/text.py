"""Scalar text and URL functions as column expressions."""

from __future__ import annotations

import html
from urllib.parse import parse_qs, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: White space of Unicode and the four separators that only some libraries count as such.
WHITE = r"(?U)[\s\x1c-\x1f]"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_white(value: Column | str) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(_col(value), rf"^{WHITE}+|{WHITE}+$", "")


def collapse_white(value: Column | str) -> Column:
    """Each run of white space as one space, trimmed; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(_col(value), F.lit("")), rf"{WHITE}+", " "))


def clean_title(value: Column | str, lowercase: bool = True) -> Column:
    out = collapse_white(value)
    return F.lower(out) if lowercase else out


def strip_to_text(value: Column | str) -> Column:
    """Any value as trimmed text; null becomes the empty text."""
    return F.coalesce(trim_white(_col(value).cast("string")), F.lit(""))


def strip_tags(value: Column | str) -> Column:
    """Every tag as a space, then white space collapsed."""
    return collapse_white(F.regexp_replace(F.coalesce(_col(value), F.lit("")), "<[^>]+>", " "))


def after(value: Column | str, mark: str) -> Column:
    """What follows the first occurrence of a mark; null if there is none."""
    at = F.locate(mark, _col(value))
    return F.when(at > 0, F.substring(_col(value), at + len(mark), F.length(_col(value))))


def between(value: Column | str, start: str, end: str) -> Column:
    """Between the first start mark and the first end mark behind it; the empty text if either is missing."""
    rest = after(value, start)
    stop = F.locate(end, rest)
    return F.coalesce(F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)), F.lit(""))


def h1_title(value: Column | str, start: str = "<H1>", end: str = "</H1>") -> Column:
    return trim_white(between(value, start, end))


def content_after_abstract(value: Column | str, paragraph: tuple[str, str] = ("<P>", "</P>"), list_end: str = "</Ul>") -> Column:
    """From behind the first paragraph up to the last but one list end (or the only one, or the end).

    The empty text if there is no paragraph, or if the range is empty. List ends are looked for in the whole text.
    """
    text = F.coalesce(_col(value), F.lit(""))
    opened = F.locate(paragraph[0], text)
    closed = F.when(opened > 0, F.locate(paragraph[1], F.substring(text, opened + len(paragraph[0]), F.length(text))))
    begin = F.when(closed > 0, opened + len(paragraph[0]) + closed - 1 + len(paragraph[1]))  # one-based
    parts = F.split(text, f"\\Q{list_end}\\E", -1)
    n = F.size(parts) - 1
    lengths = F.aggregate(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), F.lit(0), lambda total, p: total + F.length(p))
    marks = (F.greatest(n - 1, F.lit(1)) - 1) * len(list_end)
    stop = F.when(n > 0, lengths + marks).otherwise(F.length(text))  # zero-based, exclusive
    return F.coalesce(F.when(stop > begin - 1, F.substring(text, begin, (stop - begin + 1).cast("int"))), F.lit(""))


def url_parameter(url: Column | str, name: str) -> Column:
    """The first non-empty value of a query parameter, decoded; null if there is none or if an escape is broken."""
    plain = F.replace(_col(url), F.lit("&amp;"), F.lit("&"))
    raw = F.regexp_extract(plain, rf"^[^?#]*\?(?:[^#]*?&)?{name}=([^&#]+)", 1)
    return F.when(raw != "", F.try_url_decode(raw))


def url_title(url: Column | str, name: str = "title") -> Column:
    """The page title in a URL's query: decoded twice, underscores as spaces; the empty text if there is none."""
    once = url_parameter(url, name)
    twice = F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once)
    return F.coalesce(F.replace(twice, F.lit("_"), F.lit(" ")), F.lit(""))


def url_title_tolerant(url: Column | str) -> Column:
    """url_title for URLs with entities, spaces or broken escapes, which the native form gives up on. An Arrow function."""

    @pandas_udf("string")
    def titles(urls: pd.Series) -> pd.Series:
        def one(u: str | None) -> str:
            values = parse_qs(urlsplit(html.unescape(u)).query).get("title", [""]) if u else [""]
            return unquote(values[0]).replace("_", " ")

        return urls.map(one)

    return titles(_col(url))


def join_filled(*values: Column | str, separator: str = " ") -> Column:
    """The non-empty values joined."""
    return F.concat_ws(separator, *[F.nullif(_col(v), F.lit("")) for v in values])


def prefix(value: Column | str, n: int | None) -> Column:
    """The first n characters; everything if n is None or negative."""
    return _col(value) if n is None or n < 0 else F.substring(_col(value), 1, n)


def zero_fill(value: Column | str, width: int) -> Column:
    """Zeros in front up to the width; longer values stay whole."""
    text = _col(value).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def safe_name(value: Column | str) -> Column:
    """Runs of other characters than letters, digits, dot, underscore and hyphen as one underscore, none at the ends; never empty."""
    out = F.regexp_replace(F.regexp_replace(_col(value), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(out == "", F.lit("model")).otherwise(out)


def first_difference(a: Column | str, b: Column | str) -> Column:
    """Zero-based place of the first different character, the shorter length if one begins the other, null for equal texts.

    A binary search over prefixes: a few comparisons for a text of any length.
    """
    a, b = _col(a), _col(b)
    shorter = F.least(F.length(a), F.length(b))
    lo_hi = F.struct(F.lit(0).alias("lo"), shorter.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.when(s["lo"] >= s["hi"], s).otherwise(
            F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid - 1).alias("hi"))
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), lo_hi, halve, lambda s: s["lo"])
    return F.when(a == b, F.lit(None).cast("int")).otherwise(found)


def difference_window(a: Column | str, b: Column | str, at: Column | str, left: int = 40, right: int = 40) -> Column:
    """The surroundings of the first difference in both texts, white space made visible, and a caret below it."""

    def shown(text: Column) -> Column:
        for mark, name in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
            text = F.replace(text, F.lit(mark), F.lit(name))
        return text

    at = _col(at)
    begin = F.greatest(at - left, F.lit(0))
    before = shown(F.substring(_col(a), begin + 1, at - begin))
    rows = [shown(F.substring(_col(x), begin + 1, at - begin + right)) for x in (a, b)]
    return F.concat(F.lit("A: "), rows[0], F.lit("\nB: "), rows[1], F.lit("\n   "), F.repeat(F.lit(" "), F.length(before)), F.lit("^"))
