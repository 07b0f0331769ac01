"""Text helpers as column expressions: byte-exact cuts, titles, previews, tokens, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canon import col

#: Terms are runs of letters and digits, lower-cased, of fewer bytes than this.
LONGEST_TERM = 40


def cut_bytes(text: Column | str, n: int) -> Column:
    """The longest prefix of at most n bytes that ends between characters."""
    text = col(text)
    raw = F.encode(text, "UTF-8")
    inside = lambda k: F.conv(F.hex(F.substring(raw, k + 1, 1)), 16, 10).cast("int").between(0x80, 0xBF)  # noqa: E731  byte k (from 0) continues one
    out = F.decode(F.substring(raw, 1, n - 3), "UTF-8")
    for back in (2, 1, 0):
        out = F.when(~inside(n - back), F.decode(F.substring(raw, 1, n - back), "UTF-8")).otherwise(out)
    return F.when(F.octet_length(text) <= n, text).otherwise(out)


def truncated(text: Column | str, n: int) -> Column:
    """At most n bytes; what is longer is cut at n - 3 bytes or before, and ``...`` follows."""
    text = col(text)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(cut_bytes(text, n - 3), F.lit("...")))


def preview(text: Column | str, n: int = 300) -> Column:
    """The first n bytes, and ``...`` if there are more."""
    text = col(text)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(cut_bytes(text, n), F.lit("...")))


def first_line(text: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(col(text), "\n", 1), "\r$", "")


def title(own: Column | str, first_user: Column | str) -> Column:
    return F.coalesce(col(own), truncated(first_line(first_user), 100), F.lit("Untitled"))


def terms(text: Column | str) -> Column:
    """Index terms in order, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda t: F.octet_length(t) < LONGEST_TERM)


def snippet(preview_: Column | str, query: str) -> Column:
    """Up to 50 characters before and 100 after the first query term found, marked; else the preview's beginning."""
    words = query.split()
    if not query:
        return F.lit(None).cast("string")
    text = col(preview_)
    low = F.lower(text)
    out = F.when(F.length(text) > 150, F.concat(F.substring(text, 1, 150), F.lit("..."))).otherwise(text)
    for word in reversed(words):
        w = word.lower()
        at = F.locate(w, low)  # from 1
        begin = F.greatest(at - 50, F.lit(1))
        part = F.substring(text, begin, at + len(w) + 100 - begin)
        own = F.substring(text, at, F.lit(len(w)))
        out = F.when(at > 0, F.replace(part, F.lit(w), F.concat(F.lit("<mark>"), own, F.lit("</mark>")))).otherwise(out)
    return out


def sanitized(text: Column | str) -> Column:
    """Control and direction characters made visible."""
    return F.regexp_replace(col(text), "[\\x00-\\x1f\\x7f-\\x9f\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069]", "�")
