"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST_PATTERN = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_PREFIXED = (("x", "[0-9a-fA-F]", 16), ("o", "[0-7]", 8), ("b", "[01]", 2))


def full_host(url: Column) -> Column:
    """Lower-case host of an absolute url, '' when there is none."""
    return F.lower(F.regexp_extract(url, HOST_PATTERN, 1))


def host(url: Column) -> Column:
    """Host without a leading ``www.``; '' for text that is no url."""
    return F.regexp_replace(F.coalesce(full_host(url), F.lit("")), r"^www\.", "")


def with_root_path(url: Column) -> Column:
    """A bare domain gets its trailing slash, as url normalisers print it."""
    return F.when(url.rlike(r"(?i)^https?://[^/?#]+$"), F.concat(url, F.lit("/"))).otherwise(url)


def positive_whole_number(text: Column) -> Column:
    """A positive integer written in any of the usual literal forms, else null."""
    clean = F.trim(text)
    number = F.when(clean.rlike(_DECIMAL), clean.try_cast("double"))
    for letter, digits, base in _PREFIXED:
        literal = f"^0[{letter}{letter.upper()}]{digits}{{1,15}}$"
        number = F.coalesce(
            number,
            F.when(clean.rlike(literal), F.conv(F.substring(clean, 3, 64), base, 10).try_cast("double")),
        )
    whole = (number > 0) & (number == F.floor(number)) & (number < 9e15)
    return F.when(whole, number.cast("long"))


def source_id(url: Column) -> Column:
    """Source picked by a link: ``source_id``, else ``feed_id`` when it is absent."""

    def parameter(name: str) -> Column:
        return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))

    chosen = F.coalesce(parameter("source_id"), parameter("feed_id"))
    return positive_whole_number(F.try_url_decode(chosen))


def topic_link(word: Column, feed_id: Column) -> Column:
    return F.concat(
        F.lit("/news?q="), F.url_encode(word), F.lit("&source_id="), feed_id.cast("string")
    )
