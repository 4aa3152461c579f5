"""Text expressions: title words, external ids, previews."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that never enter the title index, by language.
NORWEGIAN_STOP_WORDS = """
a alle at av bare ble bli blir da de deg dei dem den denne der dere deres det dette din disse då du
eg ein eit eller en er et etter for fordi fra før få får fikk ha hadde han hans har hatt hele henne
hennes her hos hun andre flere fortsatt går gir gjør hva hvem hvilke hvilken hvis hvor hvordan
hvorfor i ikke ingen inn jeg kan kom kunne man me med meg mellom men mens mer mi min mine mitt mot
må ned noe noen nok nå når og også nye om opp oss over på samme seg selv si siden sier sin sine
sitt skal slik som så til under uten ut var ved vi vil ville vår våre vårt være å
""".split()
ENGLISH_STOP_WORDS = """
about above after again against all also am an and any are as at be because been before being below
between both but by can did do does doing down during each few from further get had has have having
he her here him his how if in into is it its itself just like make me more most my new no not now
of off on once one only or other our out over own s said same say says she should so some such t
than that the their them then there these they this those through to too under until up us very was
we were what when where which while who whom why will with you your
""".split()
# Letters a title word is made of; everything else separates words.
WORD_LETTERS = "a-zA-ZæøåÆØÅ"
MIN_WORD_LENGTH = 2

DEFAULT_STOP_WORDS = tuple(NORWEGIAN_STOP_WORDS + ENGLISH_STOP_WORDS)

#: White space as browsers see it (regex character class body).
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Length of a card preview.
PREVIEW_LENGTH = 240


def long_words(title: Column) -> Column:
    """Words of a title that are long enough, in order, lower-cased, as an array.

    The letters are looked for before lower-casing, so an accented letter that
    lower-cases to a plain one still separates words.
    """
    run = F.lit(f"[{WORD_LETTERS}]{{{MIN_WORD_LENGTH},}}")
    return F.transform(F.regexp_extract_all(title, run, F.lit(0)), F.lower)


def is_topical(word: Column, stop_words: Iterable[str] = DEFAULT_STOP_WORDS) -> Column:
    stop = sorted(set(stop_words))
    return ~word.isin(stop) if stop else F.lit(True)


def http_only(text: Column) -> Column:
    return text.startswith("http://") | text.startswith("https://")


def normalize_external_id(identifier: Column) -> Column:
    """Drop the fragment of http(s) identifiers, so rotating ones stay stable."""
    return F.when(http_only(identifier), F.substring_index(identifier, "#", 1)).otherwise(identifier)


def external_id(guid: Column, link: Column, title: Column, published_rfc3339: Column) -> Column:
    """Identifier of an entry: its id, else its first link, else title and date."""
    fallback = F.concat(
        F.lit("fallback:"),
        F.coalesce(title, F.lit("")),
        F.lit(":"),
        F.coalesce(published_rfc3339, F.lit("")),
    )
    return F.coalesce(normalize_external_id(blank_to_null(guid)), normalize_external_id(link), fallback)


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def compact_text(text: Column) -> Column:
    """Tags become blanks, runs of white space collapse, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), f"[{SPACES}]+", " "))


def preview_text(summary: Column, content: Column) -> Column:
    return F.coalesce(
        blank_to_null(compact_text(summary)), blank_to_null(compact_text(content)), F.lit("")
    )


def truncate(text: Column, max_length: int = PREVIEW_LENGTH) -> Column:
    """Cut to ``max_length`` code points, the last one an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, max_length - 1), f"[{SPACES}]+$", "")
    return F.when(F.length(text) <= max_length, text).otherwise(F.concat(cut, F.lit("…")))


def trimmed(text: Column) -> Column:
    """Both ends trimmed of any white space; blank becomes null."""
    return blank_to_null(F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", ""))


def feed_name(title: Column, site_url: Column, url: Column) -> Column:
    """Display name: first non-blank of title and site, else the feed url."""
    return F.coalesce(trimmed(title), trimmed(site_url), url)


def feed_label(title: Column, url: Column) -> Column:
    """Short label used next to items: any non-null title (even blank), else url."""
    return F.coalesce(title, url)
