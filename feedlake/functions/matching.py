"""Full-text predicates over documents kept as padded token strings.

A document is one string of lower-case tokens, each with a blank on both sides,
so a word or a phrase is a plain ``contains`` that stays in generated code.
Tokens are runs of letters and digits; markup tags are skipped; a url column
also contributes its whole host as one token.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake.functions.links import full_host

#: A piece of a search: minus and quoted phrase, or a bare word.
PIECE = r'(-?)"([^"]*)"?|(\S+)'
_PIECE = re.compile(PIECE)
_WORDS = re.compile(r"[^\W_]+")

#: A tag, or a token as group 1.
TOKEN = r"<[^>]*>|([\p{L}\p{N}]+)"


def _text(part: Column) -> Column:
    return F.coalesce(part, F.lit(""))


def words(parts: list[Column], url: Column | None = None) -> Column:
    """Tokens of the parts in order, as an array; markup tags are stepped over."""
    pieces = parts + ([url] if url is not None else [])
    joined = F.lower(F.concat_ws(" ", *[_text(p) for p in pieces]))
    return F.array_remove(F.regexp_extract_all(joined, F.lit(TOKEN), F.lit(1)), "")


def document(parts: list[Column], url: Column | None = None) -> Column:
    """Padded token string of the parts."""
    padded = F.concat(F.lit(" "), F.array_join(words(parts, url), " "), F.lit(" "))
    if url is None:
        return padded
    # The line break keeps a phrase from running into the host token.
    return F.concat(padded, F.lit("\n "), full_host(_text(url)), F.lit(" "))


def token_set(parts: list[Column], url: Column | None = None) -> Column:
    """Distinct tokens of the parts, the url's host included."""
    found = words(parts, url)
    if url is None:
        return F.array_distinct(found)
    host = F.array(full_host(_text(url)))
    return F.array_remove(F.array_distinct(F.concat(found, host)), "")


def item_document(title: Column, url: Column) -> Column:
    return document([title], url)


def detail_document(summary: Column, content: Column, author: Column) -> Column:
    return document([summary, content, author])


def feed_document(title: Column, url: Column) -> Column:
    return document([title], url)


def clean_query(text: str | None) -> str | None:
    """A blank search box means no filter."""
    return (text or "").strip() or None


def query_terms(query: str) -> list[list[tuple[bool, str]]]:
    """Web-style search text as alternatives of (negated, phrase) terms.

    Bare words must all occur, ``or`` starts an alternative, quotes make a
    phrase, a leading minus excludes.  A compound such as a host or a hyphenated
    word is the phrase of its parts; words without letters or digits vanish.
    """
    alternatives: list[list[tuple[bool, str]]] = [[]]
    for minus, quoted, word in _PIECE.findall(query.lower()):
        if word == "or":
            alternatives.append([])
            continue
        negated = bool(minus) or word.startswith("-")
        phrase = " ".join(_WORDS.findall(quoted or word))
        if phrase:
            alternatives[-1].append((negated, phrase))
    return [terms for terms in alternatives if terms]


def matches_nothing(query: str) -> bool:
    """Does a document without any word satisfy the query?"""
    return any(all(negated for negated, _ in terms) for terms in query_terms(query))


def matches(doc: Column, query: str) -> Column:
    """Does one document satisfy the query?  Nothing to look for matches nothing."""
    found = F.lit(False)
    for terms in query_terms(query):
        every = F.lit(True)
        for negated, phrase in terms:
            hit = F.contains(doc, F.lit(f" {phrase} "))
            every = every & (~hit if negated else hit)
        found = found | every
    return found
