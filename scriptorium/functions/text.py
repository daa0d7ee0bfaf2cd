"""Scalar text functions as columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII punctuation and the articles that answer matching ignores.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")

#: Unicode white space, with the four ASCII separators that Java leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def collapse(text: Column) -> Column:
    """White space runs as one space, none at either end."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def strip(text: Column) -> Column:
    """Unicode white space removed at both ends only."""
    return F.regexp_replace(text, rf"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_blank(text: Column) -> Column:
    return collapse(text) == ""


def match_key(text: Column) -> Column:
    """Lower case with collapsed white space; punctuation stays."""
    return collapse(F.lower(text))


def answer_tokens(text: Column) -> Column:
    """Words of an answer: lower case, punctuation deleted, articles dropped.

    Deleting punctuation joins the parts of hyphened words.  Articles are
    dropped as tokens, which does not depend on any engine's idea of a word
    boundary.
    """
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.filter(F.split(collapse(bare), " "), lambda t: ~t.isin("", *ARTICLES))


def normalize_answer(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def words(text: Column) -> Column:
    """Words between white space; an empty array for blank texts."""
    return F.filter(F.split(collapse(text), " "), lambda t: t != "")


def default_if_blank(text: Column, default: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(strip(text), F.lit("")), F.lit(default))


def without_rules(text: Column) -> Column:
    """Lines that are only ``---`` removed, so that they cannot end a header."""
    return F.array_join(F.filter(F.split(text, "\r\n|\r|\n"), lambda line: strip(line) != "---"), "\n")


def quoted_title(title: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"'))


def numbered_context(texts: Column) -> Column:
    """``[1] first``, blank line, ``[2] second`` and so on."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n\n")


def object_with_keys(json: Column, keys: tuple[str, ...]) -> Column:
    """The JSON object as a map if it has all keys (null values count), else null."""
    parsed = F.from_json(json, "map<string,string>")
    has_all = F.lit(True)
    for key in keys:
        has_all = has_all & F.map_contains_key(parsed, key)
    return F.when(has_all, parsed)
