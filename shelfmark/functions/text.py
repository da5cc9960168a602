"""Text analysis expressions: tokens, stop words, a light English stemmer and hashed buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.vector import bind

#: The default English stop words of the analyzer whose behaviour is followed.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def tokens(text: Column, chars: str = "a-z0-9") -> Column:
    """Lower-case runs of the characters of a class, in order, repeats included; null gives none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[^{chars}]+"), "")


def possessive_tokens(text: Column) -> Column:
    """As :func:`tokens`, with what follows an apostrophe."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+(?:'[a-z]+)?)"), F.lit(1))


def stem(word: Column) -> Column:
    """Strips possessives, plurals, -ing, -ed and -er, undoubles the last consonant and drops a final e.

    Short words are left alone; the aim is that inflections of a word meet, not that stems are words.
    """
    plural = lambda w: (
        F.when(w.rlike("(ss|us|is)$"), w).when(w.rlike("..ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(w, "es$", ""))
        .when(F.length(w) > 3, F.regexp_replace(w, "s$", "")).otherwise(w)
    )
    ending = lambda w: F.when(w.rlike("[aeiouy].*(ing|ed|er)$") & (F.length(w) > 5), F.regexp_replace(w, "(ing|ed|er)$", "")).otherwise(w)
    double = lambda w: F.when(w.rlike("(bb|dd|gg|mm|nn|pp|rr|tt)$"), F.regexp_replace(w, r"(.)\1$", "$1")).otherwise(w)
    last_e = lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "e$", "")).otherwise(w)
    steps = [plural, ending, double, last_e]
    held = F.regexp_replace(word, "'s?$", "")
    for step in steps:
        held = bind(held, step)
    return held


def analyze(text: Column, stemmed: bool = True) -> Column:
    """Tokens without stop words, stemmed."""
    words = possessive_tokens(text) if stemmed else tokens(text)
    kept = F.filter(words, lambda t: ~t.isin(*STOP_WORDS))
    return F.transform(kept, stem) if stemmed else kept


def bucket(token: Column, dims: int = 768) -> Column:
    """The hashing trick: CRC-32 of the token modulo ``dims``."""
    return (F.crc32(F.encode(token, "UTF-8")) % dims).cast("int")
