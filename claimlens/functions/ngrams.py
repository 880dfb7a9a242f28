"""Tokenizers and n-gram generators as higher-order column expressions.

Token arrays are bound once with ``transform(array(tokens), k -> ...)[0]``:
referencing the token expression directly inside the n-gram lambdas lets the
optimizer inline and re-evaluate the regex for every n.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens.functions.text import WHITESPACE_CLASS

# A word token is a maximal run of at least two word characters,
# a word character being a letter, a number or '_' (what Python's `\w` matches;
# combining marks are not word characters, so Bengali words split at vowel signs).
WORD_TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# An option of this library: combining marks kept inside words.
WORD_TOKEN_PATTERN_MARKS = r"[\p{L}\p{M}\p{N}_]{2,}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def word_tokens(col, mark_aware: bool = False) -> Column:
    """Lower-cased word tokens (array<string>)."""
    pat = WORD_TOKEN_PATTERN_MARKS if mark_aware else WORD_TOKEN_PATTERN
    return F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(pat), F.lit(0))


def _grow(k: Column, prev: Column, m: int, lo: int, hi: int, parts: list) -> Column:
    """Concatenate the n-grams of ``k`` for n in lo..hi.  ``prev`` holds the
    (m-1)-grams; the m-grams pair each of them with the token m-1 places on
    (``zip_with``), so every level reuses the previous one instead of slicing
    and re-joining the token array per gram.  Each level is bound once."""
    parts = parts + ([prev] if m - 1 >= lo else [])
    if m > hi:
        return F.concat(*parts)
    cnt = F.greatest(F.size(k) - F.lit(m - 1), F.lit(0))
    nxt = F.zip_with(F.slice(prev, 1, cnt), F.slice(k, m, cnt), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.transform(F.array(nxt), lambda g: _grow(k, g, m + 1, lo, hi, parts)).getItem(0)


def word_ngrams(col, ngram_range=(1, 3), mark_aware: bool = False) -> Column:
    """All word n-grams for n in the range, joined by one space, repeats kept."""
    lo, hi = ngram_range
    bound = F.transform(F.array(word_tokens(col, mark_aware)), lambda k: _grow(k, k, 2, lo, hi, []))
    return bound.getItem(0)


def char_wb_words(col) -> Column:
    """The whitespace-separated words of the lower-cased text, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(_c(col), F.lit(""))), WHITESPACE_CLASS + "+"), lambda w: w != F.lit(""))


def char_wb_word_ngrams(word: Column, ngram_range=(2, 5)) -> Column:
    """The n-grams of one word, padded with one space on each side."""
    lo, hi = ngram_range
    padded = F.array(F.concat(F.lit(" "), word, F.lit(" ")))
    return F.transform(padded, lambda p: F.flatten(F.transform(
        F.sequence(F.lit(lo), F.least(F.lit(hi), F.length(p))),
        lambda n: F.transform(F.sequence(F.lit(1), F.length(p) - n + 1),
                              lambda i: F.substring(p, i, n))))).getItem(0)


def char_wb_ngrams(col, ngram_range=(2, 5)) -> Column:
    """In-word character n-grams: each whitespace-separated word of the
    lower-cased text is padded with one space on each side; every substring of
    length lo..min(hi, padded length) is emitted (a padded word shorter than
    ``hi`` yields itself once, never longer grams)."""
    return F.flatten(F.transform(char_wb_words(col), lambda w: char_wb_word_ngrams(w, ngram_range)))
