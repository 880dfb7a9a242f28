"""Text cleaning and composition of claim/article pairs (row-wise column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference's results.
# Zero-width characters deleted first: U+200B ZERO WIDTH SPACE .. U+200D ZERO
# WIDTH JOINER, and U+FEFF.
ZERO_WIDTH_CLASS = r"[\x{200B}-\x{200D}\x{FEFF}]"
# The code points Python's `\s` matches in a str pattern, spelled out because
# Java `\s`, `(?U)\s` and RE2 `\s` each differ from it.
WHITESPACE_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Nukta compositions, applied in this order: U+09A1 U+09BC -> U+09DC and
# U+09A2 U+09BC -> U+09DD.
NUKTA_PAIRS = [("\u09A1\u09BC", "\u09DC"), ("\u09A2\u09BC", "\u09DD")]
# Labels as written in the raw data.
POSITIVE_STATUS = "MANI"
NEGATIVE_STATUS = "NO_MANI"
# Markers of the composed texts.
CLAIM_TAG, ARTICLE_TAG, EXCERPT_TAG = "[CLAIM]", "[ARTICLE]", "[EXCERPT]"

STRATEGIES = ("sep_token", "concat", "claim_only", "excerpt")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_text(col) -> Column:
    """null -> ''; drop zero-width chars; compose nukta letters; collapse whitespace; strip."""
    c = F.coalesce(_c(col).cast("string"), F.lit(""))
    c = F.regexp_replace(c, ZERO_WIDTH_CLASS, "")
    for src, dst in NUKTA_PAIRS:
        c = F.replace(c, F.lit(src), F.lit(dst))
    c = F.regexp_replace(c, WHITESPACE_CLASS + "+", " ")
    return F.trim(c)


def label_binarize(col, positive: str = POSITIVE_STATUS) -> Column:
    """1 iff the status equals ``positive`` exactly; null or anything else -> 0."""
    return F.coalesce(_c(col) == F.lit(positive), F.lit(False)).cast("int")


def compose_text(claim, article, excerpt, strategy: str) -> Column:
    """One of the four composition strategies over *normalized* inputs."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy}")
    c, a, e = normalize_text(claim), normalize_text(article), normalize_text(excerpt)
    sep = F.concat(F.lit(CLAIM_TAG + " "), c, F.lit(" " + ARTICLE_TAG + " "), a)
    if strategy == "sep_token":
        return sep
    if strategy == "concat":
        return F.concat(c, F.lit(" "), a)
    if strategy == "claim_only":
        return c
    return F.when(e != F.lit(""),
                  F.concat(F.lit(CLAIM_TAG + " "), c, F.lit(" " + EXCERPT_TAG + " "), e)
                  ).otherwise(sep)


def text_length(col) -> Column:
    """Code points of the raw text, null -> 0."""
    return F.length(F.coalesce(_c(col), F.lit(""))).cast("int")


def is_present(col) -> Column:
    """1 iff the raw value is not null (a blank string counts as present)."""
    return _c(col).isNotNull().cast("int")


def fill_null_text(col, value: str = "") -> Column:
    """null -> ``value`` ('' when cleaning, 'nan' where the text was str()-ed)."""
    return F.coalesce(_c(col), F.lit(value))


def truncate_prefix(col, n: int) -> Column:
    """First ``n`` code points of the raw text (prompt templates only)."""
    return F.substring(_c(col), 1, n)
