"""Prompt construction and reply parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.text import fill_null_text, truncate_prefix

# Fixed values of the reference: prompt templates and prefix lengths.
ARTICLE_PREFIX = 600
EXAMPLE_PREFIX = 300
PROMPT_HEAD = ("You are a Bangla news fact-checker. Compare the claim with the article "
               "and decide if the claim has been manipulated.\n\n")
ZERO_SHOT_QUESTION = ("Has the claim been manipulated? A claim is manipulated if names, numbers, "
                      "locations or roles were changed.\nAnswer with only: MANI or NO_MANI")
FEW_SHOT_TAIL = "\nAnswer with only: MANI or NO_MANI"
# Reply parsing: upper-cased reply; these substrings decide the label in order.
NEGATIVE_MARKERS = ("NO_MANI", "NO MANI")
POSITIVE_MARKERS = ("MANI", "YES")

STRATEGIES = ("zero_shot", "few_shot_3")


def _str(col) -> Column:
    """Text as the reference's str() renders it: null becomes 'nan'."""
    return fill_null_text(F.col(col) if isinstance(col, str) else col, "nan")


def zero_shot_prompt(claim="mani_news", article="original_news_article") -> Column:
    return F.concat(F.lit(PROMPT_HEAD + "Claim: "), _str(claim), F.lit("\n\nArticle: "),
                    truncate_prefix(_str(article), ARTICLE_PREFIX), F.lit("\n\n" + ZERO_SHOT_QUESTION))


def example_block(position="position", claim="claim", article="article", status="status") -> Column:
    """One 'Example i:' block of a few-shot prompt."""
    return F.concat(F.lit("Example "), F.col(position).cast("string"), F.lit(":\nClaim: "), _str(claim),
                    F.lit("\nArticle: "), truncate_prefix(_str(article), EXAMPLE_PREFIX),
                    F.lit("\nAnswer: "), _str(status), F.lit("\n\n"))


def few_shot_examples(train: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(row_id, claim, article, status, label, position) of k sampled training rows."""
    from claimlens.operators.splits import few_shot_sample
    return few_shot_sample(train, k=k, seed=seed).select(
        "row_id", F.col("mani_news").alias("claim"), F.col("original_news_article").alias("article"),
        F.col("mani_status").alias("status"), "label", "position")


def examples_text(examples: DataFrame) -> Column:
    """All example blocks in position order, as a scalar subquery: the k-row
    example table is evaluated once and its one value reaches every task."""
    blocks = examples.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("position"), example_block().alias("b")))),
        lambda x: x["b"]), "").alias("t"))
    return blocks.scalar()


def few_shot_prompt(examples_col: Column, claim="mani_news", article="original_news_article") -> Column:
    return F.concat(F.lit(PROMPT_HEAD), examples_col, F.lit("Now analyze this:\nClaim: "), _str(claim),
                    F.lit("\nArticle: "), truncate_prefix(_str(article), ARTICLE_PREFIX), F.lit("\n" + FEW_SHOT_TAIL))


def parse_reply_label(col) -> Column:
    """0 if the upper-cased reply has NO_MANI / NO MANI; else 1 if it has MANI
    (so 'not manipulated' and 'Romania' are 1) or YES (so 'eyes' is 1); else 0."""
    u = F.upper(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    neg = u.contains(NEGATIVE_MARKERS[0]) | u.contains(NEGATIVE_MARKERS[1])
    pos = u.contains(POSITIVE_MARKERS[0]) | u.contains(POSITIVE_MARKERS[1])
    return F.when(neg, F.lit(0)).when(pos, F.lit(1)).otherwise(F.lit(0))
