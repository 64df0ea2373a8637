"""Keyword, style and penalty columns for replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import WHITESPACE, word_count

MAX_WORDS = 30
STYLE_BONUS = 0.1


def keyword_hits(reply: Column, keywords: Column) -> Column:
    """Keywords found anywhere inside the reply, in keyword order."""
    return F.filter(keywords, lambda kw: F.contains(reply, kw))


def style_ok(reply: Column) -> Column:
    return (reply == F.lower(reply)) & (word_count(reply) <= MAX_WORDS)


def case_score(n_hits: Column, n_keywords: Column, style: Column) -> Column:
    share = n_hits.cast("double") / F.greatest(n_keywords, F.lit(1)).cast("double")
    return F.least(share + F.when(style, F.lit(STYLE_BONUS)).otherwise(F.lit(0.0)), F.lit(1.0))


def excess_words(reply: Column, limit: int = MAX_WORDS) -> Column:
    return F.greatest(word_count(reply) - limit, F.lit(0))


def garbled_share(reply: Column) -> Column:
    """Share of replacement and control characters."""
    kept = F.regexp_replace(reply, r"[\x{FFFD}\x00-\x08\x0e-\x1b\x7f]", "")
    length = F.length(reply)
    return F.when(length == 0, F.lit(0.0)).otherwise(
        (length - F.length(kept)).cast("double") / length.cast("double")
    )


def repeated_share(reply: Column, n: int = 2) -> Column:
    """One minus the share of distinct word ``n``-grams; 0 where there is none."""
    words = F.filter(F.split(reply, WHITESPACE + "+"), lambda w: w != "")
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    grams = words
    for k in range(1, n):
        grams = F.zip_with(
            F.slice(grams, F.lit(1), count), F.slice(words, F.lit(1 + k), count), lambda a, b: F.concat_ws(" ", a, b)
        )
    return F.when(count == 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - F.size(F.array_distinct(grams)).cast("double") / count.cast("double")
    )
