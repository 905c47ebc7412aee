"""From comments to sentiment statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from staylens.functions.text import ENGLISH_STOP_WORDS
from staylens.operators.distribution import correlation, histogram
from staylens.operators.sentiment import (
    SCORE,
    add_band,
    sentiment_band_counts,
    sentiment_by_group,
    sentiment_score,
    sentiment_summary,
)
from staylens.operators.stats import quantile_tails
from staylens.operators.text import normalize_text
from staylens.runtime import materialize

PROCESSED = "processed_comments"


def score_comments(
    df: DataFrame,
    key: str,
    text: str,
    lexicon: DataFrame,
    carry: Sequence[str] = (),
    modifiers: DataFrame | None = None,
    lemmas: DataFrame | None = None,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """(key, carry..., sentiment_score, sentiment_category) of normalised comments."""
    if lemmas is None:
        processed = normalize_text(df, text, PROCESSED, stop_words)
        scored = sentiment_score(processed, key, PROCESSED, lexicon, modifiers, carry)
    else:
        processed = normalize_text(df, text, PROCESSED, stop_words, lemmas, key)
        scored = sentiment_score(processed, key, PROCESSED, lexicon, modifiers)
        if carry:
            scored = scored.join(df.select(key, *[f"`{c}`" for c in carry]), key, "left")
    return add_band(scored, SCORE)


def comment_report(
    df: DataFrame,
    key: str,
    text: str,
    lexicon: DataFrame,
    groups: Sequence[str],
    rating: str,
    modifiers: DataFrame | None = None,
    lemmas: DataFrame | None = None,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> dict[str, DataFrame]:
    """Summary, distribution, group means, correlation with the rating, and extremes.

    The comments are normalised and scored once, when this is called; all results read the
    stored scores. ``modifiers``, ``lemmas`` and ``stop_words`` are those of :func:`score_comments`.
    """
    scored = materialize(score_comments(df, key, text, lexicon, [*groups, rating], modifiers, lemmas, stop_words))
    return {
        "scores": scored,
        "summary": sentiment_summary(scored),
        "histogram": histogram(scored, SCORE, 50),
        "bands": sentiment_band_counts(scored.drop("sentiment_category")),
        "correlation": correlation(scored, SCORE, rating),
        "tails": quantile_tails(scored, SCORE),
        **{f"by_{g}": sentiment_by_group(scored, g) for g in groups},
    }
