"""Lexicon sentiment: the mean polarity of the words a lexicon knows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalars import column, sentiment_band
from staylens.functions.text import tokenize
from staylens.operators.checks import require_columns
from staylens.operators.stats import mean_and_median, mean_by, quantile_tails, value_counts
from staylens.runtime import join_sized, materialize, measure

SCORE = "sentiment_score"
BAND = "sentiment_category"


def sentiment_score(
    df: DataFrame,
    key: str,
    text: str,
    lexicon: DataFrame | None = None,
    modifiers: DataFrame | None = None,
    carry: Sequence[str] = (),
    out: str = SCORE,
    scorer: Callable | None = None,
) -> DataFrame:
    """(key, carry..., score in [-1, 1]); 0 for a text with no known word.

    ``lexicon`` is (token, polarity); several entries of a word are averaged.
    ``modifiers`` is (token, multiplier) and acts on the word that follows. ``key``
    identifies a row; ``carry`` names the few other columns to keep.

    Only key, carry and tokens are exploded. All tokens of a text are in one task, so
    the shuffle on the key moves about one partial sum per text. Polarities are added
    as decimals: the score does not depend on the order of addition.

    With ``scorer`` (a function from a pandas Series of texts to a Series of numbers)
    the caller's own model scores the texts instead, in Arrow batches.
    """
    require_columns(df, [key, text, *carry])
    keys = [key, *carry]
    if scorer is not None:
        score = F.pandas_udf(scorer, "double")(F.coalesce(column(text), F.lit("")))
        return df.select(*[column(c) for c in keys], F.coalesce(score, F.lit(0.0)).alias(out))
    if lexicon is None:
        raise ValueError("a lexicon or a scorer is needed")

    known = lexicon.groupBy("token").agg(F.avg("polarity").alias("_polarity"))
    words = df.select(*[column(c) for c in keys], tokenize(text).alias("_words"))
    if modifiers is None:
        tokens = words.select(*[column(c) for c in keys], F.explode_outer("_words").alias("token"))
    else:
        pairs = F.transform(
            "_words",
            lambda w, i: F.struct(w.alias("token"), F.get(F.col("_words"), i - 1).alias("_before")),
        )
        tokens = words.select(*[column(c) for c in keys], F.explode_outer(pairs).alias("_pair")).select(
            *[column(c) for c in keys], "_pair.token", "_pair._before"
        )
    tokens = join_sized(tokens, measure(known), ["token"], "left", [key])
    polarity = F.col("_polarity")
    if modifiers is not None:
        table = modifiers.groupBy(F.col("token").alias("_before")).agg(
            F.avg("multiplier").alias("_multiplier")
        )
        tokens = join_sized(tokens, measure(table), ["_before"], "left", [key])
        polarity = polarity * F.coalesce("_multiplier", F.lit(1.0))
    # greatest/least skip NULL, so an unknown word is put back to NULL first
    clamped = F.when(polarity.isNotNull(), F.least(F.greatest(polarity, F.lit(-1.0)), F.lit(1.0)))
    exact = clamped.cast("decimal(18,9)")
    total = F.sum(exact).cast("double")
    return tokens.groupBy(*[column(c).alias(c) for c in keys]).agg(
        F.coalesce(F.try_divide(total, F.count(exact)), F.lit(0.0)).alias(out)
    )


def add_sentiment(
    df: DataFrame, key: str, text: str, lexicon: DataFrame, modifiers: DataFrame | None = None
) -> DataFrame:
    """The whole rows of ``df`` with their score and band (joins on the key)."""
    scores = sentiment_score(df, key, text, lexicon, modifiers)
    return add_band(df.join(scores, key, "left"))


def add_band(df: DataFrame, score: str = SCORE, out: str = BAND, cutoff: float = 0.1) -> DataFrame:
    return df.withColumn(out, sentiment_band(score, cutoff))


def sentiment_summary(df: DataFrame, score: str = SCORE) -> DataFrame:
    """One row (mean, median), from one pass over the scores."""
    return mean_and_median(df, score)


def sentiment_by_group(df: DataFrame, key: str, score: str = SCORE) -> DataFrame:
    return mean_by(df, key, score, "mean_sentiment")


def sentiment_band_counts(df: DataFrame, score: str = SCORE) -> DataFrame:
    return value_counts(add_band(df, score), BAND)


def sentiment_tails(df: DataFrame, score: str = SCORE, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The rows at or beyond the quantiles. The scores are read twice, so they are stored first."""
    return quantile_tails(materialize(df), score, low, high)
