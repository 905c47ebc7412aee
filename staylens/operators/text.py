"""Comments to normalised text.

Without lemmas everything happens inside the row. With a lemma table only the key
and the tokens are exploded, never the wide row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalars import column
from staylens.functions.text import ENGLISH_STOP_WORDS, letter_tokens
from staylens.operators.checks import require_columns
from staylens.runtime import join_sized, measure

# Noun endings and what they become when an ending is taken off.
NOUN_ENDINGS = (
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
)


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """(token, n) over the letters-only, lower-case tokens of a text column."""
    require_columns(df, [text])
    return (
        df.select(F.explode(letter_tokens(text)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def lemma_lookup(
    df: DataFrame, key: str, tokens: str, lemmas: DataFrame, out: str = "processed"
) -> DataFrame:
    """(key, text): tokens replaced by their lemma and joined with blanks.

    ``lemmas`` is (token, lemma); a token without a lemma stays. ``key`` identifies
    a row, so what is put back together is one text.

    The texts are partitioned by key before they are exploded: the regrouping then
    needs no further shuffle, and what moves is text instead of numbered words.
    """
    require_columns(df, [key, tokens])
    table = lemmas.groupBy("token").agg(F.min("lemma").alias("lemma"))
    arrays = df.select(column(key).alias("_key"), column(tokens).alias("_tokens")).repartition("_key")
    exploded = arrays.select("_key", F.posexplode_outer("_tokens").alias("pos", "token"))
    looked_up = join_sized(exploded, measure(table), ["token"], "left", ["_key", "pos"])
    word = F.struct("pos", F.coalesce("lemma", "token").alias("word"))
    words = F.collect_list(F.when(F.col("token").isNotNull(), word))
    return (
        looked_up.groupBy("_key")
        .agg(F.array_sort(words).alias("w"))
        .select(F.col("_key").alias(key), F.array_join(F.col("w.word"), " ").alias(out))
    )


def noun_lemmas(
    tokens: DataFrame, nouns: DataFrame, exceptions: DataFrame | None = None
) -> DataFrame:
    """(token, lemma) for the distinct ``tokens`` whose shortest known noun form differs.

    A form is the token itself or the token with a noun ending taken off. For a token in
    ``exceptions`` (token, lemma) the entries stand in place of the endings. A form counts
    when it occurs in ``nouns`` (token).
    """
    word = F.col("token")
    forms = [F.struct(F.lit(0).alias("order"), word.alias("lemma"))]
    for order, (ending, instead) in enumerate(NOUN_ENDINGS, start=1):
        stem = F.concat(F.expr(f"left(token, length(token) - {len(ending)})"), F.lit(instead))
        forms.append(F.when(word.endswith(ending), F.struct(F.lit(order).alias("order"), stem.alias("lemma"))))
    words = tokens.select("token").where(word.isNotNull()).distinct()
    known = nouns.select(word.alias("lemma")).distinct()
    candidates = words.select("token", F.explode(F.array(*forms)).alias("f")).select(
        "token", F.col("f.order").alias("order"), F.col("f.lemma").alias("lemma")
    )
    if exceptions is not None:
        irregular = exceptions.where("token is not null and lemma is not null").join(words, "token", "left_semi").select(
            "token", F.lit(len(forms)).alias("order"), "lemma"
        )
        regular = candidates.where("order > 0").join(irregular.select("token").distinct(), "token", "left_anti")
        candidates = candidates.where("order = 0").unionByName(regular).unionByName(irregular)
    best = F.min(F.struct(F.length("lemma").alias("size"), "order", "lemma"))
    return (
        candidates.where(F.col("lemma").isNotNull())
        .join(known, "lemma", "left_semi")
        .groupBy("token")
        .agg(best.alias("best"))
        .select("token", F.col("best.lemma").alias("lemma"))
        .where(F.col("lemma") != F.col("token"))
    )


def normalize_text(
    df: DataFrame,
    text: str,
    out: str = "processed_comments",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    lemmas: DataFrame | None = None,
    key: str | None = None,
    strip_limit: int | None = None,
) -> DataFrame:
    """Letters only, lower case, no stop words, lemmas; a missing text becomes "".

    Without ``lemmas`` a column is added to ``df``. With them the result is
    (key, <out>), to be joined where it is needed.
    """
    require_columns(df, [text])
    words = letter_tokens(text, strip_limit, stop_words)
    if lemmas is None:
        return df.withColumn(out, F.array_join(words, " "))
    if key is None:
        raise ValueError("lemmas need the key of the row")
    require_columns(df, [key])
    return lemma_lookup(df.select(column(key), words.alias("_words")), key, "_words", lemmas, out)

