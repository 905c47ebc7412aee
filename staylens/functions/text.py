"""Text expressions: letters only, tokens, stop words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens.functions.scalars import column

# White space that separates words: Unicode white space and the four separators.
SPACE = r"\s\x1c-\x1f"
LETTERS = "a-zA-Z"
UNICODE = "(?U)"

# The common English stop words.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its "
    "itself they them their theirs themselves what which who whom this that that'll "
    "these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren "
    "aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven "
    "haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()


def strip_non_letters(text: str | Column, strip_limit: int | None = None) -> Column:
    """Remove every character that is neither an ASCII letter nor white space.

    With ``strip_limit`` only the first so many such characters are removed and the
    rest of the text stays as it is.
    """
    text = F.coalesce(column(text), F.lit(""))
    other = f"[^{LETTERS}{SPACE}]"
    stripped = F.regexp_replace(text, f"{UNICODE}{other}+", "")
    if strip_limit is None:
        return stripped
    split = f"{UNICODE}(?s)^((?:[{LETTERS}{SPACE}]*+{other}){{{strip_limit}}})(.*)$"
    head, tail = F.regexp_extract(text, split, 1), F.regexp_extract(text, split, 2)
    cleaned = F.regexp_replace(head, f"{UNICODE}{other}+", "")
    return F.when(head == "", stripped).otherwise(F.concat(cleaned, tail))


def tokenize(text: str | Column, drop: Sequence[str] = ()) -> Column:
    """Words between white space, without those in ``drop``; no text, no words.

    Order and repeats stay; the test per word is one look-up in a hash set.
    """
    words = F.split(F.coalesce(column(text), F.lit("")), f"{UNICODE}[{SPACE}]+")
    dropped = sorted({"", *drop})
    return F.filter(words, lambda w: ~w.isin(dropped))


def letter_tokens(
    text: str | Column, strip_limit: int | None = None, drop: Sequence[str] = ()
) -> Column:
    return tokenize(F.lower(strip_non_letters(text, strip_limit)), drop)


def remove_stopwords(tokens: str | Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Drop stop words from an array of tokens, keeping order and repeats."""
    words = sorted(set(stop_words))
    if not words:
        return column(tokens)
    return F.filter(column(tokens), lambda w: ~w.isin(words))
