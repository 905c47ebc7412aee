"""Column expressions: coercion, bands and hashes. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number; anything else (units, currency signs, commas) is missing.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+|(?i:inf(inity)?))([eE][+-]?\d+)?\s*$"

# The band names and the sentiment cut-off, as users know them.
HIGH, MEDIUM, LOW = "High", "Medium", "Low"
POSITIVE, NEUTRAL, NEGATIVE = "Positive", "Neutral", "Negative"
SENTIMENT_CUTOFF = 0.1

# Longer strings are grouped by digest; a digest key has 65 characters, so it can
# never equal a string that is short enough to stand for itself.
_PLAIN_KEY_LENGTH = 64


def column(name_or_column: str | Column) -> Column:
    return F.col(f"`{name_or_column}`") if isinstance(name_or_column, str) else name_or_column


def to_number(text: str | Column) -> Column:
    """Text to double; text that is not a number becomes NULL."""
    text = column(text).cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def percent_to_ratio(text: str | Column) -> Column:
    """``'90%'`` to 0.9; malformed text becomes NULL."""
    return to_number(F.regexp_replace(column(text), "%+$", "")) / 100


def present(value: str | Column, is_float: bool) -> Column:
    """True where there is a value: neither NULL nor, for floats, NaN."""
    value = column(value)
    return value.isNotNull() & ~F.isnan(value) if is_float else value.isNotNull()


def quantile_band(value: str | Column, low: float | None, high: float | None) -> Column:
    """High above ``high``, Low below ``low``, else Medium - missing values too."""
    value = column(value)
    bound = lambda number: F.lit(number).cast("double")
    # Spark orders NaN above every number; here it is a missing value.
    value = F.when(~F.isnan(value), value)
    return F.when(value > bound(high), HIGH).when(value < bound(low), LOW).otherwise(MEDIUM)


def sentiment_band(score: str | Column, cutoff: float = SENTIMENT_CUTOFF) -> Column:
    score = column(score)
    return F.when(score > cutoff, POSITIVE).when(score < -cutoff, NEGATIVE).otherwise(NEUTRAL)


def hash_number(key: str | Column, seed: int) -> Column:
    """A number in [0, 2**32) that depends on the key and seed only."""
    digest = F.md5(F.concat(F.lit(str(seed)), column(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def grouping_key(value: Column, is_text: bool, is_float: bool) -> Column:
    """A narrow stand-in for ``value`` that is equal exactly when the value is.

    Long texts are replaced by their SHA-256 digest, so that grouping whole rows
    shuffles a few dozen bytes per text column.
    """
    if is_text:
        digest = F.concat(F.lit("#"), F.sha2(value, 256))
        return F.when(F.length(value) > _PLAIN_KEY_LENGTH, digest).otherwise(value)
    if is_float:  # NaN is a missing value
        return F.when(~F.isnan(value), value)
    return value
