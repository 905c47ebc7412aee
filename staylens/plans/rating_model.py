"""From cleaned rows to a tuned classifier of the rating class."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from staylens.functions.scalars import column
from staylens.functions.text import ENGLISH_STOP_WORDS
from staylens.operators.evaluate import classification_report, confusion_matrix
from staylens.operators.features import label_encode
from staylens.operators.models import GridSearch, TreeFamily, depth_sweep, grid_search, prepare
from staylens.operators.sentiment import SCORE
from staylens.operators.stats import rating_bands
from staylens.plans.comments import score_comments

# What a listing-review table offers the model.
ENCODED_COLUMNS = ("Property Type", "Room Type", "Host Response Rate", "Is Superhost")
NUMBER_COLUMNS = ("Price", "Reviews")


def review_features(
    cleaned: DataFrame,
    lexicon: DataFrame,
    key: str = "Review ID",
    comments: str = "Comments",
    area: str = "neighbourhood",
    rating: str = "Overall Rating",
    numbers: Sequence[str] = NUMBER_COLUMNS,
    categories: Sequence[str] = ENCODED_COLUMNS,
    modifiers: DataFrame | None = None,
    lemmas: DataFrame | None = None,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """(key, rating, numbers..., categories..., <area>_encoded, sentiment_score).

    Comments are scored on their own; only the columns a model needs are joined to
    the scores by key.
    """
    scored = score_comments(cleaned, key, comments, lexicon, (), modifiers, lemmas, stop_words)
    scores = scored.select(column(key), SCORE)
    narrow = cleaned.select(*[column(c) for c in (key, rating, area, *numbers, *categories)])
    encoded = label_encode(narrow, area, spread=[key]).drop(area)
    return encoded.join(scores, key, "left")


@dataclass(frozen=True)
class RatingModel:
    sweep: DataFrame
    search: GridSearch
    report: DataFrame
    confusion: DataFrame


def train_rating_model(
    df: DataFrame,
    key: str,
    rating: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    family: TreeFamily,
    sweep_depths: Iterable[int],
    grid_depths: Iterable[int],
    fit_scope: str = "train",
    test: float = 0.2,
    folds: int = 5,
    seed: int = 42,
    parallelism: int = 1,
) -> RatingModel:
    """Band the rating, prepare features, sweep depths, search the grid and evaluate.

    ``test`` is the share of rows that are held out, ``seed`` decides which these are and deals
    the ``folds`` of the search; ``parallelism`` fits run at a time.
    """
    banded = rating_bands(df, [rating], suffix="_class")
    data = prepare(banded, key, f"{rating}_class", numeric, categorical, test=test, seed=seed, fit_scope=fit_scope)
    sweep = depth_sweep(data, family, sweep_depths, parallelism)
    search = grid_search(data, family, grid_depths, folds, seed, parallelism)
    return RatingModel(
        sweep,
        search,
        classification_report(search.predictions, "label", "predicted"),
        confusion_matrix(search.predictions, "label", "predicted"),
    )
