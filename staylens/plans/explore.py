"""From raw review rows to area statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalars import column
from staylens.operators.clean import coerce_numeric, coerce_percent, drop_columns, drop_missing, filter_min
from staylens.operators.distribution import box_values, correlation_matrix, histogram, joint_histogram, mean_by_bin, strong_correlates
from staylens.operators.profile import describe, describe_values, duplicate_count, missing_percent, missing_summary
from staylens.operators.quantiles import value_table
from staylens.operators.stats import area_extremes, area_profile, mean_by, rating_bands, subset_profile, top_bottom, value_counts
from staylens.runtime import materialize_columns

# The columns of a listing-review table that the steps below use.
RATING_COLUMNS = (
    "Overall Rating", "Accuracy Rating", "Cleanliness Rating", "Checkin Rating",
    "Communication Rating", "Location Rating", "Value Rating",
)
UNUSED_COLUMNS = ("Host URL", "Listing URL", "Country", "Country Code")
REQUIRED_CATEGORIES = (
    "Property Type", "Room Type", "Host Response Time", "Is Superhost", "Is Exact Location",
)


def clean_reviews(
    df: DataFrame,
    unused: Sequence[str] = UNUSED_COLUMNS,
    price: str = "Price",
    ratings: Sequence[str] = RATING_COLUMNS,
    categories: Sequence[str] = REQUIRED_CATEGORIES,
) -> DataFrame:
    """Drop columns, read the price, keep rows with a price >= 0, all ratings and categories."""
    cleaned = coerce_numeric(drop_columns(df, unused), [price])
    return drop_missing(filter_min(cleaned, price, 0), [*ratings, *categories])


def area_report(
    df: DataFrame,
    area: str = "Postal Code",
    rating: str = "Overall Rating",
    price: str = "Price",
    property_type: str = "Property Type",
    room_type: str = "Room Type",
    k: int = 5,
) -> DataFrame:
    """Best and worst areas by mean rating, with their price and common types."""
    profile = area_profile(
        df,
        area,
        {"average_rating": rating, "average_price": price},
        {"common_property_type": property_type, "common_room_type": room_type},
    )
    return area_extremes(profile, area, "average_rating", k)


@dataclass(frozen=True)
class ReviewColumns:
    """Which column of a table plays which part in the exploration."""

    price: str = "Price"
    rating: str = "Overall Rating"
    ratings: tuple[str, ...] = RATING_COLUMNS
    numbers: tuple[str, ...] = ("Price", "Latitude", "Longitude", "Reviews")
    host: str = "Host ID"
    neighbourhood: str = "neighbourhood"
    area: str = "Postal Code"
    property_type: str = "Property Type"
    room_type: str = "Room Type"
    superhost: str = "Is Superhost"
    response_time: str = "Host Response Time"
    response_rate: str = "Host Response Rate"
    unused: tuple[str, ...] = UNUSED_COLUMNS
    required: tuple[str, ...] = REQUIRED_CATEGORIES

    @property
    def explored(self) -> list[str]:
        """The columns that the statistics of the cleaned rows read."""
        return list(
            dict.fromkeys(
                [
                    *self.ratings, self.rating, self.price, *self.numbers, self.neighbourhood, self.area, self.property_type,
                    self.room_type, self.superhost, self.response_time, self.response_rate,
                ]
            )
        )


def explore(
    df: DataFrame, columns: ReviewColumns = ReviewColumns(), k: int = 5, boxes: int = 10, bins: int = 10, rate_bins: int = 5, strong: float = 0.5
) -> dict[str, DataFrame]:
    """The exploration of a raw listing-review table, one result per name.

    The rows with a price and, of these, the cleaned ones are stored once, without the comments
    and other columns that nothing here reads; all results come from the stored rows. ``k`` is the
    length of top and bottom lists, ``boxes`` the number of groups in a box plot of many.
    """
    c = columns
    # a column that the table lacks is an error, wherever it would be read
    wanted = list(dict.fromkeys([*c.explored, *c.required, c.host]))
    priced = filter_min(coerce_numeric(drop_columns(df, c.unused), [c.price]), c.price, 0)
    priced = materialize_columns(priced.select(*[column(x) for x in wanted]))
    free = subset_profile(priced, column(c.price) == 0, c.host, [c.neighbourhood, c.property_type], c.ratings, k)
    cleaned = materialize_columns(drop_missing(priced, [*c.ratings, *c.required]).select(*[column(x) for x in c.explored]))
    by_room, by_property, by_neighbourhood = (
        value_table(cleaned, [c.rating], [key]) for key in (c.room_type, c.property_type, c.neighbourhood)
    )
    numbers = list(dict.fromkeys([*c.ratings, *c.numbers]))
    strongest = strong_correlates(cleaned, numbers, c.rating, strong)
    # at most as many names as there are columns
    names = sorted(x["column"] for x in strongest.collect())
    banded = rating_bands(cleaned, c.ratings)
    rated = coerce_percent(cleaned, [c.response_rate])
    return {
        "missing": missing_summary(df),
        "missing_percent": missing_percent(df),
        "duplicates": duplicate_count(df),
        "price": describe(priced, [c.price]),
        "zero_price": free,
        "ratings": describe(cleaned, c.ratings),
        "rating_histograms": histogram(cleaned, c.ratings, bins),
        "rating_bands": _band_counts(banded, c.ratings),
        "correlations": correlation_matrix(cleaned, numbers),
        "strong_correlates": strongest,
        "strong_pairs": joint_histogram(cleaned, names, bins),
        "room_type_boxes": box_values(by_room),
        "by_room_type": describe_values(by_room),
        "property_type_boxes": _top_boxes(cleaned, c.property_type, box_values(by_property), boxes),
        "by_property_type": describe_values(by_property),
        "neighbourhood_boxes": _top_boxes(cleaned, c.neighbourhood, box_values(by_neighbourhood), boxes),
        "neighbourhoods": top_bottom(mean_by(cleaned, c.neighbourhood, c.rating), c.neighbourhood, "mean", k),
        "postal_codes": top_bottom(mean_by(cleaned, c.area, c.rating), c.area, "mean", k),
        "areas": area_report(cleaned, c.area, c.rating, c.price, c.property_type, c.room_type, k),
        "by_superhost": mean_by(cleaned, c.superhost, c.rating),
        "by_response_time": mean_by(cleaned, c.response_time, c.rating, sort="desc"),
        "by_response_rate": mean_by_bin(rated, c.response_rate, c.rating, rate_bins),
    }


def _band_counts(banded: DataFrame, ratings: Sequence[str]) -> DataFrame:
    """(column, band, n): how many values of each rating lie in each band."""
    bands = banded.select(*[column(f"{r}_band").alias(r) for r in ratings])
    long = bands.unpivot([], [column(r) for r in ratings], "column", "band")
    return long.groupBy("column", "band").agg(F.count(F.lit(1)).alias("n"))


def _top_boxes(df: DataFrame, key: str, found: DataFrame, k: int) -> DataFrame:
    """The boxes of the k most frequent groups (k rows are broadcast)."""
    return found.join(F.broadcast(value_counts(df, key, k).select(column(key))), key, "left_semi")
