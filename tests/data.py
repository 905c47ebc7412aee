"""Hand-made review rows: missing and NaN ratings, a missing group, zero and negative
prices, an exact duplicate, ties."""

REVIEW_SCHEMA = (
    "review_id long, listing_id long, host_id long, neighbourhood string, postal_code string, "
    "property_type string, room_type string, is_superhost string, host_response_rate string, "
    "price string, comments string, overall_rating double, value_rating double"
)
NAN = float("nan")
REVIEWS = [
    (1, 10, 100, "Mitte", "10115", "Apartment", "Entire home/apt", "t", "90%", "50", "Great place, great host!", 95.0, 9.0),
    (2, 10, 100, "Mitte", "10115", "Apartment", "Entire home/apt", "t", "90%", "50", "Nice & clean.", 97.0, 10.0),
    (3, 11, 101, "Mitte", "10115", "Loft", "Private room", "f", "100%", "0", None, 80.0, 8.0),
    (4, 11, 101, "Mitte", "01067", "Loft", "Private room", "f", "100%", "0", "", None, 8.0),
    (5, 12, 102, "Pankow", "01067", "House", "Private room", "f", "5", "-3", "bad dirty", NAN, 6.0),
    (6, 12, 102, "Pankow", "01067", "House", "Shared room", None, "n/a", "$1,200", "Bad bad stay", 60.0, NAN),
    (7, 13, 103, None, None, "Apartment", "Shared room", "f", None, "70", "nice but very dirty", 70.0, 7.0),
    (8, 13, 103, None, "10999", "Apartment", "Private room", "t", "50%", "70", "Clean", 100.0, 10.0),
    (9, 14, 104, "Wedding", "10999", "Hostel", "Shared room", "f", "20%", "15", "ok", 91.0, 9.0),
    (9, 14, 104, "Wedding", "10999", "Hostel", "Shared room", "f", "20%", "15", "ok", 91.0, 9.0),
    (11, 15, 105, "Wedding", "10999", None, None, "f", "0%", "22", "great", 91.0, 8.0),
    (12, 16, 106, "Wedding", "13347", "Loft", "Entire home/apt", "t", "80%", "10d", "great", 99.0, 10.0),
]
LEXICON = [("great", 0.8), ("nice", 0.6), ("clean", 0.4), ("bad", -0.7), ("dirty", -0.6), ("stay", 0.0)]


def reviews(spark):
    return spark.createDataFrame(REVIEWS, REVIEW_SCHEMA)


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "token string, polarity double")
