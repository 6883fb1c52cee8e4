"""Explicit venue schema, source column names and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical venue table.  Types are fixed; the reader never infers them.
VENUE_SCHEMA = T.StructType(
    [
        T.StructField("venue_id", T.LongType(), False),
        T.StructField("venue_name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("locality", T.StringType()),
        T.StructField("rest_type", T.StringType()),
        T.StructField("cuisines", T.StringType()),
        T.StructField("avg_cost", T.DoubleType()),
        T.StructField("price_range", T.IntegerType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("votes", T.LongType()),
        T.StructField("has_table_booking", T.StringType()),
        T.StructField("has_online_delivery", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

# Header names of the restaurant CSV -> canonical column names.
SOURCE_COLUMNS = {
    "Restaurant ID": "venue_id",
    "Restaurant Name": "venue_name",
    "City": "city",
    "Locality": "locality",
    "Restaurant Type": "rest_type",
    "Cuisines": "cuisines",
    "Average Cost for two": "avg_cost",
    "Price range": "price_range",
    "Aggregate rating": "rating",
    "Votes": "votes",
    "Has Table booking": "has_table_booking",
    "Has Online delivery": "has_online_delivery",
    "Latitude": "latitude",
    "Longitude": "longitude",
}

# Fixed values that must equal the reference application's for equal results.
UNKNOWN = "Unknown"
NOT_AVAILABLE = "N/A"
# Text markers that a pandas CSV reader treats as missing by default.
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Price range labels 1..4.
PRICE_LABELS = {
    1: "Budget (₹)",
    2: "Moderate (₹₹)",
    3: "Expensive (₹₹₹)",
    4: "Very Expensive (₹₹₹₹)",
}
# Keyword dictionary of the web-page classifier, in dictionary order.
CUISINE_KEYWORDS = [
    ("Italian", ["pasta", "pizza", "risotto", "lasagna", "spaghetti", "parmesan"]),
    ("Mexican", ["taco", "burrito", "quesadilla", "nachos", "salsa", "guacamole"]),
    ("Chinese", ["kung pao", "chow mein", "dumplings", "fried rice", "wonton", "dim sum"]),
    ("Indian", ["curry", "naan", "tandoori", "biryani", "masala", "tikka"]),
    ("Japanese", ["sushi", "ramen", "teriyaki", "sashimi", "tempura", "udon"]),
    ("North Indian", ["butter chicken", "dal", "paneer", "roti", "kulcha"]),
    ("South Indian", ["dosa", "idli", "sambar", "vada", "upma"]),
    ("Thai", ["pad thai", "curry", "tom yum", "satay", "coconut"]),
    ("Continental", ["steak", "salad", "soup", "grilled", "roasted"]),
]
# Rating prediction: categorical and numeric features, in the reference order.
RATING_FEATURES = [
    "online_order",
    "book_table",
    "votes",
    "cost",
    "city",
    "cuisines",
    "rest_type",
]
RATING_CATEGORICAL = ["city", "cuisines", "rest_type"]
# Cuisine classification features.
CUISINE_FEATURES = ["city", "has_table_booking", "has_online_delivery", "price_range", "votes"]
