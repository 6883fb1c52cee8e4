"""Named queries over the test tables: name -> f(spark, sf_dir) -> DataFrame.

Each query runs an operator over whole tables.  Doubles are rounded to 6
places at the end so results can be compared with the DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.operators import location
from platewise.sources.testdata import venues

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (top level) to ``places`` decimals."""
    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(field.name), places).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


QUERIES: dict[str, Query] = {}
ROWS_ONLY: set[str] = set()


def register(name: str, rows_only: bool = False):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if rows_only:
            ROWS_ONLY.add(name)
        return fn

    return wrap


@register("city_stats")
def _city_stats(spark, sf_dir):
    return location.city_stats(venues(spark, sf_dir))


# ---- location (E1-E4, E9, E10, F1, F2, G1-G4, C10) -------------------------
from platewise.functions import expressions  # noqa: E402
from platewise.operators import cleaning, filters, profile  # noqa: E402

SEARCH_TERM = "nation_1"
SEARCH_MIN_RATING = 3.5


@register("city_overview")
def _city_overview(spark, sf_dir):
    return location.city_overview(venues(spark, sf_dir), 15)


@register("insights")
def _insights(spark, sf_dir):
    return location.insights(venues(spark, sf_dir))


@register("locality_stats")
def _locality_stats(spark, sf_dir):
    return location.top_city_localities(venues(spark, sf_dir), 15)


@register("argmax_city")
def _argmax_city(spark, sf_dir):
    return location.city_rankings(venues(spark, sf_dir))


@register("grid_clusters")
def _grid_clusters(spark, sf_dir):
    return location.grid_clusters(venues(spark, sf_dir), 1.0)


@register("map_pyramid")
def _map_pyramid(spark, sf_dir):
    # nine places first: sums of doubles differ in the last bits by row order, and a
    # mean may lie right between two values of six places
    pyramid = location.map_pyramid(venues(spark, sf_dir), levels=7, widest=16.0)
    return rounded(pyramid, 9)


@register("city_share")
def _city_share(spark, sf_dir):
    return location.city_share(venues(spark, sf_dir))


@register("city_rank")
def _city_rank(spark, sf_dir):
    return location.city_rank(venues(spark, sf_dir), 3)


@register("map_points_500")
def _map_points(spark, sf_dir):
    return location.map_points(venues(spark, sf_dir), 500)


@register("location_distribution_500")
def _location_distribution(spark, sf_dir):
    return location.location_distribution(venues(spark, sf_dir), 500)


@register("map_data_full")
def _map_data(spark, sf_dir):
    return location.map_data(venues(spark, sf_dir))


@register("cities_by_cost")
def _cities_by_cost(spark, sf_dir):
    return location.sort_cities(location.city_overview(venues(spark, sf_dir), None), "avg_cost")


@register("search_venues")
def _search_venues(spark, sf_dir):
    rows = location.map_data(venues(spark, sf_dir))
    return location.search(rows, SEARCH_TERM, ["name", "city"], SEARCH_MIN_RATING, "rating")


# ---- profiles (E5-E8, E11, E12, G5) ----------------------------------------


@register("class_distribution")
def _class_distribution(spark, sf_dir):
    return profile.class_distribution(venues(spark, sf_dir))


@register("numeric_ranges")
def _numeric_ranges(spark, sf_dir):
    return profile.numeric_ranges(venues(spark, sf_dir), ["votes", "avg_cost"])


@register("mode_price_by_city")
def _mode_price_by_city(spark, sf_dir):
    return profile.mode_price_by_city(venues(spark, sf_dir))


@register("distinct_counts")
def _distinct_counts(spark, sf_dir):
    return profile.distinct_counts(venues(spark, sf_dir))


@register("distinct_sketches")
def _distinct_sketches(spark, sf_dir):
    """Estimates from united sketches beside exact counts, for three
    groupings: are they within four standard errors (and one)?"""
    v = venues(spark, sf_dir)
    sketches = profile.distinct_sketches(v, ["city", "price_range"])
    filled = v.withColumns(
        {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in ("city", "cuisines")}
    ).withColumn("cuisine", F.explode(expressions.cuisine_items("cuisines")))
    out = None
    for keys in (["city"], ["price_range"], []):
        exact = filled.groupBy(*keys).agg(*[F.count_distinct(c).alias(c) for c in profile.COUNTED])
        both = [
            df.select(
                F.lit(keys[0] if keys else "all").alias("grouping"),
                (F.col(keys[0]).cast("string") if keys else F.lit("all")).alias("value"),
                F.explode(F.create_map(*[x for c in profile.COUNTED for x in (F.lit(c), F.col(c))])).alias(
                    "counted", name
                ),
            )
            for df, name in ((profile.distinct_estimates(sketches, keys), "estimate"), (exact, "n_distinct"))
        ]
        same = (
            F.col("e.value").eqNullSafe(F.col("x.value")) & (F.col("e.counted") == F.col("x.counted"))
        )
        rows = both[0].alias("e").join(both[1].alias("x"), same)
        off = F.abs(F.col("estimate") - F.col("n_distinct"))
        rows = rows.select(
            "x.grouping", "x.value", "x.counted", "n_distinct",
            (off <= 4 * profile.SKETCH_ERROR * F.col("n_distinct") + 1).alias("within"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@register("distinct_cities")
def _distinct_cities(spark, sf_dir):
    return profile.distinct_values(venues(spark, sf_dir), "city")


@register("distinct_cuisines")
def _distinct_cuisines(spark, sf_dir):
    return profile.distinct_items(venues(spark, sf_dir), "cuisines")


@register("sample_row")
def _sample_row(spark, sf_dir):
    return profile.sample_row(venues(spark, sf_dir), 42)


@register("sample_class_row")
def _sample_class_row(spark, sf_dir):
    return profile.sample_class_row(venues(spark, sf_dir), 42)


@register("form_options")
def _form_options(spark, sf_dir):
    v = venues(spark, sf_dir)
    some = profile.form_options(v, "rest_type").withColumnRenamed("rest_type", "option")
    none = profile.form_options(v.where(F.col("city").isNull()), "city")
    return some.unionByName(none.withColumnRenamed("city", "option"))


# ---- cleaning, filters, bands (B1-B5, C1-C6, I1) ----------------------------

FILTER_REQUEST = dict(city="nation_3", cuisine="brand#1$|brand#2", table_booking=True)


@register("filter_venues")
def _filter_venues(spark, sf_dir):
    rows = filters.filter_venues(venues(spark, sf_dir), **FILTER_REQUEST)
    return rows.select(
        "venue_id", "venue_name", "city", "cuisines", "price_range",
        "has_table_booking", "has_online_delivery",
    )


@register("clean_venues")
def _clean_venues(spark, sf_dir):
    return cleaning.clean_venues(venues(spark, sf_dir))


@register("cleaning_steps")
def _cleaning_steps(spark, sf_dir):
    """A2 and B1-B4, B6-B8 as the tasks chain them."""
    rows = cleaning.rename_columns(
        venues(spark, sf_dir), {"avg_cost": "cost", "venue_name": "name", "absent": "ignored"}
    )
    rows = cleaning.add_missing_columns(rows, {"dish_liked": "none", "city": "never used"})
    rows = cleaning.drop_missing(rows, ["price_range", "city"])
    rows = cleaning.parse_numbers(rows, ["cost", "votes"], 0.0)
    rows = cleaning.yes_no_flags(rows, {"has_table_booking": "book_table"})
    rows = cleaning.with_main_cuisine(rows)
    rows = cleaning.fill_missing(rows, {"latitude": 0.0, "absent": 1})
    return rows.select(
        "venue_id", "name", "city", "cost", "votes", "price_range", "book_table", "main_cuisine",
        "dish_liked", "latitude",
    )


@register("combined_text")
def _combined_text(spark, sf_dir):
    return cleaning.combined_text(venues(spark, sf_dir))


@register("label_bands")
def _label_bands(spark, sf_dir):
    from platewise.operators.common import location_rules

    loc = location_rules(venues(spark, sf_dir))
    # the density of a locality is judged within its city
    keys = ["city", "locality"]
    per_locality = loc.groupBy(*keys).agg(F.count(F.lit(1)).alias("locality_count"))
    rows = loc.join(per_locality, keys).select(
        "venue_id", "rating", "price_range", "locality_count",
        (F.col("rating") * 20).alias("score"),
    )
    return cleaning.label_bands(rows, "rating", "price_range", "locality_count", "score")


# ---- text similarity and recommendation (J1-J5, D4, F3, G6) -----------------
from platewise.operators import similarity  # noqa: E402
from platewise.sources.testdata import documents, table  # noqa: E402

# Fixture requests: every kind of filter set / unset, a city in other letter
# case, a cuisine pattern, a cuisine and a city that match nothing, an empty
# request.  More requests are derived from the nation table below.
BATCH_REQUESTS = [
    (1, "NATION_3", None, None, None, None),
    (2, "nation_3", "brand#1$|brand#2", None, True, None),
    (3, None, "Brand#7", 2, None, False),
    (4, None, None, None, None, None),
    (5, "", "", None, None, None),
    (6, "NATION_5", "no-such-cuisine", None, None, None),
    (7, None, None, 4, True, True),
    (8, "Atlantis", None, None, None, None),
]
TOP_N = 10


def batch_requests(spark, sf_dir):
    fixed = spark.createDataFrame(BATCH_REQUESTS, similarity.REQUEST_SCHEMA)
    derived = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 100).cast("bigint").alias("request_id"),
        F.lower("n_name").alias("city"),
        F.lit(None).cast("string").alias("cuisine"),
        ((F.col("n_nationkey") % 4) + 1).cast("int").alias("price_range"),
        (F.col("n_nationkey") % 2 == 0).alias("table_booking"),
        F.lit(None).cast("boolean").alias("online_delivery"),
    )
    return fixed.unionByName(derived)


def recommender(spark, sf_dir):
    """The recommender fitted on a folder, as a plan over its tables."""
    return similarity.fit_recommender(venues(spark, sf_dir))


@register("token_counts_documents")
def _token_counts(spark, sf_dir):
    return similarity.token_counts(documents(spark, sf_dir), "doc_id", "text")


@register("tfidf_documents")
def _tfidf_documents(spark, sf_dir):
    return similarity.fit_tfidf(documents(spark, sf_dir), "doc_id", "text")[1]


@register("similar_documents")
def _similar_documents(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark")
    return similarity.similar_documents(queries, documents(spark, sf_dir), 10)


@register("recommend_one")
def _recommend_one(spark, sf_dir):
    req = spark.createDataFrame(
        [(1, "nation_7", "brand#12", None, None, None)], similarity.REQUEST_SCHEMA
    )
    return similarity.recommend(req, recommender(spark, sf_dir), TOP_N)


@register("recommend_batch")
def _recommend_batch(spark, sf_dir):
    return similarity.recommend(batch_requests(spark, sf_dir), recommender(spark, sf_dir), TOP_N)


@register("recommend_empty")
def _recommend_empty(spark, sf_dir):
    req = spark.createDataFrame([(1, None, None, None, None, None)], similarity.REQUEST_SCHEMA)
    return similarity.recommend(req, recommender(spark, sf_dir), TOP_N)


# ---- keyword classification of pages (N1, N2) -------------------------------
from platewise.operators import automaton, keywords  # noqa: E402
from platewise.sources.testdata import pages  # noqa: E402

# Test dictionary of word pieces that occur in the test pages (FIXTURES.md
# §3), plus one category that never matches.
WORD_PIECES = [
    ("German", ["icht", "ung"]),
    ("French", ["eau", "que", "ment", "oup"]),
    ("English", ["tion", "wh"]),
    ("Spanish", ["ción", "ado", "ente"]),
    ("Never", ["zzqx"]),
]


@register("page_text")
def _page_text(spark, sf_dir):
    return keywords.page_text(pages(spark, sf_dir))


@register("page_keywords")
def _page_keywords(spark, sf_dir):
    return keywords.page_keywords(pages(spark, sf_dir))


DICTIONARY_WORDS = 50_000


def word_dictionary(spark, sf_dir):
    """The most frequent words of five and more letters of the documents, in
    ten categories by their first letter: all that occur c times and more, c being the least
    for which they are no more than ``DICTIONARY_WORDS``."""
    words = documents(spark, sf_dir).select(
        F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))).alias("keyword")
    )
    counts = words.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    # one row per count
    upto = F.sum("words").over(Window.orderBy(F.desc("n")))
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("upto", upto)
    least = sizes.where(F.col("upto") <= DICTIONARY_WORDS).agg(F.min("n")).scalar()
    position = (F.ascii("keyword") % 10).cast("int")
    return counts.where(F.col("n") >= least).select(
        position.alias("position"), F.concat(F.lit("group_"), position).alias("category"), "keyword"
    )


@register("page_keywords_words")
def _page_keywords_words(spark, sf_dir):
    return automaton.page_keywords_table(pages(spark, sf_dir), word_dictionary(spark, sf_dir))


@register("page_keywords_pieces")
def _page_keywords_pieces(spark, sf_dir):
    return keywords.page_keywords(pages(spark, sf_dir), WORD_PIECES)


# ---- features, splits and metrics (K1-K5, M1-M7) ----------------------------
from platewise.operators import features, metrics  # noqa: E402
from platewise.plans import baselines  # noqa: E402

ENCODED = ["city", "cuisines", "rest_type"]


def encode_requests(spark, sf_dir):
    """Scoring requests derived from the nation table: half of the cities in
    other letter case (unseen), brand names as cuisines, rest types seen,
    unseen and missing."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        n.cast("bigint").alias("request_id"),
        F.when(n % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("city"),
        F.concat(F.lit("Brand#"), n.cast("string")).alias("cuisines"),
        F.when(n % 3 == 0, F.lit("BUILDING"))
        .when(n % 3 == 1, F.lit("building"))
        .alias("rest_type"),
    )


@register("label_encode")
def _label_encode(spark, sf_dir):
    return features.label_codes(baselines.rating_rows(venues(spark, sf_dir)), ENCODED)


@register("encode_unseen")
def _encode_unseen(spark, sf_dir):
    codes = features.label_codes(baselines.rating_rows(venues(spark, sf_dir)), ENCODED)
    out = features.encode(encode_requests(spark, sf_dir), codes, ENCODED)
    return out.select("request_id", *[c + "_code" for c in ENCODED])


@register("split_plain")
def _split_plain(spark, sf_dir):
    return features.split_plain(venues(spark, sf_dir), "venue_id").select("venue_id", "split")


@register("split_stratified")
def _split_stratified(spark, sf_dir):
    return baselines.cuisine_rows(venues(spark, sf_dir)).select("venue_id", "label", "split")


@register("top_classes")
def _top_classes(spark, sf_dir):
    return features.top_classes(venues(spark, sf_dir), 10).select("venue_id", "main_cuisine")


@register("regression_metrics")
def _regression_metrics(spark, sf_dir):
    return metrics.regression_metrics(
        baselines.rating_baseline(venues(spark, sf_dir)), group="split"
    )


def _test_predictions(spark, sf_dir):
    pred = baselines.cuisine_baseline(venues(spark, sf_dir))
    return pred.where(F.col("split") == "test")


@register("class_metrics")
def _class_metrics(spark, sf_dir):
    return metrics.class_metrics(baselines.cuisine_baseline(venues(spark, sf_dir)), group="split")


@register("per_class_metrics")
def _per_class_metrics(spark, sf_dir):
    return metrics.per_class_metrics(_test_predictions(spark, sf_dir))


@register("confusion_matrix")
def _confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_test_predictions(spark, sf_dir))


@register("weak_classes")
def _weak_classes(spark, sf_dir):
    return metrics.weak_classes(metrics.per_class_metrics(_test_predictions(spark, sf_dir)))


@register("class_imbalance")
def _class_imbalance(spark, sf_dir):
    return metrics.class_imbalance(metrics.per_class_metrics(_test_predictions(spark, sf_dir)))


# ---- models (L1-L8), rows-only checks ----------------------------------------
from platewise.operators import models  # noqa: E402

_MODELS: dict = {}


def _model(kind: str, spark, sf_dir):
    """Train once per session, table folder and kind."""
    key = (kind, id(spark), sf_dir)
    if key not in _MODELS:
        train = models.train_rating_model if kind == "rating" else models.train_cuisine_model
        _MODELS[key] = train(venues(spark, sf_dir))
    return _MODELS[key]


def rating_requests(spark, sf_dir):
    """Rating requests derived from the nation table (one city in other
    letter case is unseen), API field names."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        n.cast("bigint").alias("request_id"),
        (n % 2).cast("int").alias("online_order"),
        ((n + 1) % 2).cast("int").alias("book_table"),
        (n * 10).cast("bigint").alias("votes"),
        F.when(n == 24, F.lower("n_name")).otherwise(F.col("n_name")).alias("location"),
        F.when(n % 3 == 0, F.lit("BUILDING")).otherwise(F.lit("AUTOMOBILE")).alias("rest_type"),
        F.concat(F.lit("Brand#"), n.cast("string")).alias("cuisines"),
        (n * 100.0).alias("cost"),
    )


def cuisine_requests(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        n.cast("bigint").alias("request_id"),
        F.col("n_name").alias("city"),
        (n % 2).cast("int").alias("has_table_booking"),
        (F.floor(n / 2) % 2).cast("int").alias("has_online_delivery"),
        ((n % 4) + 1).cast("int").alias("price_range"),
        (n * 10).cast("bigint").alias("votes"),
    )


@register("rating_predict", rows_only=True)
def _rating_predict(spark, sf_dir):
    return models.predict_rating(_model("rating", spark, sf_dir), rating_requests(spark, sf_dir))


@register("score_distinct", rows_only=True)
def _score_distinct(spark, sf_dir):
    req = rating_requests(spark, sf_dir)
    doubled = req.unionByName(req.withColumn("request_id", F.col("request_id") + 1000))
    keys = [c for c in req.columns if c != "request_id"]
    return models.score_distinct(_model("rating", spark, sf_dir), doubled, keys)


@register("feature_importance", rows_only=True)
def _feature_importance(spark, sf_dir):
    return _model("rating", spark, sf_dir).importances()


@register("cuisine_predict_top3", rows_only=True)
def _cuisine_predict(spark, sf_dir):
    return models.predict_cuisine(_model("cuisine", spark, sf_dir), cuisine_requests(spark, sf_dir))


@register("cuisine_model_metrics", rows_only=True)
def _cuisine_model_metrics(spark, sf_dir):
    return _model("cuisine", spark, sf_dir).metrics


@register("rating_model_metrics", rows_only=True)
def _rating_model_metrics(spark, sf_dir):
    return _model("rating", spark, sf_dir).metrics


@register("model_insights", rows_only=True)
def _model_insights(spark, sf_dir):
    return models.rating_insights(_model("rating", spark, sf_dir))


@register("cuisine_per_class", rows_only=True)
def _cuisine_per_class(spark, sf_dir):
    return _model("cuisine", spark, sf_dir).per_class


@register("tune_rating", rows_only=True)
def _tune_rating(spark, sf_dir):
    return models.tune_rating(venues(spark, sf_dir), n_trials=20)[0]


@register("train_all", rows_only=True)
def _train_all(spark, sf_dir):
    return models.train_all(venues(spark, sf_dir))
