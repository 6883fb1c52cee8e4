"""Edge cases on small hand-made frames."""

import pytest
from pyspark.sql import functions as F

from platewise.functions.expressions import main_cuisine, to_number, yes_no_flag
from platewise.operators import features, keywords, location, metrics, profile, similarity
from platewise.operators.common import mode_by, sorted_codes

VENUE_COLS = (
    "venue_id bigint, venue_name string, city string, locality string, rest_type string, "
    "cuisines string, avg_cost double, price_range int, rating double, votes bigint, "
    "has_table_booking string, has_online_delivery string, latitude double, longitude double"
)


def venues_of(spark, rows):
    return spark.createDataFrame(rows, VENUE_COLS)


def v(i, city, locality="L1", cuisines="A, B", cost=100.0, price=2, rating=4.0, votes=10,
      book="Yes", deliv="No", lat=1.0, lng=2.0, name=None):
    return (i, name or f"V{i}", city, locality, "Cafe", cuisines, cost, price, rating, votes,
            book, deliv, lat, lng)


def test_scalar_helpers(spark):
    df = spark.createDataFrame(
        [("YES", " Thai ,Indian", "12"), ("no", None, "x1"), (None, "  ", None)],
        "f string, c string, n string",
    )
    out = df.select(
        yes_no_flag("f").alias("f"), main_cuisine("c").alias("m"), to_number("n").alias("n")
    ).collect()
    assert [r.f for r in out] == [1, 0, 0]
    assert [r.m for r in out] == ["Thai", "Unknown", ""]
    assert [r.n for r in out] == [12.0, None, None]


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("a", 1), ("b", None)], "k string, x int")
    res = {r.k: r.x for r in mode_by(df, ["k"], "x").collect()}
    assert res == {"a": 1}


def test_city_stats_skip_unknown_and_zero_missing_rating(spark):
    df = venues_of(spark, [v(1, "X", rating=None), v(2, "X", rating=4.0, deliv="yes"), v(3, None)])
    rows = location.city_stats(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.city, r.restaurant_count, r.average_rating, r.online_order_percentage) == ("X", 2, 2.0, 50.0)


def test_insights_without_known_city(spark):
    df = venues_of(spark, [v(1, None), v(2, "Unknown")])
    r = location.insights(df).collect()[0]
    assert r.total_restaurants == 2
    assert r.total_cities == 0 and r.total_localities == 0
    assert r.highest_rated_city == "N/A" and r.most_expensive_city == "N/A"
    assert r.avg_rating_overall == 0.0


def test_insights_ties_alphabetical(spark):
    df = venues_of(spark, [v(1, "B", rating=4.0), v(2, "A", rating=4.0)])
    r = location.insights(df).collect()[0]
    assert r.highest_rated_city == "A" and r.highest_restaurant_density_city == "A"


def test_locality_stats_case_and_price_default(spark):
    df = venues_of(spark, [v(1, "Delhi", "L1", price=None), v(2, "delhi", "L1", price=None),
                           v(3, "DELHI", "L2", price=3), v(4, "Pune", "L1")])
    rows = {r.locality: r for r in location.locality_stats(df, "dElHi").collect()}
    assert rows["L1"]["count"] == 2 and rows["L1"].price_range_mode == 2
    assert rows["L1"].city == "Delhi"  # mode of spellings, smallest on ties
    assert rows["L2"].price_range_mode == 3


def test_map_points_filter_then_limit(spark):
    df = venues_of(spark, [v(i, "X", lat=None if i < 3 else 1.0) for i in range(6)])
    assert location.map_points(df, 2).count() == 2
    assert location.location_distribution(df, 2).count() == 0


def test_distinct_items_trim(spark):
    df = venues_of(spark, [v(1, "X", cuisines="Thai , Indian"), v(2, "X", cuisines=None)])
    assert [r.item for r in profile.distinct_items(df, "cuisines").collect()] == ["Indian", "Thai"]


def test_sorted_codes_across_partitions(spark):
    values = [f"v{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(x,) for x in values * 2], "value string").repartition(7)
    got = {r.value: r.code for r in sorted_codes(df, "value").collect()}
    assert got == {x: i for i, x in enumerate(sorted(values))}


def test_encode_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "city string")
    codes = features.label_codes(train, ["city"])
    req = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "id int, city string")
    got = {r.id: r.city_code for r in features.encode(req, codes, ["city"]).collect()}
    # sorted: Unknown(0) a(1) b(2); unseen -> Unknown's code
    assert got == {1: 1, 2: 0, 3: 0}
    codes2 = features.label_codes(spark.createDataFrame([("b",), ("a",)], "city string"), ["city"])
    got2 = {r.id: r.city_code for r in features.encode(req, codes2, ["city"]).collect()}
    assert got2 == {1: 0, 2: 2, 3: 2}


def test_stratified_split_exact(spark):
    rows = [(i, "big" if i % 3 else "small") for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, label string").repartition(5)
    out = features.split_stratified(df, "id", "label").toPandas()
    pdf = out.assign(h=out.id.map(lambda i: __import__("hashlib").md5(f"{i}42".encode()).hexdigest()))
    for label, grp in pdf.groupby("label"):
        m = int(round(len(grp) * 0.2))
        expect = set(grp.sort_values(["h", "id"]).id.head(m))
        assert set(grp[grp.split == "test"].id) == expect


def test_metrics_against_brute_force(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", "a")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    per = {r["class"]: r for r in metrics.per_class_metrics(df).collect()}
    assert per["a"].precision == 1.0 and per["a"].recall == pytest.approx(2 / 3)
    assert per["c"].precision == 0.0 and per["c"].f1 == 0.0 and per["c"].support == 1
    m = metrics.class_metrics(df).collect()[0]
    assert m.accuracy == pytest.approx(3 / 5)
    assert m.recall_macro == pytest.approx((2 / 3 + 1 + 0) / 3)
    cm = {(r.actual, r.predicted): r["count"] for r in metrics.confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[("a", "b")] == 1 and cm[("c", "c")] == 0
    imb = metrics.class_imbalance(metrics.per_class_metrics(df)).collect()[0]
    assert imb.max_support == 3 and imb.min_support == 1 and imb.biases_identified


def test_imbalance_infinite_when_a_class_is_only_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "z")], "label string, prediction string")
    imb = metrics.class_imbalance(metrics.per_class_metrics(df)).collect()[0]
    assert imb.min_support == 0 and imb.imbalance_ratio == float("inf") and imb.imbalanced


def test_regression_metrics_constant_labels(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    r = metrics.regression_metrics(df).collect()[0]
    assert r.r2 == 1.0 and r.mse == 0.0


def test_keywords_ties_cap_and_unknown(spark):
    pages = spark.createDataFrame(
        [
            (1, "<html><body><p>Curry and satay</p></body></html>"),
            (2, "<script>pizza pasta</script><p>nothing here</p>"),
            (3, "<p>pizza pasta risotto lasagna spaghetti parmesan</p>"),
            (4, "<!-- sushi --><p>&lt;b&gt; Tom &amp; Jerry</p>"),
            (5, "<p>CURRY only</p>"),
        ],
        "page_id bigint, html string",
    )
    got = {r.page_id: r for r in keywords.page_keywords(pages).collect()}
    assert got[1].cuisine == "Thai" and got[1].hits == 2  # Thai: curry + satay
    assert got[5].cuisine == "Indian"  # tie 1:1, first in dictionary order
    text = {r.page_id: r.text for r in keywords.page_text(pages).collect()}
    assert text[2] == "nothing here"
    assert text[4] == "<b> Tom & Jerry"
    assert got[2].cuisine == "Unknown" and got[2].confidence == 0.0
    assert got[3].confidence == 95.0
    never = keywords.page_keywords(pages, [("Never", ["zzqx"])]).collect()
    assert {r.cuisine for r in never} == {"Unknown"}


def test_recommend_rules(spark):
    rows = [v(i, "Delhi" if i % 2 else "Pune", cuisines="Thai, Indian" if i % 3 else "Italian")
            for i in range(1, 13)]
    df = venues_of(spark, rows)
    with pytest.raises(ValueError):
        similarity.recommend_one(df, city="Delhi", top_n=0)
    empty = similarity.recommend_one(df, top_n=3).orderBy("rank").collect()
    assert [r.venue_id for r in empty] == [1, 2, 3] and {r.similarity_score for r in empty} == {1.0}
    assert similarity.recommend_one(df, cuisine="no-such").count() == 0
    one = similarity.recommend_one(df, city="delhi", cuisine="thai", top_n=4).collect()
    assert len(one) == 4 and all(r.city == "Delhi" for r in one)
    # the same request inside a batch gives the same rows
    reqs = spark.createDataFrame(
        [(7, "delhi", "thai", None, None, None), (8, None, "italian", 2, True, None)],
        similarity.REQUEST_SCHEMA,
    )
    batch = similarity.recommend(reqs, df, 4).where("request_id = 7").collect()
    key = lambda r: (r["rank"], r.venue_id, r.similarity_score)
    assert sorted(map(key, batch)) == sorted(map(key, one))


def test_similar_documents_zero_fill_matches_brute_force(spark):
    docs = spark.createDataFrame(
        [(5, "apple banana"), (3, "cherry date"), (9, "kiwi lemon"), (1, "mango melon"),
         (7, "apple pear")],
        "doc_id bigint, text string",
    )
    queries = spark.createDataFrame(
        [(1, "pear pear"), (2, "zzz unknown words")], "item_id bigint, text string"
    )
    got = similarity.similar_documents(queries, docs, k=4).orderBy("item_id", "rank").collect()
    q1 = [(r.doc_id, r.score > 0) for r in got if r.item_id == 1]
    # doc 7 shares 'pear'; the rest score 0 and come by id: 1, 3, 5
    assert q1 == [(7, True), (1, False), (3, False), (5, False)]
    q2 = [r.doc_id for r in got if r.item_id == 2]
    assert q2 == [1, 3, 5, 7]


def test_search_and_sort_cities(spark):
    df = venues_of(spark, [v(1, "Delhi", rating=4.5, cost=300.0), v(2, "Pune", rating=3.0, cost=900.0),
                           v(3, "New Delhi", rating=4.0, cost=100.0)])
    cities = location.city_overview(df, None)
    hits = location.search(cities, "DELHI", ["city"], 4.0)
    assert sorted(r.city for r in hits.collect()) == ["Delhi", "New Delhi"]
    assert location.search(cities, "", ["city"], 0.0).count() == 3  # empty term: no text filter
    by_cost = [r.city for r in location.sort_cities(cities, "avg_cost").collect()]
    assert by_cost == ["Pune", "Delhi", "New Delhi"]
    with pytest.raises(ValueError):
        location.sort_cities(cities, "name")


def test_class_distribution_and_numeric_ranges(spark):
    df = venues_of(spark, [v(1, "X", cuisines="Thai, A", votes=3), v(2, "X", cuisines=None, votes=4),
                           v(3, "X", cuisines="Thai", votes=None)])
    dist = {r.main_cuisine: (r["count"], r.share) for r in profile.class_distribution(df).collect()}
    assert dist == {"Thai": (2, 2 / 3), "Unknown": (1, 1 / 3)}
    ranges = {r.feature: r for r in profile.numeric_ranges(df, ["votes"]).collect()}
    assert (ranges["votes"].min_value, ranges["votes"].max_value, ranges["votes"].avg_value) == (3, 4, 3)


def test_label_band_boundaries(spark):
    from platewise.operators.cleaning import label_bands

    df = spark.createDataFrame(
        [(4.5, 1, 51, 80.0), (4.0, 4, 50, 60.0), (3.5, 0, 21, 40.0), (3.49, None, 20, 39.9)],
        "rating double, price_range int, n long, score double",
    )
    rows = label_bands(df, "rating", "price_range", "n", "score").collect()
    assert [r.rating_band for r in rows] == ["Excellent", "Good", "Average", "Below Average"]
    assert [r.density_band for r in rows] == ["High", "Medium", "Medium", "Low"]
    assert [r.score_band for r in rows] == ["green", "blue", "amber", "red"]
    assert [r.price_label for r in rows][1:] == ["Very Expensive (₹₹₹₹)", "Unknown", "Unknown"]
    assert [r.price_symbols for r in rows] == ["₹", "₹₹₹₹", "", ""]
