"""Import without Spark's jars, the CSV reader, patterns and entities."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from platewise.operators import features, filters, keywords, models, similarity
from platewise.sources.files import read_venues

REPO = Path(__file__).resolve().parent.parent

NO_JARS = """
import glob, os, builtins
real = glob.glob
glob.glob = lambda p, *a, **k: [] if "jars" in str(p) else real(p, *a, **k)
import __spark_entry__ as e
assert e.queries() and e.oracle_sql()
"""


def test_import_needs_no_jars_and_no_session():
    subprocess.run([sys.executable, "-c", NO_JARS], cwd=REPO, check=True, timeout=120)


def test_import_without_the_training_data_operators():
    hide = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("platewise.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
assert "city_stats" in e.queries() and not any(q.startswith("op") for q in e.queries())
"""
    subprocess.run([sys.executable, "-c", hide], cwd=REPO, check=True, timeout=120)


def test_read_venues_quotes_breaks_numbers_and_markers(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text(
        'Restaurant ID,Restaurant Name,City,Cuisines,Votes,Price range,Aggregate rating\n'
        '1,"A ""X"" b, c",Paris,"Thai, Café",10.0,2.0,4.5\n'
        '2,"two\nlines",#N/A N/A,1.#QNAN,2.5,-nan,#NA\n'
        '3,plain,-1.#IND,-NaN,7,3,x\n'
    )
    got = {r.venue_id: r for r in read_venues(spark, str(path)).collect()}
    assert got[1].venue_name == 'A "X" b, c' and got[1].cuisines == "Thai, Café"
    assert (got[1].votes, got[1].price_range, got[1].rating) == (10, 2, 4.5)
    assert got[2].venue_name == "two\nlines"
    assert (got[2].city, got[2].cuisines, got[2].votes, got[2].price_range, got[2].rating) == (None,) * 5
    assert (got[3].city, got[3].cuisines, got[3].votes, got[3].price_range) == (None, None, 7, 3)


@pytest.fixture
def cafes(spark):
    rows = [
        (1, "a", "CAFÉ, Bar", "Köln", 4.0, 2, 10, 5, "Yes", "No"),
        (2, "b", "bar", "KÖLN", 3.0, 2, 10, 5, "No", "No"),
        (3, "c", "thai", "Paris", 3.0, 1, 10, 5, "Yes", "Yes"),
    ]
    return spark.createDataFrame(
        rows,
        "venue_id long, venue_name string, cuisines string, city string, rating double, "
        "price_range int, avg_cost long, votes long, has_table_booking string, "
        "has_online_delivery string",
    ).withColumns({"locality": F.lit("x"), "rest_type": F.lit("y")})


def test_patterns_ignore_case_of_accents(cafes):
    assert [r.venue_id for r in filters.filter_venues(cafes, cuisine="café").collect()] == [1]
    assert [r.venue_id for r in filters.filter_venues(cafes, city="kÖln").collect()] == [1, 2]


def test_a_bad_pattern_affects_only_its_request(spark, cafes):
    requests = spark.createDataFrame(
        [
            (1, None, "[", None, None, None),
            (2, None, "café", None, None, None),
            (3, "köln", None, 2, None, False),
            (4, None, None, None, True, None),
            (5, "Köln", "bar", None, False, None),
        ],
        similarity.REQUEST_SCHEMA,
    )
    got = {}
    for r in similarity.recommend(requests, cafes, 5).collect():
        got.setdefault(r.request_id, set()).add(r.venue_id)
    assert got == {2: {1}, 3: {1, 2}, 4: {1, 3}, 5: {2}}


def test_recommendation_has_no_nested_loop(spark, cafes):
    requests = spark.createDataFrame(
        [(1, None, "bar", 2, None, None), (2, "Paris", None, None, None, None)],
        similarity.REQUEST_SCHEMA,
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = similarity.recommend(requests, cafes, 5)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entities(spark):
    html = "<p>caf&eacute; &#233;&#xE9; &amp;lt; &nosuch; &copy a&b &nbsp; &#0; &apos;</p>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert keywords.page_text(df).first().text == "café éé &lt; &nosuch; &copy a&b &#0; '"


def test_split_keeps_rows_without_a_label(spark):
    rows = spark.range(1000).select(
        F.col("id").alias("venue_id"), F.when(F.col("id") % 2 == 0, F.lit("a")).alias("label")
    )
    split = features.split_stratified(rows, "venue_id", "label")
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {("a", "test"): 100, ("a", "train"): 400, (None, "test"): 100, (None, "train"): 400}


def test_cuisine_model_saves_its_metrics(venues_small, spark, tmp_path):
    model = models.train_cuisine_model(venues_small, num_trees=3, max_depth=4)
    model.save(str(tmp_path / "m"))
    loaded = models.CuisineModel.load(spark, str(tmp_path / "m"))
    for name in ("metrics", "per_class"):
        before, after = getattr(model, name), getattr(loaded, name)
        assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))


def test_tuning_tries_are_different_and_the_best_is_trained(venues_small):
    tried, best = models.tune_rating(venues_small, n_trials=4, trees=(2, 3), depth=(2, 3))
    rows = tried.collect()
    assert len({(r.num_trees, r.max_depth) for r in rows}) == 4
    assert [r.r2 for r in rows] == sorted((r.r2 for r in rows), reverse=True)
    assert best.forest.getNumTrees == rows[0].num_trees


def test_a_large_csv_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "large.csv"
    lines = [f'Place {i},"Thai, Bar",{i % 90}' for i in range(60_000)]
    path.write_text("\n".join(["Restaurant Name,Cuisines,Votes", *lines]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        plain = read_venues(spark, str(path))
        assert plain.rdd.getNumPartitions() > 2 and plain.count() == len(lines)
        assert plain.where("cuisines = 'Thai, Bar' AND votes = 89").count() == len(lines) // 90
        assert read_venues(spark, str(path), multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_breaks_in_quoted_fields(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text('Restaurant Name,Cuisines,Votes\n"A\nB",Thai,3\n')
    rows = read_venues(spark, str(path), multi_line=True).collect()
    assert [(r.venue_name, r.cuisines, r.votes) for r in rows] == [("A\nB", "Thai", 3)]
