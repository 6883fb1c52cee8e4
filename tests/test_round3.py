"""Map pyramid, mergeable distinct counts, keyword automaton, expiring cache
of predictions, adaptive search and code digits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from platewise.operators import automaton, features, keywords, location, models, profile, search
from platewise.plans.registry import WORD_PIECES
from platewise.schema import CUISINE_KEYWORDS
from platewise.streaming import cache


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def close(a, b):
    return len(a) == len(b) and all(x == pytest.approx(y) for x, y in zip(a, b))


def test_pyramid_levels_equal_the_grid(spark, venues_small):
    pyramid = location.map_pyramid(venues_small, levels=4, widest=8.0).cache()
    for level, cell in enumerate((8.0, 4.0, 2.0, 1.0)):
        grid = location.grid_clusters(venues_small, cell)
        key = lambda r: (r.cell_lat, r.cell_lng)
        got = sorted(pyramid.where(F.col("level") == level).select(*grid.columns).collect(), key=key)
        want = sorted(grid.collect(), key=key)
        assert len(got) == len(want) and all(close(tuple(g), tuple(w)) for g, w in zip(got, want))
    plan = location.map_pyramid(venues_small, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1


def test_united_sketches_equal_direct_ones(spark, venues_small):
    fine = profile.distinct_sketches(venues_small, ["city", "price_range"])
    for keys in (["city"], ["price_range"]):
        direct = profile.distinct_sketches(venues_small, keys)
        assert rows(profile.distinct_estimates(fine, keys)) == rows(profile.distinct_estimates(direct, keys))
    exact = venues_small.agg(F.count_distinct("venue_name")).first()[0]
    whole = profile.distinct_estimates(fine).first()
    assert abs(whole.venue_name - exact) <= 4 * profile.SKETCH_ERROR * exact + 1


def test_sketches_can_be_stored(spark, venues_small, tmp_path):
    profile.distinct_sketches(venues_small).write.parquet(str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert rows(profile.distinct_estimates(back, ["city"])) == rows(
        profile.distinct_estimates(profile.distinct_sketches(venues_small), ["city"])
    )


def test_ranges_of_absent_columns(spark):
    df = spark.createDataFrame([(3,), (5,)], "votes long")
    got = {r.feature: tuple(r)[1:] for r in profile.numeric_ranges(df, ["votes", "avg_cost", "other"]).collect()}
    assert got == {"votes": (3, 5, 4), "avg_cost": (0, 5000, 500), "other": (None, None, None)}


def dictionary_table(spark, dictionary):
    entries = [(i, c, w) for i, (c, ws) in enumerate(dictionary) for w in ws]
    return spark.createDataFrame(entries, "position int, category string, keyword string")


@pytest.mark.parametrize("dictionary", [CUISINE_KEYWORDS, WORD_PIECES])
def test_automaton_equals_single_tests(spark, dictionary):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    extra = [(-1, None), (-2, ""), (-3, "<p>Pizza PASTA curry dosa"), (-3, "<p>naan")]
    pages = pages.unionByName(spark.createDataFrame(extra, "page_id long, html string"))
    got = automaton.page_keywords_table(pages, dictionary_table(spark, dictionary))
    want = keywords.page_keywords(pages, dictionary)
    assert [r[:2] + (round(r[2], 9),) + r[3:] for r in rows(got)] == [
        r[:2] + (round(r[2], 9),) + r[3:] for r in rows(want)
    ]


def test_automaton_overlaps_and_parts(spark, monkeypatch):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(60)})
    dictionary = [(f"c{i}", words[i::4] + words[:3]) for i in range(4)]
    texts = [(i, "".join(rng.choices("abc ", k=rng.randint(0, 40)))) for i in range(80)]
    pages = spark.createDataFrame(texts, "page_id long, html string")
    entries = dictionary_table(spark, dictionary)
    entries = entries.unionByName(entries).unionByName(
        spark.createDataFrame([(0, "c0", ""), (1, "c1", None)], entries.schema)
    )
    want = rows(keywords.page_keywords(pages, [(c, sorted(set(w))) for c, w in dictionary]))
    for size in (1000, 7):  # one part, several
        monkeypatch.setattr(automaton, "PART_KEYWORDS", size)
        assert len(automaton.parts(entries)) == (1 if size == 1000 else -(-len(words) // 7))
        assert [close(a, b) for a, b in zip(rows(automaton.page_keywords_table(pages, entries)), want)]
        assert len(want) == len(texts)
        assert all(close(a, b) for a, b in zip(rows(automaton.page_keywords_table(pages, entries)), want))


def test_fifty_thousand_keywords(spark):
    entries = spark.range(50_000).select(
        (F.col("id") % 5).cast("int").alias("position"),
        F.concat(F.lit("g"), F.col("id") % 5).alias("category"),
        F.concat(F.lit("key"), F.col("id"), F.lit("x")).alias("keyword"),
    )
    pages = spark.createDataFrame(
        [(1, "key7x key12x KEY49997x"), (2, "key1x key6x"), (3, "key"), (4, "akey50000x")],
        "page_id long, html string",
    )
    got = {r.page_id: (r.cuisine, r.hits) for r in automaton.page_keywords_table(pages, entries).collect()}
    assert got == {1: ("g2", 3), 2: ("g1", 2), 3: ("Unknown", 0), 4: ("Unknown", 0)}


def test_cached_ratings_expire(spark, venues_small, tmp_path):
    model = models.train_rating_model(venues_small, num_trees=5, max_depth=4)
    schema = (
        "request_id long, requested_at timestamp, online_order int, book_table int, votes long, "
        "location string, rest_type string, cuisines string, cost double"
    )
    source = tmp_path / "in"
    source.mkdir()

    def send(name, *asked):
        lines = [
            json.dumps({"request_id": i, "requested_at": f"2024-01-01T{at}:00Z", "online_order": 1,
                        "book_table": 0, "votes": votes, "location": place, "rest_type": "BUILDING",
                        "cuisines": "Brand#11", "cost": 100.0})
            for i, at, votes, place in asked
        ]
        (source / f"{name}.json").write_text("\n".join(lines))
        query = cache.stream_cached_ratings(
            spark, model, str(source), schema, str(tmp_path / "out"), ttl_seconds=3600, available_now=True
        )
        query.awaitTermination(300)
        found = spark.read.parquet(str(tmp_path / "out" / "results"))
        return {r.request_id: r for r in found.collect()}

    send("a", (1, "10:00", 5, "nation_3"), (2, "10:10", 5, "nation_3"), (3, "10:00", 9, None))
    send("b", (4, "10:59", 5, "nation_3"), (5, "10:30", 9, None))
    got = send("c", (6, "11:00", 5, "nation_3"), (7, "11:59", 5, "nation_3"), (8, "10:59", 9, None))
    fresh = {i: r.fresh for i, r in got.items()}
    assert fresh == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False, 8: False}
    assert got[7].scored_at == got[6].requested_at and got[4].scored_at == got[1].requested_at
    assert len({r.predicted_rating for i, r in got.items() if i in (1, 2, 4, 6, 7)}) == 1
    scored = spark.read.parquet(str(tmp_path / "out" / "scores"))
    assert scored.count() == 3


def test_adaptive_search_against_random_search():
    space = {"num_trees": (50, 200), "max_depth": (5, 20)}
    score = lambda num_trees, max_depth: (
        -(((num_trees - 140) / 150) ** 2) - ((max_depth - 7) / 15) ** 2
    )
    wins, gain = 0, 0.0
    for seed in range(40):
        found = search.adaptive_search(score, space, 20, seed)
        assert len({tuple(v.values()) for v, _ in found}) == 20
        rng = random.Random(seed)
        chance = max(score(rng.randint(50, 200), rng.randint(5, 20)) for _ in range(20))
        best = max(s for _, s in found)
        wins, gain = wins + (best >= chance), gain + best - chance
    assert wins >= 28 and gain > 0
    # a small space is tried out, side by side
    assert len(search.adaptive_search(score, {"num_trees": (1, 2), "max_depth": (1, 2)}, 20, 1, 4)) == 4


def _r2(forest, test):
    from pyspark.ml.evaluation import RegressionEvaluator

    return RegressionEvaluator(labelCol="label", metricName="r2").evaluate(forest.transform(test))


def test_nested_scores_equal_fits(spark, venues_small):
    from platewise.operators import nested

    kept = models.prepare_rating(venues_small)
    test = kept.rows.where("split = 'test'")
    grown = nested.grow(models._rating_forest, kept.train, 6, 7, 42, 1)
    scores = nested.r2_scores(grown, test, 7)
    for depth in (0, 1, 4, 7):
        want = _r2(models._rating_forest(6, depth, 42).fit(kept.train), test)
        assert scores[6, depth] == pytest.approx(want, abs=1e-9)
    kept.release()


@pytest.mark.parametrize("shared", [True, False])
def test_tuning(spark, venues_small, shared):
    found, model = models.tune_rating(
        venues_small, n_trials=5, trees=(2, 6), depth=(1, 4), parallelism=2, shared=shared
    )
    tries = found.collect()
    assert len({(t.num_trees, t.max_depth) for t in tries}) == 5
    assert [t.r2 for t in tries] == sorted((t.r2 for t in tries), reverse=True)
    assert model.forest.getNumTrees == tries[0].num_trees
    assert sum(r.importance for r in model.importances().collect()) == pytest.approx(1.0)


def test_digits_tell_ten_thousand_codes_apart(spark):
    from pyspark.ml.feature import VectorAssembler

    codes = spark.range(10_000).select(
        F.lit("c").alias("feature"), F.format_string("v%05d", "id").alias("value"), F.col("id").alias("code")
    )
    digits = features.code_digits(codes, ["c"])
    assert digits == {"c": 2}
    rows = codes.select(F.col("code").alias("c_code"), (F.col("code") >= 7777).cast("double").alias("label"))
    names = features.digit_columns(["votes", "c_code"], digits)
    assert names == ["votes", "c_code_0", "c_code_1"]
    table = VectorAssembler(inputCols=names[1:], outputCol="features").transform(
        features.with_digits(rows, digits)
    )
    assert table.select("features").distinct().count() == 10_000
    forest = models._rating_forest(5, 6, 1).fit(table)
    assert _r2(forest, table) > 0.999  # the threshold is between two of 10,000 codes
    # one feature of 256 quantiles cannot
    plain = VectorAssembler(inputCols=["c_code"], outputCol="features").transform(rows)
    assert _r2(models._rating_forest(5, 6, 1).fit(plain), plain) < 0.999


def test_insights_of_one_model(spark, venues_small):
    model = models.train_rating_model(venues_small, num_trees=3, max_depth=3)
    got = {(r.split, r.metric): r.value for r in models.rating_insights(model).collect()}
    assert len(got) == 2 * 5 + 7
    for split in ("train", "test"):
        assert got[split, "accuracy_pct"] == pytest.approx(100 * got[split, "r2"])
    assert sum(v for (s, _), v in got.items() if s == "model") == pytest.approx(1.0)
