"""Model invariants, save/load round trips, CSV reading and streaming."""

import json
import os

from pyspark.sql import functions as F

from platewise.operators import models, similarity
from platewise.plans.registry import cuisine_requests, rating_requests
from platewise.sources.files import load_tfidf, read_venues, save_tfidf
from platewise.streaming.requests import stream_recommendations

from conftest import SF_SMALL


def test_rating_model_invariants_and_round_trip(spark, venues_small, tmp_path):
    model = models.train_rating_model(venues_small, num_trees=10, max_depth=5)
    req = rating_requests(spark, SF_SMALL)
    pred = models.predict_rating(model, req)
    rows = pred.collect()
    assert len(rows) == req.count()
    assert all(0.0 <= r.predicted_rating <= 5.0 for r in rows)
    imp = model.importances().collect()
    assert abs(sum(r.importance for r in imp) - 1.0) < 1e-9 and len(imp) == 7
    assert {r.split for r in model.metrics.collect()} == {"train", "test"}
    # score_distinct equals direct scoring, also for duplicated rows
    doubled = req.unionByName(req)
    keys = [c for c in req.columns if c != "request_id"]
    sd = models.score_distinct(model, doubled, keys)
    direct = {r.request_id: r.predicted_rating for r in rows}
    assert sd.count() == 2 * len(rows)
    assert all(abs(direct[r.request_id] - r.predicted_rating) < 1e-12 for r in sd.collect())
    path = str(tmp_path / "rating")
    model.save(path)
    again = models.RatingModel.load(spark, path)
    back = {r.request_id: r.predicted_rating for r in models.predict_rating(again, req).collect()}
    assert back == direct


def test_rating_request_missing_columns(spark, venues_small):
    model = models.train_rating_model(venues_small, num_trees=5, max_depth=3)
    req = spark.createDataFrame([(1, "Nowhere")], "request_id bigint, location string")
    r = models.predict_rating(model, req).collect()[0]
    assert 0.0 <= r.predicted_rating <= 5.0


def test_cuisine_top3(spark, venues_small):
    model = models.train_cuisine_model(venues_small, num_trees=10, max_depth=5)
    out = models.predict_cuisine(model, cuisine_requests(spark, SF_SMALL)).toPandas()
    for _, grp in out.groupby("request_id"):
        assert list(grp.sort_values("rank")["rank"]) == [1, 2, 3]
        conf = list(grp.sort_values("rank").confidence)
        assert conf == sorted(conf, reverse=True) and sum(conf) <= 100.0 + 1e-9
    assert model.per_class.count() > 0


def test_tfidf_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red hot chili"), (2, "hot tea"), (3, "")], "doc_id bigint, text string")
    idf, w = similarity.fit_tfidf(docs, "doc_id", "text")
    save_tfidf(idf, w, str(tmp_path / "tfidf"))
    idf2, w2 = load_tfidf(spark, str(tmp_path / "tfidf"))
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, w2.collect()))
    # unit rows, smooth idf: a token in every row still has weight > 0
    norms = w.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-12 for r in norms)


def test_read_venues_csv(spark, tmp_path):
    path = tmp_path / "venues.csv"
    path.write_text(
        "Restaurant Name,City,Locality,Cuisines,Average Cost for two,Price range,"
        "Aggregate rating,Votes,Has Table booking,Has Online delivery,Latitude,Longitude\n"
        "A,Delhi,CP,\"Thai, Indian\",500,2,4.1,10,Yes,no,28.6,77.2\n"
        "B,NA,N/A,,abc,3,NaN,5,No,Yes,bad,77.0\n"
    )
    df = read_venues(spark, str(path))
    rows = sorted(df.collect(), key=lambda r: r.venue_name)
    assert rows[0].cuisines == "Thai, Indian" and rows[0].avg_cost == 500.0
    assert rows[1].city is None and rows[1].locality is None and rows[1].avg_cost is None
    assert rows[1].rating is None and rows[1].latitude is None and rows[1].votes == 5
    assert df.select("venue_id").distinct().count() == 2


def test_stream_recommendations(spark, venues_small, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    reqs = [
        {"request_id": 1, "city": "nation_3", "cuisine": None, "price_range": None,
         "table_booking": None, "online_delivery": None},
        {"request_id": 2, "city": None, "cuisine": None, "price_range": None,
         "table_booking": None, "online_delivery": None},
    ]
    (src / "a.json").write_text("\n".join(json.dumps(r) for r in reqs))
    sink = str(tmp_path / "out")
    q, state = stream_recommendations(spark, venues_small, str(src), sink, str(tmp_path / "ck"),
                               top_n=5, available_now=True)
    q.awaitTermination(300)
    state.release()
    got = spark.read.parquet(sink)
    batch = similarity.recommend(
        spark.createDataFrame([tuple(r.values()) for r in reqs], similarity.REQUEST_SCHEMA),
        venues_small, 5,
    )
    cols = ["request_id", "rank", "venue_id", "similarity_score"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    assert os.path.isdir(tmp_path / "ck")


def test_recommender_state_round_trip(spark, venues_small, tmp_path):
    state = similarity.fit_recommender(venues_small)
    reqs = spark.createDataFrame(
        [(1, "nation_3", None, None, None, None), (2, None, "brand#1", 2, None, True)],
        similarity.REQUEST_SCHEMA,
    )
    before = similarity.recommend(reqs, state, 5)
    state.save(str(tmp_path / "rec"))
    loaded = similarity.Recommender.load(spark, str(tmp_path / "rec"))
    after = similarity.recommend(reqs, loaded, 5)
    cols = ["request_id", "rank", "venue_id", "similarity_score"]
    assert sorted(map(tuple, before.select(cols).collect())) == sorted(
        map(tuple, after.select(cols).collect())
    )
    assert before.count() == 10
