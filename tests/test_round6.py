"""the recommender's memory by task."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from platewise.operators import patterns, similarity

TEXTS = [
    (1, "Thai, thai curry b b price_2 x"), (2, "b"), (2, "b Noodles"), (3, None), (4, ""),
    (None, "curry b"), (5, "x, the the"), (6, "z z y z y"), (6, "z"),
]


def test_short_texts_are_counted_without_a_group_per_token(spark):
    df = spark.createDataFrame(TEXTS, "id bigint, text string")
    counted = similarity._token_rows(df, "id", "text", ())
    got = {(r.id, r.token): r.tf for r in counted.collect()}
    assert len(got) == counted.count()
    want = Counter((r.id, r.token) for r in similarity.tokens(df, "id", "text", ()).collect())
    assert got == dict(want)
    plan = similarity.fit_vectors(df, "id", "text")[1]._jdf.queryExecution().optimizedPlan().toString()
    # a group per id and token was held before
    assert not re.search(r"Aggregate \[id#\d+L?, token#\d+\]", plan), plan


def test_vectors_are_those_of_the_token_rows(spark):
    df = spark.createDataFrame(TEXTS, "id bigint, text string")
    vectors = {r.id: r.vec for r in similarity.fit_vectors(df, "id", "text")[1].collect()}
    wide = similarity.fit_tfidf(df, "id", "text")[1].collect()
    assert {k: set(v) for k, v in vectors.items()} == {
        i: {r.token for r in wide if r.id == i} for i in {r.id for r in wide}
    }
    for r in wide:
        assert abs(vectors[r.id][r.token] - r.weight) < 1e-12


def test_grams_of_a_text(spark):
    texts = ["", "a", "ab", "abc", "Brand#12, Brand#1", "aaaa", "é😀x\ny\r", "ſK"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {}
    for r in patterns.text_grams(df, "t").collect():
        got.setdefault(r.t, []).append(r.gram)
    low = {r.t: r.low for r in df.select("t", patterns.folded(F.col("t")).alias("low")).collect()}
    for t in texts:
        want = {low[t][i : i + n] for n in (1, 2, 3) for i in range(len(low[t]) - n + 1)} | {""}
        assert sorted(got[t]) == sorted(want)


def test_index_holds_only_the_grams_that_patterns_ask_for(spark):
    texts = spark.createDataFrame([("thai, chinese",), ("brand#12",)], "t string")
    asked = spark.createDataFrame([("brand#1",), ("t.*i",), ("no-such",)], "p string")
    found = patterns.candidates(asked, "p", texts, "t")
    assert {tuple(r) for r in found.collect()} == {("brand#1", "brand#12"), ("t.*i", "thai, chinese")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # all grams of all texts were grouped before
    assert "LeftSemi" in plan, plan
