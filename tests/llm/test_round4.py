"""Findings of round 3: slices of texts, training on all labelled rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platewise.llm import ranking, resampling


def test_op12_slices_without_nulls():
    texts = ["Zz y", "a\x00B c", "", "d é f " + "w" * 80, "g"]
    for start in range(len(texts)):
        for kind in (pa.string(), pa.large_string()):
            part = pa.array(texts, kind).slice(start)
            words = [
                (zlib.crc32(w.encode()) % 10000, i)
                for i, t in enumerate(texts[start:])
                for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
            ]
            bucket, owner = resampling.feature_buckets(part, 1, 10000)
            assert list(zip(bucket.tolist(), owner.tolist())) == words


def test_op13_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows than a sample of 20,000 held; ids that repeat count once."""
    ids = spark.range(30000).select(F.col("id").alias("doc_id"))
    table = ids.withColumn("text", F.concat(F.lit("a b "), (F.col("doc_id") % 9).cast("string")))
    table = table.unionByName(table.where("doc_id < 50").withColumn("text", F.lit("zzz $$$")))
    labels = ids.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    met = []
    pairs = ranking.preference_pairs

    def watched(rows, partners):
        met.append(rows.agg(F.count("*"), F.count_distinct("id"), F.max(F.col("x")[6])).first())
        return pairs(rows, partners)

    monkeypatch.setattr(ranking, "preference_pairs", watched)
    assert ranking.fit(table, labels) is not None
    learnt = ids.where(~ranking.held_out(F.col("doc_id"))).count()
    # the smaller text of an id that repeats has no symbols
    assert [tuple(m) for m in met] == [(learnt, learnt, 0.0)] and learnt > 20000


def test_op13_places_and_quantile(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 40, 501).astype(float)
    rows = spark.createDataFrame([(i, i % 2, float(v)) for i, v in enumerate(values)], "id long, good int, v double")
    rows = rows.repartition(7)
    for share in (0.0, 0.37, 0.5, 1.0):
        want = rows.agg(F.percentile("v", F.lit(share))).first()[0]
        assert ranking.quantile(rows, F.col("v"), share) == pytest.approx(want, abs=1e-12)
    got = {(r.good, r.place): r.id for r in ranking.placed(rows, "good", F.desc("v"), F.col("id")).collect()}
    for good in (0, 1):
        order = sorted(range(good, 501, 2), key=lambda i: (-values[i], i))
        assert [got[good, k] for k in range(len(order))] == order and len(got) == 501
