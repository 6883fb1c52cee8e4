"""Findings of round 3: forests fit in few tasks, whatever the partitions of their rows."""

from pyspark.ml.linalg import Vectors

from platewise.operators import models


def test_forest_statistics_come_from_few_tasks(spark, monkeypatch):
    rows = [("train" if i % 5 else "test", float(i % 7), Vectors.dense([i % 3, i])) for i in range(400)]
    kept = spark.createDataFrame(rows, ["split", "label", "features"]).repartition(100)
    cores = spark.sparkContext.defaultParallelism
    seen = []
    forest = models._rating_forest

    class Watched:
        def __init__(self, *size):
            self.forest = forest(*size)

        def fit(self, train):
            seen.append(train.rdd.getNumPartitions())
            assert train.count() == sum(r[0] == "train" for r in rows)
            return self.forest.fit(train)

    monkeypatch.setattr(models, "_rating_forest", Watched)
    codes = spark.createDataFrame([], "feature string, value string, code long")
    model = models.RatingRows(codes, {"city": 1}, kept).fit(2, 3, 42)
    assert len(seen) == 1 and seen[0] <= models.TASKS_PER_CORE * cores < 100
    assert {r.split: r.n for r in model.metrics.collect()} == {"train": 320, "test": 80}
