"""Deterministic baseline predictions used to check the metric operators
exactly (forest predictions cannot be compared bit for bit).

* rating: mean training rating of the venue's city (overall training mean
  for a city without training rows);
* cuisine: modal main cuisine of the venue's locality among training rows
  (overall modal class for an unseen locality), over the top-10 classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.common import mode_by
from platewise.operators.features import split_plain, split_stratified, top_classes
from platewise.schema import UNKNOWN


def rating_rows(venues: DataFrame) -> DataFrame:
    """Rating task rows: rating known (B6), categories filled 'Unknown'."""
    return venues.where(F.col("rating").isNotNull()).withColumns(
        {c: F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in ("city", "cuisines", "rest_type")}
    )


def rating_baseline(venues: DataFrame) -> DataFrame:
    rows = split_plain(rating_rows(venues), "venue_id")
    train = rows.where(F.col("split") == "train")
    city_mean = train.groupBy("city").agg(F.avg("rating").alias("_city_mean"))
    overall = train.select(F.avg("rating")).scalar()
    return rows.join(city_mean, "city", "left").select(
        "venue_id",
        "split",
        F.col("rating").alias("label"),
        F.coalesce(F.col("_city_mean"), overall).alias("prediction"),
    )


def cuisine_rows(venues: DataFrame, k: int = 10) -> DataFrame:
    """Classification rows: top-k main cuisines, stratified split.  The
    branches that use it (training modes, the overall mode, the scored rows)
    have the same plan below, so they share its exchanges."""
    rows = top_classes(venues, k).select(
        "venue_id",
        F.coalesce(F.col("locality"), F.lit(UNKNOWN)).alias("locality"),
        F.col("main_cuisine").alias("label"),
    )
    return split_stratified(rows, "venue_id", "label")


def cuisine_baseline(venues: DataFrame) -> DataFrame:
    rows = cuisine_rows(venues)
    train = rows.where(F.col("split") == "train")
    by_locality = mode_by(train, ["locality"], "label", "_mode")
    overall = (
        train.groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))))
        .scalar()
    )
    return rows.join(by_locality, "locality", "left").select(
        "venue_id", "split", "label", F.coalesce(F.col("_mode"), overall).alias("prediction")
    )
