"""Helpers shared by the operators: null rules per task, mode and a
distributed sorted index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.expressions import to_number
from platewise.session import checkpoint_dir
from platewise.schema import UNKNOWN

def location_rules(venues: DataFrame) -> DataFrame:
    """Null rules of the location task: city/locality -> 'Unknown', rating and
    cost parsed tolerantly with missing -> 0, coordinates parsed (bad -> null)."""
    return venues.withColumns(
        {
            "city": F.coalesce(F.col("city"), F.lit(UNKNOWN)),
            "locality": F.coalesce(F.col("locality"), F.lit(UNKNOWN)),
            "rating": to_number("rating", 0.0),
            "avg_cost": to_number("avg_cost", 0.0),
            "latitude": to_number("latitude"),
            "longitude": to_number("longitude"),
        }
    )


def recommendation_rules(venues: DataFrame) -> DataFrame:
    """Null rules of the recommender: cuisines/city -> 'Unknown', price -> 0,
    booking/delivery -> 'No'."""
    return venues.withColumns(
        {
            "cuisines": F.coalesce(F.col("cuisines"), F.lit(UNKNOWN)),
            "city": F.coalesce(F.col("city"), F.lit(UNKNOWN)),
            "price_range": F.coalesce(F.col("price_range").cast("int"), F.lit(0)),
            "has_table_booking": F.coalesce(F.col("has_table_booking"), F.lit("No")),
            "has_online_delivery": F.coalesce(F.col("has_online_delivery"), F.lit("No")),
        }
    )


def mode_by(
    df: DataFrame, keys: Sequence[str], value: str, alias: str | None = None
) -> DataFrame:
    """Most frequent non-null ``value`` per ``keys``; the smallest value
    wins ties.

    Two aggregations instead of a per-group value map: the first is keyed by
    (keys, value), so one hot group is spread over many tasks, and the second
    is a partial (map-side) ``min_by`` over already-counted rows.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return counted.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias(alias or value)
    )


def sorted_codes(values: DataFrame, value: str, code: str = "code") -> DataFrame:
    """Position (0-based) of each distinct non-null ``value`` in sorted order.

    Distributed: a range-partitioned sort, per-partition positions from
    ``monotonically_increasing_id`` (partition index in the upper bits,
    record number in the lower 33), then per-partition offsets from a table
    with one row per partition.  The tagged rows are checkpointed so that
    counts and positions come from the same materialised sort.
    """
    checkpoint_dir(values.sparkSession)
    ordered = values.select(value).where(F.col(value).isNotNull()).distinct().orderBy(value)
    tagged = ordered.select(
        value,
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_mid"),
    ).checkpoint(eager=True)
    local = F.col("_mid") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    per_part = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count
    offsets = per_part.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(
                Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_offset"),
    )
    return tagged.join(F.broadcast(offsets), "_part").select(
        value, (F.col("_offset") + local).alias(code)
    )
