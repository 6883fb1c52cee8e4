"""Column profiles: class distribution, numeric ranges, distinct values and
a repeatable example row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.expressions import cuisine_items, main_cuisine, yes_no_flag
from platewise.operators.common import mode_by
from platewise.schema import UNKNOWN


def class_distribution(venues: DataFrame) -> DataFrame:
    """E5: venues per main cuisine (missing cuisines -> 'Unknown') and their
    share of all venues.  The total is a one-row scalar subquery."""
    labelled = venues.select(main_cuisine("cuisines").alias("main_cuisine"))
    counts = labelled.groupBy("main_cuisine").agg(F.count(F.lit(1)).alias("count"))
    total = counts.select(F.sum("count")).scalar()
    return counts.select("main_cuisine", "count", (F.col("count") / total).alias("share"))


# Fixed values: (min, max, mean) of a form field whose column is absent.
DEFAULT_RANGES = {"votes": (0, 10000, 100), "avg_cost": (0, 5000, 500)}


def numeric_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min, max and truncated mean of numeric columns, one row per
    column; an absent column has its ``DEFAULT_RANGES`` (else nulls).  One aggregate
    pass, reshaped with ``stack``."""
    aggs = []
    for c in columns:
        if c not in df.columns:
            fixed = DEFAULT_RANGES.get(c, (None, None, None))
            names = (f"{c}__min", f"{c}__max", f"{c}__avg")
            aggs += [F.max(F.lit(x).cast("bigint")).alias(n) for x, n in zip(fixed, names)]
            continue
        value = F.col(c).try_cast("double")
        aggs += [
            F.min(value).cast("bigint").alias(f"{c}__min"),
            F.max(value).cast("bigint").alias(f"{c}__max"),
            F.avg(value).cast("bigint").alias(f"{c}__avg"),
        ]
    row = df.agg(*aggs)
    args = ", ".join(f"'{c}', `{c}__min`, `{c}__max`, `{c}__avg`" for c in columns)
    return row.selectExpr(f"stack({len(columns)}, {args}) AS (feature, min_value, max_value, avg_value)")


def mode_price_by_city(venues: DataFrame) -> DataFrame:
    """Modal price range per city (missing city -> 'Unknown'); prices
    that are missing are ignored, the smaller price wins ties."""
    df = venues.withColumn("city", F.coalesce(F.col("city"), F.lit(UNKNOWN)))
    return mode_by(df, ["city"], "price_range", "price_range_mode")


def distinct_counts(venues: DataFrame, approx: bool = False) -> DataFrame:
    """Venues and distinct cities, localities, rest types and cuisine
    items (recommender null rule: missing city/cuisines -> 'Unknown')."""
    count_distinct = F.approx_count_distinct if approx else F.count_distinct
    df = venues.withColumns(
        {
            "city": F.coalesce(F.col("city"), F.lit(UNKNOWN)),
            "cuisines": F.coalesce(F.col("cuisines"), F.lit(UNKNOWN)),
        }
    )
    items = df.select(F.explode(cuisine_items("cuisines")).alias("item"))
    n_items = items.select(count_distinct("item")).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("n_venues"),
        count_distinct("city").alias("n_cities"),
        count_distinct("locality").alias("n_localities"),
        count_distinct("rest_type").alias("n_rest_types"),
        n_items.alias("n_cuisines"),
    )


# Sketches of 2^12 registers: a standard error of 1.6 % at any count.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
COUNTED = ("venue_name", "locality", "rest_type", "cuisine")


def distinct_sketches(venues: DataFrame, keys: Sequence[str] = ("city", "price_range")) -> DataFrame:
    """E8, mergeable: per group of ``keys`` one sketch of the distinct values
    of each of ``COUNTED``.  Store it once; ``distinct_estimates`` then serves any
    coarser grouping without another scan of the venues.

    A sketch is a partial aggregate of fixed size, so a group with a third
    of all rows moves as little as any other."""
    df = venues.withColumns(
        {
            "city": F.coalesce(F.col("city"), F.lit(UNKNOWN)),
            "cuisines": F.coalesce(F.col("cuisines"), F.lit(UNKNOWN)),
        }
    )
    one = df.groupBy(*keys).agg(
        *[F.hll_sketch_agg(c, SKETCH_BITS).alias(c) for c in COUNTED if c != "cuisine"]
    )
    items = df.select(*keys, F.explode(cuisine_items("cuisines")).alias("cuisine"))
    many = items.groupBy(*keys).agg(F.hll_sketch_agg("cuisine", SKETCH_BITS).alias("cuisine"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return one.alias("a").join(many.alias("b"), same).select("a.*", "cuisine")


def distinct_estimates(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct counts per group of ``keys`` (a part of the keys of
    the sketches; none: over all), from united sketches."""
    united = sketches.groupBy(*keys).agg(*[F.hll_union_agg(c).alias(c) for c in COUNTED])
    return united.select(*keys, *[F.hll_sketch_estimate(c).alias(c) for c in COUNTED])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values of a column."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def distinct_items(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """Sorted distinct trimmed items of a comma-separated column.
    Missing values are skipped, or read as ``missing`` when given."""
    src = F.col(column) if missing is None else F.coalesce(F.col(column), F.lit(missing))
    items = df.select(F.explode(cuisine_items(src)).alias("item"))
    return items.distinct().orderBy("item")


def sample_row(venues: DataFrame, seed: int = 42) -> DataFrame:
    """One repeatable pseudo-random venue as an example rating request.

    The chosen row has the smallest md5 of (seed, venue id): a partial
    aggregate, no sort and no driver round trip.  Missing values take the
    defaults of the request form.
    """
    picked = _picked(venues, seed)
    return picked.select(
        F.coalesce(F.col("votes").cast("bigint"), F.lit(100)).alias("votes"),
        yes_no_flag("has_online_delivery").alias("online_order"),
        yes_no_flag("has_table_booking").alias("book_table"),
        F.coalesce(F.col("city"), F.lit(UNKNOWN)).alias("location"),
        F.coalesce(F.col("rest_type"), F.lit(UNKNOWN)).alias("rest_type"),
        F.coalesce(F.col("cuisines"), F.lit(UNKNOWN)).alias("cuisines"),
        F.coalesce(F.col("avg_cost").try_cast("double").cast("bigint"), F.lit(500)).alias("cost"),
    )


def sample_class_row(venues: DataFrame, seed: int = 42) -> DataFrame:
    """G5 for the classification form: the same venue as its request, with
    that form's defaults."""

    def flag(column: str) -> Column:
        return F.when(F.col(column).isNull(), F.lit(1)).otherwise(yes_no_flag(column))

    return _picked(venues, seed).select(
        F.coalesce(F.col("city"), F.lit(UNKNOWN)).alias("city"),
        flag("has_table_booking").alias("has_table_booking"),
        flag("has_online_delivery").alias("has_online_delivery"),
        F.coalesce(F.col("price_range").cast("int"), F.lit(2)).alias("price_range"),
        F.coalesce(F.col("votes").cast("bigint"), F.lit(150)).alias("votes"),
    )


# The options of the rating form where a table has none.
OPTION_FALLBACKS = {
    "city": ["Unknown"],
    "rest_type": ["Casual Dining", "Quick Bites", "Cafe", "Fine Dining"],
    "cuisines": ["North Indian", "Chinese", "Continental", "Italian"],
}


def form_options(venues: DataFrame, column: str) -> DataFrame:
    """E11 for a form: the column's distinct values, or the fallbacks of the
    rating form if it has none."""
    found = distinct_values(venues, column)
    fallback = venues.sparkSession.createDataFrame(
        [(v,) for v in OPTION_FALLBACKS[column]], found.schema
    )
    none = found.agg(F.count(F.lit(1)) == 0).scalar()
    return found.unionByName(fallback.where(none))


def _picked(venues: DataFrame, seed: int) -> DataFrame:
    h = F.md5(F.concat(F.lit(str(seed)), F.col("venue_id").cast("string")))
    return venues.agg(F.min_by(F.struct(*venues.columns), h).alias("r")).select("r.*")
