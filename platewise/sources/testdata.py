"""Venue view over the TPC-H-like test tables (see FIXTURES.md §2).

One venue per order.  Built with DataFrame operations only; the oracle side
writes the same derivation independently in SQL.

Plan at scale: ``lineitem`` is the large table.  Its lines are joined to
``part`` for the brand (Spark broadcasts ``part`` only when its measured size
is under the broadcast threshold, else it is a sort-merge join), then reduced
to one row per order with a partial (map-side) aggregate.  The per-order
result stays hash-partitioned by order key, so the join with ``orders`` only
shuffles ``orders``.  ``nation`` (25 rows) is broadcast by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _price_range(priority: Column) -> Column:
    digit = F.substring(priority, 1, 1)
    return (
        F.when(digit == "1", F.lit(4))
        .when(digit == "2", F.lit(3))
        .when(digit == "3", F.lit(2))
        .when(digit == "5", F.lit(1))
        .cast("int")
    )


def venues(spark: SparkSession, sf_dir: str, city_gaps: bool = True) -> DataFrame:
    """The venue table V, derived from the TPC-H-like tables in the plan of
    every query that reads it (nothing is stored).

    ``city_gaps`` blanks ``city`` for every venue id divisible by 23, so the
    'Unknown' rules of the operators have rows to act on.
    """
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    per_order = (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey, "left")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            # whole cents and whole percent: sums do not depend on row order
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
            F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("discount_pct"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
            F.max(F.col("l_returnflag") == "R").alias("any_returned"),
            F.array_sort(F.collect_set("p_brand")).alias("brands"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
    )
    key = F.col("o_orderkey")
    city = F.col("n_name")
    if city_gaps:
        city = F.when(key % 23 == 0, F.lit(None).cast("string")).otherwise(city)
    return joined.select(
        key.alias("venue_id"),
        F.col("c_name").alias("venue_name"),
        city.alias("city"),
        F.concat(F.col("c_mktsegment"), F.lit("#"), (F.col("c_custkey") % 7).cast("string")).alias(
            "locality"
        ),
        F.col("c_mktsegment").alias("rest_type"),
        F.when(F.size("brands") > 0, F.array_join("brands", ", ")).alias("cuisines"),
        F.floor(F.col("cents") / (F.col("n_lines") * 100.0)).cast("bigint").alias("avg_cost"),
        _price_range(F.col("o_orderpriority")).alias("price_range"),
        (F.lit(5.0) - F.lit(0.5) * F.col("discount_pct") / F.col("n_lines")).alias("rating"),
        F.coalesce(F.col("qty"), F.lit(0).cast("bigint")).alias("votes"),
        F.when(F.col("o_orderstatus") == "F", "Yes")
        .when(F.col("o_orderstatus") == "O", "No")
        .alias("has_table_booking"),
        F.when(F.coalesce(F.col("any_returned"), F.lit(False)), "Yes")
        .otherwise("No")
        .alias("has_online_delivery"),
        F.when(
            key % 17 != 0,
            F.col("c_nationkey") * 6 - 75 + (F.col("o_custkey") % 64) / 64,
        ).alias("latitude"),
        F.when(key % 19 != 0, F.col("c_nationkey") * 14 - 175 + (key % 64) / 64).alias(
            "longitude"
        ),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")
