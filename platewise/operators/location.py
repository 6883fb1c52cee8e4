"""Location analysis: city and locality summaries, map extracts, rankings.

Null rule of this task (see ``location_rules``): city/locality 'Unknown',
missing rating and cost count as 0.  Rankings exclude the 'Unknown' city;
distinct counts include it.  Ties: count desc, then name asc.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.expressions import main_cuisine, yes_no_flag
from platewise.operators.common import location_rules, mode_by
from platewise.schema import NOT_AVAILABLE, UNKNOWN

def known_city():
    return F.col("city") != UNKNOWN


def city_stats(venues: DataFrame) -> DataFrame:
    """Venues, mean rating and % delivery / % booking per known city."""
    loc = location_rules(venues)
    return (
        loc.where(known_city())
        .groupBy("city")
        .agg(
            F.count(F.lit(1)).alias("restaurant_count"),
            F.avg("rating").alias("average_rating"),
            (F.avg(yes_no_flag("has_online_delivery")) * 100).alias("online_order_percentage"),
            (F.avg(yes_no_flag("has_table_booking")) * 100).alias("table_booking_percentage"),
        )
    )


def city_table(venues: DataFrame) -> DataFrame:
    """Per known city: count, mean rating, mean cost and top cuisine.

    The top cuisine is the mode of the whole cuisines text (non-null only),
    then its first item.  Two aggregations, no join: (city, cuisines) first,
    so a hot city spreads over many tasks, then city.
    """
    loc = location_rules(venues).where(known_city())
    by_text = loc.groupBy("city", "cuisines").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("rating").alias("sum_rating"),
        F.sum("avg_cost").alias("sum_cost"),
    )
    mode_key = F.when(F.col("cuisines").isNotNull(), F.struct(-F.col("n"), F.col("cuisines")))
    per_city = by_text.groupBy("city").agg(
        F.sum("n").alias("count"),
        (F.sum("sum_rating") / F.sum("n")).alias("avg_rating"),
        (F.sum("sum_cost") / F.sum("n")).alias("avg_cost"),
        F.min(mode_key).getField("cuisines").alias("_mode"),
    )
    return per_city.select(
        "city",
        "count",
        "avg_rating",
        "avg_cost",
        F.coalesce(main_cuisine("_mode", missing=None), F.lit(UNKNOWN)).alias("top_cuisine"),
    )


def city_overview(venues: DataFrame, n: int | None = 15) -> DataFrame:
    """E2 (+D1): the city table sorted by count desc, city asc; top ``n``."""
    ordered = city_table(venues).orderBy(F.desc("count"), "city")
    return ordered if n is None else ordered.limit(n)


def sort_cities(cities: DataFrame, key: str = "count") -> DataFrame:
    """Sort a city table by count, avg_rating or avg_cost (desc), city asc."""
    if key not in ("count", "avg_rating", "avg_cost"):
        raise ValueError(f"unknown sort key {key!r}")
    return cities.orderBy(F.desc(key), "city")


def insights(venues: DataFrame) -> DataFrame:
    """One row of headline numbers.

    Venues are first reduced to (city, locality) groups and then to cities,
    so the final one-row aggregate and the distinct-locality count run over
    small tables.  Rankings use ``min`` of (−value, city) structs: the largest
    value wins, the alphabetically first city on ties; 'Unknown' is skipped.
    With no known city the reference reports zeros and 'N/A'.
    """
    loc = location_rules(venues)
    by_loc = loc.groupBy("city", "locality").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("rating").alias("sum_rating"),
        F.sum("avg_cost").alias("sum_cost"),
    )
    by_city = by_loc.groupBy("city").agg(
        F.sum("n").alias("n"),
        F.sum("sum_rating").alias("sum_rating"),
        F.sum("sum_cost").alias("sum_cost"),
    )
    n_localities = by_loc.select(F.count_distinct("locality")).scalar()

    def best(value):
        return F.min(F.when(known_city(), F.struct(-value, F.col("city")))).getField("city")

    row = by_city.agg(
        F.sum("n").alias("total_restaurants"),
        F.count(F.lit(1)).alias("_cities"),
        F.count(F.when(known_city(), 1)).alias("_known"),
        (F.sum("sum_rating") / F.sum("n")).alias("_avg"),
        best(F.col("sum_rating") / F.col("n")).alias("_best_rated"),
        best(F.col("n")).alias("_densest"),
        best(F.col("sum_cost") / F.col("n")).alias("_priciest"),
    )
    has_known = F.col("_known") > 0
    return row.select(
        F.coalesce(F.col("total_restaurants"), F.lit(0)).cast("bigint").alias("total_restaurants"),
        F.when(has_known, F.col("_cities")).otherwise(0).cast("bigint").alias("total_cities"),
        F.when(has_known, n_localities).otherwise(0).cast("bigint").alias("total_localities"),
        F.when(has_known, F.col("_best_rated")).otherwise(NOT_AVAILABLE).alias("highest_rated_city"),
        F.when(has_known, F.col("_densest"))
        .otherwise(NOT_AVAILABLE)
        .alias("highest_restaurant_density_city"),
        F.when(has_known, F.col("_avg")).otherwise(0.0).alias("avg_rating_overall"),
        F.when(has_known, F.col("_priciest")).otherwise(NOT_AVAILABLE).alias("most_expensive_city"),
    )


def city_rankings(venues: DataFrame) -> DataFrame:
    """The city with the largest mean rating, count and mean cost
    (alphabetical first on ties, 'Unknown' excluded), one row per metric."""
    cities = city_table(venues)

    def top(metric: str, value: str):
        winner = F.min(F.struct((-F.col(value)).alias("neg"), F.col("city").alias("city")))
        return F.struct(
            F.lit(metric).alias("metric"),
            winner.getField("city").alias("city"),
            (-winner.getField("neg")).cast("double").alias("value"),
        )

    row = cities.agg(
        F.array(
            top("highest_rated", "avg_rating"),
            top("most_venues", "count"),
            top("most_expensive", "avg_cost"),
        ).alias("r")
    )
    return row.select(F.inline("r")).where(F.col("city").isNotNull())


def locality_stats(venues: DataFrame, cities: DataFrame | str, n: int = 15) -> DataFrame:
    """E4 (batch form): top ``n`` localities of each requested city.

    ``cities`` is a DataFrame with a ``city`` column (one row per request) or
    a single name.  A venue belongs to a request when its city equals the
    requested one ignoring case.  Per locality: modal city spelling, count,
    mean rating, modal price range (2 when no price is known).
    """
    spark = venues.sparkSession
    if isinstance(cities, str):
        cities = spark.createDataFrame([(cities,)], "city string")
    requests = cities.select(F.col("city").alias("requested_city")).distinct()
    requests = requests.withColumn("_key", F.lower("requested_city"))
    loc = location_rules(venues)
    rows = loc.join(requests, F.lower(loc.city) == requests._key).select(
        "requested_city", "locality", "city", "price_range", "rating"
    )
    # one reduction of the venue rows; the three branches below reuse it
    grouped = rows.groupBy("requested_city", "locality", "city", "price_range").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("sum_rating")
    )
    keys = ["requested_city", "locality"]
    per_loc = grouped.groupBy(*keys).agg(
        F.sum("n").alias("count"), (F.sum("sum_rating") / F.sum("n")).alias("avg_rating")
    )
    city_mode = (
        grouped.groupBy(*keys, "city")
        .agg(F.sum("n").alias("_n"))
        .groupBy(*keys)
        .agg(F.min_by("city", F.struct(-F.col("_n"), F.col("city"))).alias("city"))
    )
    price_mode = (
        grouped.where(F.col("price_range").isNotNull())
        .groupBy(*keys, "price_range")
        .agg(F.sum("n").alias("_n"))
        .groupBy(*keys)
        .agg(
            F.min_by("price_range", F.struct(-F.col("_n"), F.col("price_range"))).alias(
                "price_range_mode"
            )
        )
    )
    stats = per_loc.join(city_mode, keys).join(price_mode, keys, "left")
    rank = F.row_number().over(
        Window.partitionBy("requested_city").orderBy(F.desc("count"), "locality")
    )
    return (
        stats.withColumn("_rank", rank)
        .where(F.col("_rank") <= n)
        .select(
            "requested_city",
            "locality",
            "city",
            "count",
            "avg_rating",
            F.coalesce(F.col("price_range_mode"), F.lit(2)).cast("int").alias("price_range_mode"),
        )
    )


def top_city_localities(venues: DataFrame, n: int = 15) -> DataFrame:
    """Localities of the city with the most venues (the location report's
    second table): the request is the first row of ``city_overview``."""
    return locality_stats(venues, city_overview(venues, 1).select("city"), n)


def _map_columns(loc: DataFrame) -> list:
    return [
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"),
        F.col("venue_name").alias("name"),
        "city",
        "rating",
    ]


def map_points(venues: DataFrame, n: int = 500) -> DataFrame:
    """G1: valid coordinates first, then the first ``n`` by venue id."""
    loc = location_rules(venues).na.drop(subset=["latitude", "longitude"])
    return loc.orderBy("venue_id").limit(n).select("venue_id", *_map_columns(loc))


def location_distribution(venues: DataFrame, n: int = 500) -> DataFrame:
    """The first ``n`` venues by id, then only those with coordinates."""
    loc = location_rules(venues)
    first = loc.orderBy("venue_id").limit(n)
    return first.na.drop(subset=["latitude", "longitude"]).select("venue_id", *_map_columns(loc))


def map_data(venues: DataFrame) -> DataFrame:
    """Every venue with coordinates, best rating first, with its main
    cuisine and cost.  No limit."""
    loc = location_rules(venues).na.drop(subset=["latitude", "longitude"])
    return loc.select(
        "venue_id",
        *_map_columns(loc),
        main_cuisine("cuisines").alias("cuisine"),
        F.col("avg_cost").alias("cost"),
    ).orderBy(F.desc("rating"), "venue_id")


def grid_clusters(venues: DataFrame, cell: float = 1.0) -> DataFrame:
    """Venues per map cell of ``cell`` degrees: count, mean rating and
    centre (a server-side roll-up of marker clustering)."""
    loc = location_rules(venues).na.drop(subset=["latitude", "longitude"])
    return (
        loc.withColumns(
            {
                "cell_lat": F.floor(F.col("latitude") / cell),
                "cell_lng": F.floor(F.col("longitude") / cell),
            }
        )
        .groupBy("cell_lat", "cell_lng")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("rating").alias("avg_rating"),
            F.avg("latitude").alias("center_lat"),
            F.avg("longitude").alias("center_lng"),
        )
    )


def map_pyramid(venues: DataFrame, levels: int = 7, widest: float = 16.0) -> DataFrame:
    """E10 at all zoom levels: the cells of level 0 are ``widest`` degrees,
    those of every further level half of that.  Per level and cell: count, mean
    rating, centre and extent (a click on a cluster zooms to it).

    GROUPING SETS over the nested cell numbers: one shuffle for all levels, and
    each task sends one partial row per cell and level that it has seen."""
    loc = location_rules(venues).na.drop(subset=["latitude", "longitude"])
    names, sets = {}, []
    for level in range(levels):
        cell = widest / 2**level
        pair = [f"lat_{level}", f"lng_{level}"]
        names |= {c: F.floor(F.col(a) / cell) for c, a in zip(pair, ("latitude", "longitude"))}
        sets.append(pair)
    keys = [c for pair in sets for c in pair]
    grouped = loc.select("rating", "latitude", "longitude", *[v.alias(c) for c, v in names.items()])
    summed = grouped.groupingSets([[F.col(c) for c in pair] for pair in sets], *keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("rating").alias("avg_rating"),
        F.avg("latitude").alias("center_lat"),
        F.avg("longitude").alias("center_lng"),
        F.min("latitude").alias("south"),
        F.max("latitude").alias("north"),
        F.min("longitude").alias("west"),
        F.max("longitude").alias("east"),
    )
    # cell numbers are never null: the set of a row is the one that is not
    level = F.coalesce(*[F.when(F.col(lat).isNotNull(), i) for i, (lat, _) in enumerate(sets)])
    return summed.select(
        level.alias("level"),
        F.coalesce(*[lat for lat, _ in sets]).alias("cell_lat"),
        F.coalesce(*[lng for _, lng in sets]).alias("cell_lng"),
        "count", "avg_rating", "center_lat", "center_lng", "south", "north", "west", "east",
    )


def city_share(venues: DataFrame) -> DataFrame:
    """per known city, % of all venues (the total counts 'Unknown' too)
    and % of the largest city.  Totals come from one-row scalar subqueries
    over the per-city table, not from an unpartitioned window."""
    loc = location_rules(venues)
    by_city = loc.groupBy("city").agg(F.count(F.lit(1)).alias("count"))
    total = by_city.select(F.sum("count")).scalar()
    largest = by_city.where(known_city()).select(F.max("count")).scalar()
    return by_city.where(known_city()).select(
        "city",
        "count",
        (F.col("count") * 100.0 / total).alias("share_pct"),
        (F.col("count") * 100.0 / largest).alias("pct_of_largest"),
    )


def city_rank(venues: DataFrame, k: int = 3) -> DataFrame:
    """rank badge 1..k for the first ``k`` cities by count (city asc on
    ties).  The top-k runs distributed (partial top-k per task); the window
    then numbers only k rows."""
    top = city_table(venues).orderBy(F.desc("count"), "city").limit(k)
    return top.select(
        "city",
        "count",
        F.row_number().over(Window.orderBy(F.desc("count"), "city")).alias("rank"),
    )


def search(
    df: DataFrame, term: str | None, columns: list[str], min_rating: float = 0.0,
    rating_col: str = "avg_rating",
) -> DataFrame:
    """Rows where any of ``columns`` contains ``term`` ignoring case, and
    the rating is at least ``min_rating``."""
    cond = F.col(rating_col) >= F.lit(min_rating)
    if term:
        needle = F.lower(F.lit(term))
        hit = None
        for c in columns:
            h = F.contains(F.lower(F.col(c)), needle)
            hit = h if hit is None else (hit | h)
        cond = cond & hit
    return df.where(cond)
