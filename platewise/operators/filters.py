"""Recommendation filters.

``filter_venues`` is the single request form.  The batch form, one plan for a
table of requests, is ``platewise.operators.similarity.recommend``: it joins
on the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.common import recommendation_rules


def yes_no(flag: Column) -> Column:
    """True -> 'yes', false -> 'no', null -> null."""
    return F.when(flag, F.lit("yes")).when(~flag, F.lit("no"))


def filter_venues(
    venues: DataFrame,
    city: str | None = None,
    cuisine: str | None = None,
    price_range: int | None = None,
    table_booking: bool | None = None,
    online_delivery: bool | None = None,
    literal: bool = False,
) -> DataFrame:
    """Venues (recommender null rule) that pass every given filter; an
    empty or missing value means no filter.  The cuisine is a regular
    expression unless ``literal``.  Conditions are plain column predicates,
    so Catalyst pushes them down to the scan where it can."""
    rec = recommendation_rules(venues)
    cond = F.lit(True)
    if city:
        cond = cond & (F.lower("city") == F.lower(F.lit(city)))
    if cuisine and literal:
        cond = cond & F.contains(F.lower("cuisines"), F.lower(F.lit(cuisine)))
    elif cuisine:
        cond = cond & F.col("cuisines").rlike("(?iu)" + cuisine)
    if price_range is not None:
        cond = cond & (F.col("price_range") == F.lit(int(price_range)))
    if table_booking is not None:
        cond = cond & (F.lower("has_table_booking") == yes_no(F.lit(bool(table_booking))))
    if online_delivery is not None:
        cond = cond & (F.lower("has_online_delivery") == yes_no(F.lit(bool(online_delivery))))
    return rec.where(cond)
