"""Reading and writing venue tables and fitted state (A1-A4).

``read_venues`` reads the restaurant CSV with a header, or parquet, into the
canonical schema of ``platewise.schema``.  Text is read as strings and
converted with ``try_cast``, so a bad number becomes null instead of failing
the job (ANSI mode is on in Spark 4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from platewise.operators.cleaning import rename_columns
from platewise.schema import MISSING_MARKERS, SOURCE_COLUMNS, VENUE_SCHEMA


def read_venues(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool | None = None
) -> DataFrame:
    """A1/A2: venues from a CSV with header (or parquet).

    Source columns are renamed to canonical names; absent canonical
    columns are added as nulls; the pandas default missing markers ('NA',
    'N/A', 'null', 'NaN', 'None', ...) become null.  Quotes inside quoted
    fields are doubled.  A large CSV is split among tasks, unless ``multi_line``:
    then a quoted field may hold line breaks, and each file is one task.  By
    default that is so only if some line has an odd number of quotes (a pass over
    the lines that stops at the first of them).  Without a
    'Restaurant ID' column, ``venue_id`` (partition index and row number) holds
    for one run only: save the table if ids have to stay.
    """
    if fmt == "csv":
        if multi_line is None:
            quotes = F.length(F.regexp_replace("value", '[^"]', ""))
            multi_line = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
        raw = spark.read.csv(
            path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line
        )
    else:
        raw = spark.read.format(fmt).load(path)
    df = rename_columns(raw, SOURCE_COLUMNS)
    markers = F.array(*[F.lit(m) for m in MISSING_MARKERS])
    cols = []
    for field in VENUE_SCHEMA.fields:
        name = field.name
        if name not in df.columns:
            if name == "venue_id":
                cols.append(F.monotonically_increasing_id().alias(name))
            else:
                cols.append(F.lit(None).cast(field.dataType).alias(name))
            continue
        value = F.col(name)
        if fmt == "csv":
            text = F.trim(value.cast("string"))
            value = F.when(F.array_contains(markers, text), F.lit(None)).otherwise(value)
        typed = value.try_cast(field.dataType)
        if isinstance(field.dataType, IntegralType):
            # whole numbers are also written like 2.0
            number = value.try_cast("double")
            whole = F.when(number == F.floor(number), number).try_cast(field.dataType)
            typed = F.coalesce(typed, whole)
        cols.append(typed.alias(name))
    return df.select(*cols)


def save_table(df: DataFrame, path: str) -> None:
    """A3/A4: write a state table (weights, codes, metrics) as parquet."""
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_tfidf(idf: DataFrame, weights: DataFrame, path: str) -> None:
    """A3: the recommender state: document frequencies and row weights."""
    save_table(idf, f"{path}/idf")
    save_table(weights, f"{path}/weights")


def load_tfidf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return load_table(spark, f"{path}/idf"), load_table(spark, f"{path}/weights")
