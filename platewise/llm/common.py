"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.session import checkpoint_dir

# Java character class of the six ASCII white-space characters.
SPACES = r"[ \t\n\x0B\f\r]"

# A table is broadcast only if its measured size is below this.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame, files_per_core: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.  With
    ``files_per_core``, for narrow tables that loops write again and again, in that many files
    for each core at most: every file costs calls of the file system, of whatever size it is."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    if files_per_core:
        df = df.coalesce(files_per_core * spark.sparkContext.defaultParallelism)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is.  ``lower`` does exactly
    that on a text that is ASCII throughout, and is much cheaper."""
    return F.when(
        text.rlike(r"[^\x00-\x7F]"),
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase),
    ).otherwise(F.lower(text))


def space_words(text: Column) -> Column:
    """Words between ASCII white space; null gives no words."""
    return F.coalesce(
        F.array_remove(F.split(text, SPACES + "+"), ""), F.array().cast("array<string>")
    )


def without(
    docs: DataFrame,
    gone: DataFrame,
    id_col: str,
    mark_col: str | None = None,
    mark: Column | None = None,
) -> DataFrame:
    """The rows of ``docs`` that are not in the table ``gone(id_col[, mark_col])``,
    null ids being equal; ``mark`` is computed from ``docs``.  ``gone`` is
    broadcast if its counted rows are few, so that texts are not shuffled."""
    gone = checkpointed(gone)
    other = gone.select(F.struct(*[F.col(c) for c in gone.columns]).alias("gone_key"))
    key = F.struct(F.col(f"`{id_col}`"), *([mark.alias(mark_col)] if mark is not None else []))
    if other.count() * 64 <= BROADCAST_BYTES:
        other = F.broadcast(other)
    rows = packed(docs, key.alias("doc_key"))
    return rows.join(other, F.col("doc_key") == F.col("gone_key"), "left_anti").select("row.*")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``docs`` in the struct ``row``, so that no name clashes
    with the columns of ``more``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)
