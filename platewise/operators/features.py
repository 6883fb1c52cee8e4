"""Feature preparation and splits (K1-K5, D3).

Label codes are a DataFrame ``(feature, value, code)`` rather than a
driver-side dictionary, so encoding is a join that scales with the data and
the code tables can be saved like any table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.expressions import main_cuisine
from platewise.operators.common import sorted_codes
from platewise.schema import UNKNOWN

SEED = 42
# Plain split: the first eight hex digits of the row hash below this value
# form the test part (a fifth of 2^32).
PLAIN_TEST_BELOW = "33333333"


def label_codes(df: DataFrame, columns: Sequence[str], missing: str = UNKNOWN) -> DataFrame:
    """K1: codes 0.. of each column's distinct values in sorted order, with
    missing values read as ``missing``.  Long form ``(feature, value, code)``.
    All columns share one distributed sorted index over (feature, value);
    a feature's codes are its positions from its first one."""
    filled = [
        F.struct(
            F.lit(c).alias("feature"),
            F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value"),
        )
        for c in columns
    ]
    pairs = df.select(F.explode(F.array(*filled)).alias("pair"))
    codes = sorted_codes(pairs, "pair", "position").select("pair.*", "position")
    first = codes.groupBy("feature").agg(F.min("position").alias("first"))
    # one row per feature
    return codes.join(F.broadcast(first), "feature").select(
        "feature", "value", (F.col("position") - F.col("first")).alias("code")
    )


def encode(
    df: DataFrame,
    codes: DataFrame,
    columns: Sequence[str],
    missing: str = UNKNOWN,
    suffix: str = "_code",
) -> DataFrame:
    """K2/D3: add ``<column>_code`` for each column.  Missing values read as
    ``missing``; values not seen at fit time get the code of ``missing`` when
    it was fitted, else the next free code (the number of labels).

    One left join per column against that column's code table; Spark
    broadcasts a code table when its measured size is small and joins by
    hash otherwise.
    """
    out = df
    for c in columns:
        table = codes.where(F.col("feature") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}")
        )
        # code of `missing` when fitted, else the number of labels (one row)
        fallback = (
            codes.where(F.col("feature") == c)
            .agg(
                F.coalesce(
                    F.max(F.when(F.col("value") == missing, F.col("code"))),
                    F.count(F.lit(1)),
                )
            )
            .scalar()
        )
        key = F.coalesce(F.col(c).cast("string"), F.lit(missing))
        out = (
            out.join(table, key == F.col(f"_v_{c}"), "left")
            .withColumn(c + suffix, F.coalesce(F.col(f"_c_{c}"), fallback))
            .drop(f"_v_{c}", f"_c_{c}")
        )
    return out


# Values of one digit: as many as a forest's candidate splits tell apart.
DIGIT_BASE = 256


def code_digits(codes: DataFrame, columns: Sequence[str], base: int = DIGIT_BASE) -> dict[str, int]:
    """Digits to the given base that the codes of each column need (one row per column; the
    next free code, for unseen values, included)."""
    sizes = codes.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    known = {r.feature: r.n for r in sizes.collect()}
    out = {}
    for c in columns:
        out[c] = 1
        while base ** out[c] <= known.get(c, 0):
            out[c] += 1
    return out


def with_digits(
    df: DataFrame, digits: dict[str, int], suffix: str = "_code", base: int = DIGIT_BASE
) -> DataFrame:
    """K4: every code as digits ``<column>_code_0`` (the highest), ``_1``...
    A threshold over the codes is a few thresholds over digits, so a tree can tell any
    two codes apart with ``base`` candidate splits a feature."""
    columns = {}
    for c, n in digits.items():
        for i in range(n):
            digit = F.floor(F.col(c + suffix) / base ** (n - 1 - i)) % base
            columns[f"{c}{suffix}_{i}"] = digit.cast("double")
    return df.withColumns(columns)


def digit_columns(names: Sequence[str], digits: dict[str, int], suffix: str = "_code") -> list[str]:
    """Feature names with every code replaced by its digits."""
    out = []
    for name in names:
        column = name.removesuffix(suffix)
        if name.endswith(suffix) and column in digits:
            out += [f"{name}_{i}" for i in range(digits[column])]
        else:
            out.append(name)
    return out


def row_hash(id_col: str, seed: int = SEED) -> Column:
    """Repeatable pseudo-random order of rows: md5 of (id, seed), hex."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def split_plain(df: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """K3 (plain): ``split`` = 'test' for about 20 % of rows, by row hash.
    A pure projection, independent of partitioning."""
    is_test = F.substring(row_hash(id_col, seed), 1, 8) < F.lit(PLAIN_TEST_BELOW)
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def split_stratified(
    df: DataFrame, id_col: str, label_col: str, test_fraction: float = 0.2, seed: int = SEED
) -> DataFrame:
    """K3 (stratified): in each class exactly ``round(test_fraction × n)``
    rows are 'test': those first in (row hash, id) order.

    Exact without sorting a whole class in one task: rows are counted per
    (class, first 4 hex digits of the hash), i.e. at most 65,536 buckets per
    class; running sums over that small histogram give the rows of a class
    before each bucket, and rows are ranked inside their bucket only.  Rows
    without a label form a class of their own.
    """
    h = row_hash(id_col, seed)
    keyed = df.withColumns({"_h": h, "_b": F.substring(h, 1, 4)})
    hist = keyed.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_c"))
    running = Window.partitionBy(label_col).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy(label_col)
    marks = hist.select(
        F.col(label_col).alias("_label"),
        F.col("_b").alias("_bucket"),
        (F.sum("_c").over(running) - F.col("_c")).alias("_before"),
        F.round(F.sum("_c").over(whole) * test_fraction).cast("bigint").alias("_m"),
    )
    pos = F.row_number().over(Window.partitionBy(label_col, "_b").orderBy("_h", id_col))
    ranked = keyed.withColumn("_pos", pos)
    same = F.col(label_col).eqNullSafe(F.col("_label")) & (F.col("_b") == F.col("_bucket"))
    test = F.col("_before") + F.col("_pos") <= F.col("_m")
    rows = ranked.join(marks, same).withColumn("split", F.when(test, "test").otherwise("train"))
    return rows.drop("_h", "_b", "_pos", "_label", "_bucket", "_before", "_m")


def top_classes(venues: DataFrame, k: int = 10) -> DataFrame:
    """K5 (+C8/D2): venues whose main cuisine is among the ``k`` most
    frequent (count desc, name asc).  The class list is a top-k (bounded by
    ``k``) and is applied as a broadcast left-semi join."""
    labelled = venues.withColumn("main_cuisine", main_cuisine("cuisines"))
    top = (
        labelled.groupBy("main_cuisine")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "main_cuisine")
        .limit(k)
    )
    return labelled.join(F.broadcast(top.select("main_cuisine")), "main_cuisine", "left_semi")
