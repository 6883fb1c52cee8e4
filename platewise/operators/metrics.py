"""Evaluation metrics as aggregates over (label, prediction) rows (M1-M7).

They are exact, so they are checked against SQL even though the models that
produce predictions are not.  Division by zero gives 0, as in the
reference's metric calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEAK_F1 = 0.7
LOW_SUPPORT = 50
LOW_PRECISION = 0.6
LOW_RECALL = 0.6
IMBALANCE_RATIO = 5.0


def _group(df: DataFrame, group: str | None) -> tuple[DataFrame, str]:
    if group is None:
        return df.withColumn("_all", F.lit("all")), "_all"
    return df, group


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", group: str | None = None
) -> DataFrame:
    """M1: MSE, RMSE, MAE and R² per group.

    R² = 1 − SSE/SST with the group's own mean label; a group whose labels
    are all equal scores 1 when predicted exactly, else 0.  One pass: SST is
    the population variance of the labels times their number.
    """
    df, g = _group(df, group)
    e = F.col(label) - F.col(prediction)
    sums = df.groupBy(g).agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"),
        # equal labels give no variance, whatever the rounding
        F.when(F.min(label) == F.max(label), F.lit(0.0))
        .otherwise(F.var_pop(label) * F.count(label))
        .alias("_sst"),
        F.count(F.lit(1)).alias("n"),
    )
    r2 = (
        F.when(F.col("_sst") != 0, 1 - F.col("_sse") / F.col("_sst"))
        .when(F.col("_sse") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    out = sums.select(g, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))
    return out.drop("_all") if group is None else out


def per_class_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", group: str | None = None
) -> DataFrame:
    """M4: precision, recall, F1 and support per class (classes seen as a
    label or as a prediction).  One aggregation: every row counts once for
    its true class and once for its predicted class."""
    df, g = _group(df, group)
    hit = (F.col(label) == F.col(prediction)).cast("long")
    events = df.select(
        g,
        F.explode(
            F.array(
                F.struct(F.col(label).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                         hit.alias("tp")),
                F.struct(F.col(prediction).alias("class"), F.lit(0).alias("t"),
                         F.lit(1).alias("p"), F.lit(0).cast("long").alias("tp")),
            )
        ).alias("e"),
    ).select(g, "e.*")
    counts = events.groupBy(g, "class").agg(
        F.sum("t").cast("long").alias("support"),
        F.sum("p").cast("long").alias("predicted"),
        F.sum("tp").cast("long").alias("tp"),
    )
    precision = _safe_div(F.col("tp"), F.col("predicted"))
    recall = _safe_div(F.col("tp"), F.col("support"))
    out = counts.select(g, "class", precision.alias("precision"), recall.alias("recall"),
                        "support", "tp").withColumn(
        "f1",
        _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )
    out = out.select(g, "class", "precision", "recall", "f1", "support", "tp")
    return out.drop("_all") if group is None else out


def class_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", group: str | None = None
) -> DataFrame:
    """M3: accuracy and macro / weighted precision, recall and F1."""
    per_class = per_class_metrics(df, label, prediction, group)
    per_class, g = _group(per_class, group)
    weighted = lambda c: _safe_div(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    out = per_class.groupBy(g).agg(
        _safe_div(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        weighted("precision").alias("precision_weighted"),
        F.avg("recall").alias("recall_macro"),
        weighted("recall").alias("recall_weighted"),
        F.avg("f1").alias("f1_macro"),
        weighted("f1").alias("f1_weighted"),
    )
    return out.drop("_all") if group is None else out


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M5: counts for every (actual, predicted) pair of classes, zero cells
    included, long form.  The class list is a bounded array (the classes of
    the task, e.g. the top 10); the cells are counted by one aggregation."""
    classes = (
        df.select(F.explode(F.array(F.col(label), F.col(prediction))).alias("c"))
        .where(F.col("c").isNotNull())
        .agg(F.array_sort(F.collect_set("c")))
        .scalar()
    )
    spark = df.sparkSession
    cells = (
        spark.range(1)
        .select(F.explode(classes).alias("actual"))
        .select("actual", F.explode(classes).alias("predicted"))
    )
    counts = df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return cells.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")
    )


def weak_classes(per_class: DataFrame) -> DataFrame:
    """M6: classes with F1 below 0.7, weakest first, with the reasons."""
    reasons = F.concat_ws(
        ", ",
        F.when(F.col("support") < LOW_SUPPORT, F.lit("low sample size")),
        F.when(F.col("precision") < LOW_PRECISION, F.lit("high false positive rate")),
        F.when(F.col("recall") < LOW_RECALL, F.lit("many samples misclassified")),
    )
    return (
        per_class.where(F.col("f1") < WEAK_F1)
        .select("class", "f1", "support", "precision", "recall", reasons.alias("reasons"))
        .orderBy("f1", "class")
    )


def class_imbalance(per_class: DataFrame) -> DataFrame:
    """M7: largest and smallest class support, their ratio (infinite when
    the smallest is 0), the imbalance flag (> 5) and the overall bias flag
    (imbalance or any class with F1 below 0.7)."""
    row = per_class.agg(
        F.max("support").alias("max_support"),
        F.min("support").alias("min_support"),
        F.max((F.col("f1") < WEAK_F1).cast("int")).alias("_weak"),
    )
    ratio = F.when(
        F.col("min_support") > 0, F.col("max_support") / F.col("min_support")
    ).otherwise(F.lit(float("inf")))
    return row.select(
        "max_support",
        "min_support",
        ratio.alias("imbalance_ratio"),
        (ratio > IMBALANCE_RATIO).alias("imbalanced"),
        ((F.col("_weak") == 1) | (ratio > IMBALANCE_RATIO)).alias("biases_identified"),
    )
