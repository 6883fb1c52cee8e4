"""Models (L1-L8, A4): rating regression and cuisine classification with forests grown
by (tree, node) (``operators.regression``, ``operators.forest``).

Categorical features are encoded with the code tables of
``platewise.operators.features`` (joins, not a driver-side dictionary), then
assembled into plain numeric vectors, as the reference treats codes as
numbers.  Scoring is ``transform`` over a request table of any size.

Forest outputs cannot equal the reference's bit for bit (other split search
and random streams); only invariants are checked.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.functions.expressions import clamp, to_number, yes_no_flag
from platewise.operators import forest as forests
from platewise.operators import nested, regression
from platewise.operators.features import (
    code_digits,
    digit_columns,
    encode,
    label_codes,
    split_plain,
    split_stratified,
    top_classes,
    with_digits,
)
from platewise.operators.metrics import class_metrics, per_class_metrics, regression_metrics
from platewise.operators.search import adaptive_search
from platewise.operators.similarity import fit_recommender
from platewise.schema import UNKNOWN
from platewise.session import forget

SEED = 42
RATING_CATEGORICAL = ["city", "cuisines", "rest_type"]
RATING_FEATURES = [
    "online_order", "book_table", "votes", "cost", "city_code", "cuisines_code", "rest_type_code",
]
CUISINE_FEATURES = [
    "city_code", "has_table_booking", "has_online_delivery", "price_range", "votes",
]


# Every task of a pass makes and sends the sums of all its nodes, so a fit reads its
# rows in so many tasks for each core, whatever number of partitions they come in.
TASKS_PER_CORE = 2
# Fits side by side: tasks of at least so many rows.
ROWS_PER_TASK = 50_000
# Spark ML's limit; the reference grows classification trees without one.
MAX_DEPTH = 30


def _small(df: DataFrame) -> DataFrame:
    """A result of a few rows (per split or class), computed now, so that it
    no longer depends on the persisted training rows."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A saved metrics table, if the model was saved with one."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _training_rows(df: DataFrame) -> DataFrame:
    """Training input is read many times (once per tree level): keep it.
    Lost blocks are recomputed from lineage, so executor loss is safe."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _in_few_tasks(rows: DataFrame) -> DataFrame:
    """The rows in ``TASKS_PER_CORE`` partitions for each core at most (as they
    are if there are no more: ``coalesce`` would deal them anew, and bootstraps with them)."""
    most = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(most) if rows.rdd.getNumPartitions() > most else rows


def _with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Absent request columns take the given default."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


# ---- rating regression --------------------------------------------------------


def rating_features(venues: DataFrame) -> DataFrame:
    """Rating task rows (B3, B6, B7): rating known, Yes/No flags as 1/0,
    numbers parsed, categories filled 'Unknown', rows with a missing number
    dropped."""
    rows = venues.where(F.col("rating").isNotNull()).select(
        "venue_id",
        F.col("rating").cast("double").alias("label"),
        yes_no_flag("has_online_delivery").alias("online_order"),
        yes_no_flag("has_table_booking").alias("book_table"),
        to_number("votes").alias("votes"),
        to_number("avg_cost").alias("cost"),
        *[F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c) for c in RATING_CATEGORICAL],
    )
    return rows.na.drop(subset=["votes", "cost"])


@dataclass
class RatingModel:
    codes: DataFrame
    pipeline: PipelineModel
    metrics: DataFrame | None = None
    digits: dict = field(default_factory=dict)

    def __post_init__(self):
        self.digits = self.digits or code_digits(self.codes, RATING_CATEGORICAL)

    @property
    def forest(self):
        return self.pipeline.stages[-1]

    def importances(self) -> DataFrame:
        """Feature importances (sum 1), largest first; those of a code's
        digits are added up."""
        names = digit_columns(RATING_FEATURES, self.digits)
        return feature_importances(self.pipeline, names, RATING_FEATURES)

    def save(self, path: str) -> None:
        """A4: code table, forest and metrics as parquet."""
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        self.forest.forest.save(f"{path}/forest")
        if self.metrics is not None:
            self.metrics.write.mode("overwrite").parquet(f"{path}/metrics")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RatingModel":
        codes = spark.read.parquet(f"{path}/codes")
        digits = code_digits(codes, RATING_CATEGORICAL)
        forest = regression.NumberForestModel(regression.Forest.load(spark, f"{path}/forest"))
        pipeline = PipelineModel([_rating_assembler(digits), forest])
        return cls(codes, pipeline, _optional(spark, f"{path}/metrics"), digits)


def _rating_assembler(digits: dict) -> VectorAssembler:
    return VectorAssembler(inputCols=digit_columns(RATING_FEATURES, digits), outputCol="features")


def _rating_forest(num_trees: int, max_depth: int, seed: int) -> regression.NumberForest:
    """As the reference's forest, one that considers every feature at each split."""
    return regression.NumberForest(num_trees, max_depth, seed)


def _rating_pipeline(
    num_trees: int, max_depth: int, seed: int, digits: dict | None = None
) -> Pipeline:
    """Assembler and forest, for rows of plain columns (codes without
    ``digits`` are one feature)."""
    return Pipeline(
        stages=[_rating_assembler(digits or {}), _rating_forest(num_trees, max_depth, seed)]
    )


@dataclass
class RatingRows:
    """What every fit of the rating model reads: one kept table of vectors."""

    codes: DataFrame
    digits: dict
    rows: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.rows.where(F.col("split") == "train")

    def train_in_few_tasks(self) -> DataFrame:
        """The training part for fits that run side by side."""
        return self.train.coalesce(max(1, -(-self.rows.count() // ROWS_PER_TASK)))

    def fit(
        self, num_trees: int, max_depth: int, seed: int, grown: regression.Growth | None = None
    ) -> "RatingModel":
        """L1, with train and test metrics (M1) of the fitted model; its trees are the first ones of a
        larger forest's growth, if there is one."""
        if grown is not None:
            forest = regression.NumberForestModel(grown.smaller(num_trees, max_depth).forest())
        else:
            forest = _rating_forest(num_trees, max_depth, seed).fit(_in_few_tasks(self.train))
        scored = forest.transform(self.rows).select("split", "label", "prediction")
        metrics = _small(regression_metrics(scored, group="split"))
        pipeline = PipelineModel([_rating_assembler(self.digits), forest])
        return RatingModel(self.codes, pipeline, metrics, self.digits)

    def release(self) -> None:
        self.rows.unpersist()


def prepare_rating(venues: DataFrame) -> RatingRows:
    """Rating rows as vectors, with the plain split, and the code table (fit
    on all rows, as the reference fits its encoders before splitting)."""
    rows = rating_features(venues)
    codes = label_codes(rows, RATING_CATEGORICAL)
    digits = code_digits(codes, RATING_CATEGORICAL)
    forget(codes.sparkSession)  # what the codes were made from
    rows = with_digits(encode(rows, codes, RATING_CATEGORICAL), digits)
    vectors = _rating_assembler(digits).transform(split_plain(rows, "venue_id"))
    return RatingRows(codes, digits, _training_rows(vectors.select("split", "label", "features")))


def train_rating_model(
    venues: DataFrame, num_trees: int = 100, max_depth: int = 10, seed: int = SEED
) -> RatingModel:
    """L1: random forest on the training split; train and test metrics (M1)
    from the fitted model's predictions."""
    kept = prepare_rating(venues)
    model = kept.fit(num_trees, max_depth, seed)
    kept.release()
    return model


def predict_rating(model: RatingModel, requests: DataFrame) -> DataFrame:
    """L2 (+B10): predicted rating per request, clamped to 0..5, next to the
    request's own fields.  Request columns: online_order, book_table, votes,
    location, rest_type, cuisines, cost; absent ones count as 0 / unknown."""
    req = _with_defaults(
        requests,
        {"online_order": 0, "book_table": 0, "votes": 0, "cost": 0.0},
    )
    feats = req.withColumns(
        {
            "city": F.col("location") if "location" in req.columns else F.lit(None).cast("string"),
            "cuisines": F.col("cuisines") if "cuisines" in req.columns else F.lit(None).cast("string"),
            "rest_type": F.col("rest_type") if "rest_type" in req.columns else F.lit(None).cast("string"),
        }
    )
    feats = feats.withColumns(
        {
            "online_order": F.col("online_order").cast("int"),
            "book_table": F.col("book_table").cast("int"),
            "votes": F.col("votes").cast("double"),
            "cost": F.col("cost").cast("double"),
        }
    )
    encoded = encode(feats, model.codes, RATING_CATEGORICAL)
    scored = model.pipeline.transform(with_digits(encoded, model.digits))
    keep = [c for c in requests.columns]
    return scored.select(*keep, clamp(F.col("prediction"), 0.0, 5.0).alias("predicted_rating"))


def score_distinct(model: RatingModel, requests: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Score each distinct request once and join the result back to
    every copy (null-safe on all keys).  Re-aims the reference's per-input
    result cache: repeated inputs cost one prediction."""
    keys = keys or [c for c in requests.columns if c != "request_id"]
    distinct = requests.select(*keys).dropDuplicates(keys)
    scored = predict_rating(model, distinct).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "predicted_rating"
    )
    cond = None
    for k in keys:
        c = requests[k].eqNullSafe(scored[f"_k_{k}"])
        cond = c if cond is None else cond & c
    return requests.join(scored, cond).select(*requests.columns, "predicted_rating")


def feature_importances(
    pipeline: PipelineModel, columns: list[str], names: list[str]
) -> DataFrame:
    """(feature, importance, rank) from the fitted forest; the
    importances are the model's own small vector, one value per column.  The
    columns of one feature (itself or its digits) are added up."""
    spark = SparkSession.getActiveSession()
    values = dict.fromkeys(names, 0.0)
    for column, value in zip(columns, pipeline.stages[-1].featureImportances.toArray().tolist()):
        values[column if column in values else column.rsplit("_", 1)[0]] += value
    df = spark.createDataFrame(list(values.items()), "feature string, importance double")
    # at most one row per feature: a global window over a handful of rows
    rank = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    return df.withColumn("rank", rank)


def tune_rating(
    venues: DataFrame,
    n_trials: int = 20,
    trees: tuple[int, int] = (50, 200),
    depth: tuple[int, int] = (5, 20),
    seed: int = SEED,
    parallelism: int = 8,
    shared: bool = True,
) -> tuple[DataFrame, RatingModel]:
    """Adaptive search over trees and depth (``operators.search``).
    ``n_trials`` different tries (as many as there are values, if those are
    fewer) are scored by R² on the test split (K3); returns one row per try, the
    best first, and the model trained with the best values.

    ``shared``: the tries read their scores off one forest of the most trees and
    the greatest depth (``operators.nested``).  Otherwise every try is a fit of its own, ``parallelism``
    of them side by side, and a free worker takes the next proposal."""
    kept = prepare_rating(venues)
    test = kept.rows.where(F.col("split") == "test")
    evaluator = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="r2")
    train = kept.train_in_few_tasks()
    known, grown = {}, None
    if shared:
        grown = nested.grow(_rating_forest, train, trees[1], depth[1], seed, parallelism)
        known = nested.r2_scores(grown, test, depth[1], depth[0])

    def score(num_trees: int, max_depth: int) -> float:
        if shared:
            return known.get((num_trees, max_depth), 0.0)  # 0 without test rows
        forest = _rating_forest(num_trees, max_depth, seed).fit(train)
        return float(evaluator.evaluate(forest.transform(test)))

    tries = adaptive_search(
        score, {"num_trees": trees, "max_depth": depth}, n_trials, seed, 1 if shared else parallelism
    )
    results = venues.sparkSession.createDataFrame(
        [(v["num_trees"], v["max_depth"], r2) for v, r2 in tries],
        "num_trees int, max_depth int, r2 double",
    )
    # ties: the smaller forest
    best, _ = max(tries, key=lambda t: (t[1], -t[0]["num_trees"], -t[0]["max_depth"]))
    model = kept.fit(best["num_trees"], best["max_depth"], seed, grown)
    kept.release()
    return results.orderBy(F.desc("r2"), "num_trees", "max_depth"), model


# ---- cuisine classification -----------------------------------------------------


def cuisine_features(venues: DataFrame, k: int = 10) -> DataFrame:
    """Classification rows: top-k main cuisines; city filled 'Unknown',
    flags 1/0, price range and votes parsed with missing -> 0."""
    rows = top_classes(venues, k)
    return rows.select(
        "venue_id",
        F.col("main_cuisine").alias("cuisine"),
        F.coalesce(F.col("city"), F.lit(UNKNOWN)).alias("city"),
        yes_no_flag("has_table_booking").alias("has_table_booking"),
        yes_no_flag("has_online_delivery").alias("has_online_delivery"),
        to_number("price_range", 0.0).alias("price_range"),
        to_number("votes", 0.0).alias("votes"),
    )


@dataclass
class CuisineModel:
    city_codes: DataFrame
    class_codes: DataFrame
    forest: forests.Forest
    metrics: DataFrame | None = None
    per_class: DataFrame | None = None
    digits: dict = field(default_factory=dict)

    def __post_init__(self):
        self.digits = self.digits or code_digits(self.city_codes, ["city"])

    def save(self, path: str) -> None:
        self.city_codes.write.mode("overwrite").parquet(f"{path}/city_codes")
        self.class_codes.write.mode("overwrite").parquet(f"{path}/class_codes")
        self.forest.save(f"{path}/forest")
        for name in ("metrics", "per_class"):
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CuisineModel":
        return cls(
            spark.read.parquet(f"{path}/city_codes"),
            spark.read.parquet(f"{path}/class_codes"),
            forests.Forest.load(spark, f"{path}/forest"),
            _optional(spark, f"{path}/metrics"),
            _optional(spark, f"{path}/per_class"),
        )


def _cuisine_assembler(digits: dict) -> VectorAssembler:
    return VectorAssembler(inputCols=digit_columns(CUISINE_FEATURES, digits), outputCol="features")


def train_cuisine_model(
    venues: DataFrame, num_trees: int = 100, max_depth: int = MAX_DEPTH, seed: int = SEED, k: int = 10
) -> CuisineModel:
    """L3: random forest over the top-k classes, stratified 80/20 split;
    train/test metrics (M3) and per-class test metrics (M4).  Trees grow to
    Spark ML's depth limit by default, by (tree, node) (``operators.forest``)."""
    rows = cuisine_features(venues, k)
    city_codes = label_codes(rows, ["city"])
    class_codes = label_codes(rows, ["cuisine"])
    rows = encode(rows, city_codes, ["city"])
    rows = encode(rows, class_codes, ["cuisine"]).withColumn("label", F.col("cuisine_code").cast("double"))
    digits = code_digits(city_codes, ["city"])
    split = split_stratified(with_digits(rows, digits), "venue_id", "cuisine")
    vectors = _cuisine_assembler(digits).transform(split)
    rows = _training_rows(vectors.select("split", "cuisine", "label", "features"))
    forest = forests.fit(
        rows.where(F.col("split") == "train"), len(digit_columns(CUISINE_FEATURES, digits)),
        class_codes.count(), num_trees, max_depth, seed,
    )
    labels = class_codes.select(F.col("code").cast("double").alias("prediction"),
                                F.col("value").alias("predicted"))
    scored = forest.transform(rows).join(F.broadcast(labels), "prediction")
    pairs = scored.select("split", F.col("cuisine").alias("label"), F.col("predicted").alias("prediction"))
    pairs = _training_rows(pairs)
    model = CuisineModel(
        city_codes,
        class_codes,
        forest,
        _small(class_metrics(pairs, group="split")),
        _small(per_class_metrics(pairs.where(F.col("split") == "test"))),
        digits,
    )
    pairs.unpersist()
    rows.unpersist()
    return model


def predict_cuisine(model: CuisineModel, requests: DataFrame, top: int = 3) -> DataFrame:
    """L4: per request the ``top`` classes by probability (confidence in
    %), rank 1 being the predicted cuisine.  Request columns: request_id,
    city, has_table_booking, has_online_delivery, price_range, votes."""
    req = requests.withColumns(
        {
            "has_table_booking": F.col("has_table_booking").cast("double"),
            "has_online_delivery": F.col("has_online_delivery").cast("double"),
            "price_range": F.col("price_range").cast("double"),
            "votes": F.col("votes").cast("double"),
        }
    )
    coded = with_digits(encode(req, model.city_codes, ["city"]), model.digits)
    scored = model.forest.transform(_cuisine_assembler(model.digits).transform(coded))
    probs = scored.select("request_id", F.posexplode("probability").alias("code", "p"))
    labels = model.class_codes.select("code", F.col("value").alias("cuisine"))
    # one row per class and request: the window holds at most the class count
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("p"), "code"))
    return (
        probs.join(F.broadcast(labels), "code")
        .withColumn("rank", rank)
        .where(F.col("rank") <= top)
        .select("request_id", "rank", "cuisine", (F.col("p") * 100).alias("confidence"))
    )


def rating_insights(model: RatingModel) -> DataFrame:
    """M2: metrics of both splits (accuracy is R² in %) and feature importances
    of a trained rating model, as (task, split, metric, value) rows."""
    metrics = model.metrics.select(
        F.lit("rating").alias("task"),
        "split",
        F.explode(
            F.create_map(
                F.lit("mse"), F.col("mse"), F.lit("rmse"), F.col("rmse"),
                F.lit("mae"), F.col("mae"), F.lit("r2"), F.col("r2"),
                F.lit("accuracy_pct"), F.col("r2") * 100,
            )
        ).alias("metric", "value"),
    )
    importances = model.importances().select(
        F.lit("rating").alias("task"), F.lit("model").alias("split"),
        F.concat(F.lit("importance_"), F.col("feature")).alias("metric"), F.col("importance").alias("value"),
    )
    return metrics.unionByName(importances)


# ---- all three tasks ------------------------------------------------------------


def train_all(
    venues: DataFrame,
    path: str | None = None,
    n_trials: int = 20,
    cuisine_trees: int = 100,
    seed: int = SEED,
) -> DataFrame:
    """L8 (+M2): tune and train the rating model, train the cuisine model and
    fit the recommender; with ``path`` all three are saved below it.  Returns
    (task, split, metric, value) rows; those of the recommender count venues,
    cities, cuisine items and the terms of its vocabulary."""
    with ThreadPoolExecutor(2) as pool:  # the two trainings side by side
        forest = pool.submit(train_cuisine_model, venues, cuisine_trees, seed=seed)
        tried, rating = tune_rating(venues, n_trials, seed=seed)
        cuisine = forest.result()
    recommender = fit_recommender(venues)
    if path is not None:
        rating.save(f"{path}/rating")
        cuisine.save(f"{path}/cuisine")
        recommender.save(f"{path}/recommender")
    best = tried.limit(1).select(
        F.lit("rating").alias("task"), F.lit("tuning").alias("split"),
        F.explode(
            F.create_map(
                F.lit("num_trees"), F.col("num_trees").cast("double"),
                F.lit("max_depth"), F.col("max_depth").cast("double"), F.lit("r2"), F.col("r2"),
            )
        ).alias("metric", "value"),
    )
    metric_cols = [
        "accuracy", "precision_macro", "precision_weighted", "recall_macro", "recall_weighted",
        "f1_macro", "f1_weighted",
    ]
    cm = cuisine.metrics.select(
        F.lit("cuisine").alias("task"),
        "split",
        F.explode(F.create_map(*[x for c in metric_cols for x in (F.lit(c), F.col(c))])).alias(
            "metric", "value"
        ),
    )
    items = venues.select(
        F.explode(F.split(F.coalesce(F.col("cuisines"), F.lit(UNKNOWN)), ",")).alias("c")
    ).select(F.trim("c").alias("c"))
    rec = venues.agg(
        F.count(F.lit(1)).cast("double").alias("venues"),
        F.count_distinct(F.coalesce(F.col("city"), F.lit(UNKNOWN))).cast("double").alias("cities"),
    ).select(
        F.lit("recommendation").alias("task"), F.lit("all").alias("split"),
        F.explode(F.create_map(F.lit("venues"), F.col("venues"), F.lit("cities"), F.col("cities"),
                               F.lit("cuisines"),
                               items.select(F.count_distinct("c")).scalar().cast("double"),
                               F.lit("terms"),
                               recommender.idf.agg(F.count(F.lit(1))).scalar().cast("double")))
        .alias("metric", "value"),
    )
    return best.unionByName(rating_insights(rating)).unionByName(cm).unionByName(rec)

