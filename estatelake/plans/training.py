"""Training, evaluating and storing price models with MLlib.

The learners are MLlib forests and boosted MLlib trees (``boosting.py``): the same roles, weighting, routing and
metrics as described for the engine, but not the numbers of other tree libraries. Which categories are
one-hot and which are encoded by their mean price is fixed by column. Means of training rows leave out
the row's own fold, so that a label never feeds its own feature.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GBTRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelake.functions.scalars import hash_bucket
from estatelake.functions.stats import group_stats, stacked
from estatelake.operators.features import missing_category_token, ml_dataset
from estatelake.operators.market import segment_sizes
from estatelake.plans.boosting import Boosted, BoostSettings, boost
from estatelake.schema import (
    CATEGORICAL_FEATURES,
    LEAKAGE_COLUMNS,
    NUMERIC_FEATURES,
    OFFERING_BY_MARKET,
    ONE_HOT_FEATURES,
    QUALIFIED_SEGMENTS,
    TARGET_MEAN_FEATURES,
)
from estatelake.session import stored, work_dir

SEED = 42
MIN_SEGMENT_ROWS = 500
MIN_CATEGORY_ROWS = 5
FOLDS = 5
#: rows of a small family are not spread over more tasks than this asks for: each of its many jobs would be mostly the start of tasks
ROWS_A_TASK = 25_000
MODEL_NAMES = ("extra_trees", "random_forest", "boosted")


@dataclass
class TreeSettings:
    """Sizes of the models; the defaults are for production, tests pass small ones.

    Fixed values: 200, 300 and 300 trees, leaves of 2 rows, 3,000 rounds of depth 10 at a rate of 0.04, a
    patience of 150 rounds, an L2 term of 7 on the leaves, 128 bins, 500 final rounds at least. Forests are not to be limited in depth: 30 is MLlib's limit.
    """

    market_trees: dict[str, int] = field(default_factory=lambda: {"sale": 200, "rent": 300})
    family_trees: int = 300
    tree_depth: int = 30
    min_leaf: int = 2
    boost_rounds: int = 3000
    boost_depth: int = 10
    boost_rate: float = 0.04
    boost_l2: float = 7.0
    patience: int = 150
    min_final_rounds: int = 500
    bins: int = 128


# --- rows ---------------------------------------------------------------------------------

def split_rows(df: DataFrame, key: str, train: int = 80, validation: int = 0) -> DataFrame:
    """Add ``split`` from a hash of the key, in percent: independent of order and partitions."""
    bucket = hash_bucket(F.col(key))
    label = F.when(bucket < train, "train")
    if validation:
        label = label.when(bucket < train + validation, "validation")
    return df.withColumn("split", label.otherwise("test"))


def stored_parts(rows: DataFrame, key: str, train: int = 80, validation: int = 0, count: int | None = None) -> DataFrame:
    """Split rows, written once: fitting an encoder reads them several times, and their features are costly to derive.

    Where the ``count`` of the rows is known, they are dealt into as many files as it asks for.
    """
    split = split_rows(rows, key, train, validation)
    return stored(split if count is None else split.repartition(-(-count // ROWS_A_TASK) or 1), "model-parts")


def fill_values(train: DataFrame, numeric: list[str], categorical: list[str], counts: DataFrame | None = None) -> DataFrame:
    """(column_name, number, text): exact median per numeric column, most frequent text per category.

    Columns are folded into (name, value) rows first; equal values combine on the map side. ``counts`` are the category counts, if at hand.
    """
    medians = group_stats(stacked(train, numeric, "column_name", "v", "double"), ["column_name"], "v", {"number": 0.5})
    counts = (category_counts(train, categorical) if counts is None else counts).where(F.col("value").isNotNull())
    # most rows first; equal counts take the smallest text
    modes = counts.groupBy("column_name").agg(
        F.min_by("value", F.struct(-F.col("rows"), F.col("value"))).alias("text")
    )
    return medians.select("column_name", "number", F.lit(None).cast("string").alias("text")).unionByName(
        modes.select("column_name", F.lit(None).cast("double").alias("number"), "text")
    )


def category_counts(train: DataFrame, categorical: list[str]) -> DataFrame:
    long = stacked(train, categorical, "column_name", "value", "string")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))


def frequent_values(train: DataFrame, categorical: list[str], min_rows: int = MIN_CATEGORY_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """The values of at least ``min_rows`` rows. ``counts`` are the category counts, if at hand."""
    counts = category_counts(train, categorical) if counts is None else counts.where(F.col("column_name").isin(categorical))
    return counts.where(F.col("value").isNotNull() & (F.col("rows") >= min_rows))


# --- encoding -----------------------------------------------------------------------------

@dataclass
class Encoder:
    """From feature columns to one ``features`` vector.

    Missing numbers become the median, missing categories the most frequent one. One-hot columns have a place for each
    frequent label; a target-mean column holds the mean label of its value, drawn towards the mean of all rows by
    ``smoothing`` rows. Rare and unseen categories are all zeros or the mean of all rows.
    Fill values, one-hot labels and fold totals are in the driver; the means of the columns
    with many values stay in a table below ``path``, one folder a column, and are joined: a small one is broadcast by
    its stored size, a large one is shuffled.
    """

    numbers: dict[str, float]
    modes: dict[str, str]
    labels: dict[str, list[str]]
    totals: list[tuple[float, float]]  # (sum, rows) of the labels of each fold
    target_means: list[str]
    smoothing: float
    key: str
    path: str

    def transform(self, df: DataFrame, training: Column | None = None) -> DataFrame:
        """``df`` with ``features``. Where ``training`` holds, means leave out the row's own fold."""
        fold = F.lit(None).cast("int") if training is None else F.when(training, fold_of(self.key))
        out = df.withColumn("_fold", fold)
        texts = {f"_c_{c}": F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c))) for c in (*self.labels, *self.target_means)}
        cells = {f"_n_{c}": F.coalesce(F.col(c).cast("double"), F.lit(self.numbers.get(c, 0.0))) for c in NUMERIC_FEATURES}
        out = out.withColumns({**texts, **cells})
        hot = {f"_x_{i}_{j}": F.coalesce((F.col(f"_c_{c}") == v).cast("double"), F.lit(0.0)) for i, (c, vs) in enumerate(self.labels.items()) for j, v in enumerate(vs)}
        sums, rows = sum(s for s, _ in self.totals), sum(n for _, n in self.totals)
        prior = F.lit(sums / rows if rows else 0.0)
        for f, (s, n) in enumerate(self.totals):
            prior = F.when(F.col("_fold") == f, (sums - s) / (rows - n) if rows > n else 0.0).otherwise(prior)
        means = {}
        spark = df.sparkSession
        for i, c in enumerate(self.target_means):
            table = spark.read.schema("value string, s double, n double, folds map<int,struct<s:double,n:double>>").parquet(f"{self.path}/column_name={c}")
            out = out.join(table.select(F.col("value").alias(f"_c_{c}"), F.struct("s", "n", "folds").alias(f"_t_{i}")), f"_c_{c}", "left")
            t = F.col(f"_t_{i}")
            own = t["folds"][F.col("_fold")]
            left = [t[k] - F.coalesce(own[k], F.lit(0.0)) for k in ("s", "n")]
            means[f"_m_{c}"] = F.coalesce(F.try_divide(left[0] + self.smoothing * F.col("_prior"), left[1] + self.smoothing), F.col("_prior"))
        out = out.withColumns({**hot, "_prior": prior}).withColumns(means)
        vector = VectorAssembler(inputCols=[*cells, *hot, *means], outputCol="features")
        return vector.transform(out).select(*df.columns, "features")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        if self.target_means:
            spark.read.parquet(self.path).write.mode("overwrite").partitionBy("column_name").parquet(f"{path}/means")
        plain = {**self.__dict__, "path": ""}
        spark.createDataFrame([(json.dumps(plain),)], "encoder string").coalesce(1).write.mode("overwrite").json(f"{path}/encoder")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Encoder:
        plain = json.loads(spark.read.schema("encoder string").json(f"{path}/encoder").first()[0])
        return Encoder(**{**plain, "totals": [tuple(t) for t in plain["totals"]], "path": f"{path}/means"})


def fold_of(key: str) -> Column:
    return F.pmod(hash_bucket(F.col(key)), F.lit(FOLDS)).cast("int")


def category_cells(train: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column_name, value, fold, s, n, labels): sum of the labels, rows and labels of every value and fold, nulls too, combined on the map side."""
    rows = train.select(fold_of(key).alias("fold"), F.col("label"), *columns)
    long = stacked(rows, columns, "column_name", "value", "string", keep=["fold", "label"])
    return long.groupBy("column_name", "value", "fold").agg(
        F.sum("label").alias("s"), F.count(F.lit(1)).cast("double").alias("n"), F.count("label").alias("labels"))


def target_means(cells: DataFrame, columns: list[str], min_rows: int, path: str) -> list[str]:
    """Store (value, sum, rows, the same by fold) of the labels of every frequent value, one folder a column;
    returns the columns that have any."""
    parts = cells.where(F.col("column_name").isin(columns) & F.col("value").isNotNull())
    whole = parts.groupBy("column_name", "value").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("s", "n")))).alias("folds"),
    ).where(F.col("n") >= min_rows)
    whole.write.mode("overwrite").partitionBy("column_name").parquet(path)
    spark = cells.sparkSession
    stored_means = spark.read.schema("value string, s double, n double, folds map<int,struct<s:double,n:double>>, column_name string").parquet(path)
    found = {r[0] for r in stored_means.select("column_name").distinct().collect()}
    return [c for c in columns if c in found]


def fit_encoder(train: DataFrame, key: str = "listing_id", min_rows: int = MIN_CATEGORY_ROWS,
                mean_columns: list[str] = TARGET_MEAN_FEATURES) -> Encoder:
    """The encoder of training rows with ``label`` and the model features.

    One pass counts every category by fold, and all that is asked of categories comes from that table.
    """
    spark = train.sparkSession
    cells = stored(category_cells(train, key, CATEGORICAL_FEATURES), "category-cells")
    counts = cells.groupBy("column_name", "value").agg(F.sum("n").cast("bigint").alias("rows"))
    fills = {r["column_name"]: r for r in fill_values(train, NUMERIC_FEATURES, CATEGORICAL_FEATURES, counts).collect()}
    frequent = frequent_values(train, ONE_HOT_FEATURES, min_rows, counts)
    folds = cells.where(F.col("column_name") == CATEGORICAL_FEATURES[0]).groupBy("fold").agg(F.sum("s").alias("s"), F.sum("labels").alias("n"))
    found = frequent.withColumn("kind", F.lit("label")).unionByName(folds.withColumn("kind", F.lit("fold")), allowMissingColumns=True).collect()
    hot = sorted((r for r in found if r["kind"] == "label"), key=lambda r: (-r["rows"], r["value"]))
    labels = {c: [r["value"] for r in hot if r["column_name"] == c] for c in ONE_HOT_FEATURES}
    by_fold = {r["fold"]: r for r in found if r["kind"] == "fold"}
    totals = [(float(by_fold[f]["s"] or 0.0), float(by_fold[f]["n"])) if f in by_fold else (0.0, 0.0) for f in range(FOLDS)]
    path = work_dir(spark, "target-means")
    used = target_means(cells, mean_columns, min_rows, path) if mean_columns else []
    number = lambda c: fills[c]["number"] if c in fills and fills[c]["number"] is not None else 0.0
    return Encoder({c: number(c) for c in NUMERIC_FEATURES}, {c: fills[c]["text"] for c in CATEGORICAL_FEATURES if c in fills and fills[c]["text"] is not None},
                   {c: v for c, v in labels.items() if v}, totals, used, float(min_rows), key, path)


def in_few_tasks(rows: DataFrame) -> DataFrame:
    """Stored rows in no more tasks than ``ROWS_A_TASK`` asks for: each task of a tree's level sends the counts of all its nodes, whatever its rows."""
    return rows.coalesce(-(-rows.count() // ROWS_A_TASK) or 1)  # counted in the files' footers


def encoded_parts(parts: DataFrame, key: str, purpose: str = "encoded") -> tuple[Encoder, DataFrame]:
    """The encoder of the training part and all parts encoded (split, label, features), stored once. It reads ``parts`` many times."""
    encoder = fit_encoder(parts.where(F.col("split") == "train"), key)
    return encoder, stored(encoder.transform(in_few_tasks(parts), F.col("split") == "train").select("split", "label", "features"), purpose)


def side_by_side(spark: SparkSession, fit: Callable, jobs: list, parallel: int = 4) -> list:
    """``fit`` of every job, several at a time, as small fits leave a cluster idle. The job properties of the session are copied
    by each call below: threads must not share them."""
    tasks = [inheritable_thread_target(spark)(partial(fit, job)) for job in jobs]
    with ThreadPool(min(parallel, len(jobs))) as pool:
        return pool.map(lambda task: task(), tasks, 1)


def learner(name: str, settings: TreeSettings, trees: int | None = None) -> RandomForestRegressor:
    """An unfitted forest on log prices whose output column is ``log_<name>``."""
    return RandomForestRegressor(
        featuresCol="features", labelCol="label", predictionCol=f"log_{name}", seed=SEED, maxBins=settings.bins,
        minInstancesPerNode=settings.min_leaf, numTrees=trees or settings.family_trees, maxDepth=settings.tree_depth,
        featureSubsetStrategy="sqrt", bootstrap=(name == "random_forest"),
    )


def fit_boosted(train: DataFrame, validation: DataFrame | None, settings: TreeSettings, path: str | None = None, **config) -> Boosted:
    """Boosted trees that stop ``settings.patience`` rounds after the best one on the validation rows; all rounds without such rows.

    ``config`` may name rounds, rate, depth and l2; ``path`` keeps the rounds, so that a run that died goes on.
    """
    sizes = {"rounds": settings.boost_rounds, "rate": settings.boost_rate, "depth": settings.boost_depth, "l2": settings.boost_l2, **config}
    return boost(train, validation, BoostSettings(**sizes, patience=settings.patience, bins=settings.bins, min_leaf=settings.min_leaf, seed=SEED), "log_boosted", path)


# --- metrics --------------------------------------------------------------------------------

def regression_metrics(df: DataFrame, actual_log: str, predicted_log: str, keys: list[str]) -> DataFrame:
    """MAE, RMSE, R² and median absolute error on the price scale, per key; predictions are cut at 0."""
    actual = F.expm1(F.col(actual_log))
    predicted = F.greatest(F.expm1(F.col(predicted_log)), F.lit(0.0))
    rows = df.select(*keys, actual.alias("_y"), (predicted - actual).alias("_e")).where(
        F.col("_y").isNotNull() & F.col("_e").isNotNull()
    )
    square = F.col("_e") * F.col("_e")
    plain = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs("_e")).alias("mae_egp"), F.sqrt(F.avg(square)).alias("rmse_egp"),
        (F.lit(1.0) - F.try_divide(F.avg(square), F.var_pop("_y"))).alias("r2"),
    )
    middle = group_stats(rows, keys, F.abs(F.col("_e")), {"median_absolute_error_egp": 0.5})
    return plain.join(middle, keys)


def long_predictions(scored: DataFrame, columns: dict[str, Column | str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, label, model, predicted) rows from several prediction columns."""
    cells = [F.struct(F.lit(n).alias("model"), (F.col(c) if isinstance(c, str) else c).alias("predicted"))
             for n, c in columns.items()]
    return scored.select(*keys, "label", F.inline(F.array(*cells)))


def ensemble_weights(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``ensemble_weight``: 1/max(RMSE, 1), scaled to a sum of 1 per key (a few models each)."""
    inverse = F.lit(1.0) / F.greatest(F.col("rmse_egp"), F.lit(1.0))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    return metrics.withColumn("_inverse", inverse).withColumn(
        "ensemble_weight", F.col("_inverse") / F.sum("_inverse").over(group)
    ).drop("_inverse")


def best_model(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.col("r2").desc(), F.col("mae_egp").asc()).limit(1)


# --- families ---------------------------------------------------------------------------------

@dataclass
class ModelFamily:
    """The models of one market, or of one property type in a market."""

    market: str
    segment: str | None
    encoder: Encoder
    models: dict[str, object]
    weights: dict[str, float]
    r2: float
    metadata: dict

    @property
    def name(self) -> str:
        return f"{self.market}-{(self.segment or 'all').lower().replace(' ', '_')}"

    def predict_logs(self, features: DataFrame) -> DataFrame:
        """Add one ``log_<model>`` column per model."""
        keep = features.columns
        scored = self.encoder.transform(features)
        for model in self.models.values():
            scored = model.transform(scored)
        return scored.select(*keep, *[f"log_{n}" for n in self.models])


@dataclass
class ValuationEngine:
    families: list[ModelFamily]
    qualified: list[tuple[str, str]] = field(default_factory=lambda: list(QUALIFIED_SEGMENTS))

    def segments(self) -> list[tuple[str, str]]:
        return [(f.market, f.segment) for f in self.families if f.segment]

    def family(self, market: str, segment: str | None = None) -> ModelFamily:
        return next(f for f in self.families if f.market == market and f.segment == segment)


def model_rows(df: DataFrame, as_of: Column, key: str = "listing_id") -> DataFrame:
    """Training rows of all markets: key, offering type, features, label; missing categories marked."""
    rows = ml_dataset(df.where(F.col("offering_type").isNotNull()), as_of, keep=(key, "offering_type"))
    return missing_category_token(rows)


def train_model_family(
    rows: DataFrame, market: str, segment: str | None, settings: TreeSettings, key: str = "listing_id",
    names: tuple[str, ...] = MODEL_NAMES, refit: bool = True, count: int | None = None,
) -> ModelFamily:
    """Fit on 70 %, weigh on 15 %, test the ensemble on 15 %, then fit again on all rows. ``count``: of the rows, if known."""
    parts = stored_parts(rows, key, train=70, validation=15, count=count)
    rows = parts.drop("split")
    started = time.time()
    encoder, encoded = encoded_parts(parts, key)
    train, validation, test = (encoded.where(F.col("split") == s) for s in ("train", "validation", "test"))
    models: dict[str, object] = {}
    for name in names:
        if name == "boosted":
            models[name] = fit_boosted(train, validation, settings).model
        else:
            models[name] = learner(name, settings).fit(train)

    def scored(frame: DataFrame) -> DataFrame:
        return reduce(lambda df, m: m.transform(df), models.values(), frame)

    columns = {n: f"log_{n}" for n in names}
    measured = regression_metrics(long_predictions(scored(validation), columns), "label", "predicted", ["model"])
    weighed = {r["model"]: r.asDict() for r in ensemble_weights(measured).collect()}
    weights = {n: weighed[n]["ensemble_weight"] for n in names}
    mean = reduce(lambda a, b: a + b, [F.col(f"log_{n}") * F.lit(weights[n]) for n in names])
    tested = regression_metrics(long_predictions(scored(test), {"ensemble": mean}), "label", "predicted", ["model"]).first()
    if refit:
        # the full number of rounds: the patience is for weighing only
        encoder = fit_encoder(rows, key)
        everything = stored(encoder.transform(rows, F.lit(True)).select("label", "features"), "encoded-all")
        for name in names:
            models[name] = fit_boosted(everything, None, settings).model if name == "boosted" else learner(name, settings).fit(everything)
    test_r2 = r2_of(tested)
    metadata = model_metadata(
        market, segment, rows.count(), {n: {k: v for k, v in weighed[n].items() if k != "model"} for n in names},
        tested.asDict() if tested else {}, time.time() - started, settings,
    )
    return ModelFamily(market, segment, encoder, models, weights, test_r2, metadata)


def r2_of(row) -> float:
    """R² of a metrics row; 0 where there is none (no rows, or a constant label)."""
    return float(row["r2"]) if row and row["r2"] is not None else 0.0


def model_metadata(market: str, segment: str | None, rows: int, validation: dict, test: dict, seconds: float,
                   settings: TreeSettings) -> dict:
    return {
        "market_type": market, "market_value": OFFERING_BY_MARKET[market], "property_type": segment, "rows": rows,
        "numeric_features": NUMERIC_FEATURES, "categorical_features": CATEGORICAL_FEATURES,
        "leakage_columns": sorted(LEAKAGE_COLUMNS), "validation_metrics": validation,
        "test_metrics": {k: v for k, v in test.items() if k != "model"}, "training_seconds": round(seconds, 3),
        "seed": SEED, "tree_depth": settings.tree_depth, "trees": settings.family_trees,
        "boost_rounds": settings.boost_rounds, "trained_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
    }


def train_valuation_models(
    rows: DataFrame, settings: TreeSettings, min_rows: int = MIN_SEGMENT_ROWS, names: tuple[str, ...] = MODEL_NAMES,
    qualified: list[tuple[str, str]] = QUALIFIED_SEGMENTS, parallel: int = 4, refit: bool = True,
) -> ValuationEngine:
    """A family per market and one per property type with enough rows.

    Small fits leave a cluster idle, so several families are submitted at a time.
    """
    rows = stored(rows, "model-rows")
    by_offering = {v: k for k, v in OFFERING_BY_MARKET.items()}
    sizes = {r["offering_type"]: r["count"] for r in rows.where(F.col("offering_type").isin(list(by_offering))).groupBy("offering_type").count().collect()}
    jobs: list[tuple[str, str | None, int]] = [(m, None, sizes.get(o, 0)) for m, o in OFFERING_BY_MARKET.items()]
    for r in segment_sizes(rows, min_rows).orderBy("offering_type", "property_type").collect():
        if r["offering_type"] in by_offering and r["property_type"] != "__MISSING__":
            jobs.append((by_offering[r["offering_type"]], r["property_type"], r["rows"]))

    def fit(job: tuple[str, str | None, int]) -> ModelFamily:
        market, segment, count = job
        mine = rows.where(F.col("offering_type") == OFFERING_BY_MARKET[market])
        if segment:
            mine = mine.where(F.col("property_type") == segment)
        return train_model_family(mine, market, segment, settings, names=names, refit=refit, count=count)

    return ValuationEngine(side_by_side(rows.sparkSession, fit, jobs, parallel), list(qualified))


def train_market_models(rows: DataFrame, settings: TreeSettings, key: str = "listing_id") -> dict[str, ModelFamily]:
    """One forest per market on an 80/20 split: without resampling for sale, with it for rent."""

    def fit(job: tuple[str, str]) -> ModelFamily:
        market, name = job
        parts = stored_parts(rows.where(F.col("offering_type") == OFFERING_BY_MARKET[market]), key)
        encoder, encoded = encoded_parts(parts, key)
        started = time.time()
        model = learner(name, settings, settings.market_trees[market]).fit(encoded.where(F.col("split") == "train"))
        scored = long_predictions(model.transform(encoded.where(F.col("split") == "test")), {name: f"log_{name}"})
        test = regression_metrics(scored, "label", "predicted", ["model"]).first()
        metadata = model_metadata(market, None, encoded.count(), {}, test.asDict() if test else {}, time.time() - started, settings)
        return ModelFamily(market, None, encoder, {name: model}, {name: 1.0}, r2_of(test), metadata)

    return {f.market: f for f in side_by_side(rows.sparkSession, fit, [("sale", "extra_trees"), ("rent", "random_forest")])}


# The three boosted settings that are compared: fixed values.
BOOST_CONFIGS = {
    "boosted_balanced": {"rounds": 3500, "rate": 0.035, "depth": 8, "l2": 5.0},
    "boosted_deeper": {"rounds": 3000, "rate": 0.04, "depth": 10, "l2": 7.0},
    "boosted_regularized": {"rounds": 3500, "rate": 0.03, "depth": 8, "l2": 10.0},
}


def tune_boosted(rows: DataFrame, settings: TreeSettings, market: str, configs: dict[str, dict] = BOOST_CONFIGS,
                 key: str = "listing_id") -> tuple[DataFrame, ModelFamily]:
    """(validation metrics per setting, family of the best one fitted again on all rows).

    ``rows`` must be of one market. The lowest validation RMSE wins. The test rows measure the winner and choose nothing.
    """
    spark, started = rows.sparkSession, time.time()
    parts = stored_parts(rows, key, train=70, validation=15)
    rows = parts.drop("split")
    if not rows.where(~F.col("offering_type").eqNullSafe(F.lit(OFFERING_BY_MARKET[market]))).isEmpty():
        raise ValueError(f"rows of another market than {market}")
    _, encoded = encoded_parts(parts, key)
    train, validation, test = (encoded.where(F.col("split") == s) for s in ("train", "validation", "test"))

    def fit(name: str) -> tuple[dict, object]:
        model, kept, _, _ = fit_boosted(train, validation, settings, **configs[name])
        scored = long_predictions(model.transform(validation), {name: "log_boosted"})
        row = regression_metrics(scored, "label", "predicted", ["model"]).first().asDict()
        return {**row, "rounds_kept": kept}, model

    fits = side_by_side(spark, fit, list(configs))
    results, fitted = [r for r, _ in fits], {r["model"]: (m, r["rounds_kept"]) for r, m in fits}
    winner = min(results, key=lambda r: (r["rmse_egp"], r["model"]))["model"]
    model, kept = fitted[winner]
    tested = regression_metrics(
        long_predictions(model.transform(test), {winner: "log_boosted"}), "label", "predicted", ["model"]
    ).first()
    final_encoder = fit_encoder(rows, key)
    everything = stored(final_encoder.transform(rows, F.lit(True)).select("label", "features"), "encoded-all")
    final = fit_boosted(everything, None, settings, **{**configs[winner], "rounds": max(kept + 1, settings.min_final_rounds)}).model
    metadata = model_metadata(market, None, rows.count(), {r["model"]: r for r in results}, tested.asDict() if tested else {},
                              time.time() - started, settings)
    family = ModelFamily(market, None, final_encoder, {"boosted": final}, {"boosted": 1.0}, r2_of(tested), metadata)
    table = [(r["model"], r["rows"], r["mae_egp"], r["rmse_egp"], r["r2"], r["median_absolute_error_egp"],
              r["rounds_kept"], r["model"] == winner) for r in results]
    schema = ("config string, rows bigint, mae_egp double, rmse_egp double, r2 double, "
              "median_absolute_error_egp double, rounds_kept int, is_best boolean")
    return spark.createDataFrame(table, schema), family


def benchmark_models(rows: DataFrame, settings: TreeSettings, key: str = "listing_id",
                     names: tuple[str, ...] = MODEL_NAMES, path: str | None = None) -> DataFrame:
    """Test metrics and fit seconds of every model per market, ranked by R², then by MAE,
    and stored as JSON at ``path`` if given.

    Boosted trees stop on a validation part of the training rows, never on the test rows.
    """
    parts = []
    for market, offering in OFFERING_BY_MARKET.items():
        split = stored_parts(rows.where(F.col("offering_type") == offering), key, train=70, validation=10)
        _, encoded = encoded_parts(split, key)
        fit_rows, held, test = (encoded.where(F.col("split") == s) for s in ("train", "validation", "test"))
        seconds, scored = {}, test
        for name in names:
            started = time.time()
            if name == "boosted":
                model = fit_boosted(fit_rows, held, settings).model
            else:
                model = learner(name, settings).fit(fit_rows.unionByName(held))
            seconds[name] = round(time.time() - started, 3)
            scored = model.transform(scored)
        measured = regression_metrics(
            long_predictions(scored, {n: f"log_{n}" for n in names}), "label", "predicted", ["model"]
        )
        took = F.create_map(*[x for n, s in seconds.items() for x in (F.lit(n), F.lit(s))])
        parts.append(measured.select(F.lit(market).alias("market"), "*", took[F.col("model")].alias("fit_seconds")))
    order = Window.partitionBy("market").orderBy(F.col("r2").desc(), F.col("mae_egp").asc(), "model")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order))
    if path is None:
        return ranked
    ranked.coalesce(1).write.mode("overwrite").json(path)  # a row for each market and model
    return ranked.sparkSession.read.schema(ranked.schema).json(path)


# --- storing and applying ---------------------------------------------------------------------

def save_family(family: ModelFamily, root: str) -> str:
    """Store the models of a family and one metadata row below ``root``."""
    path = f"{root}/{family.name}"
    family.encoder.save(f"{path}/encoding")
    for name, model in family.models.items():
        model.write().overwrite().save(f"{path}/{name}")
    spark = SparkSession.active()
    metadata_frame(spark, family).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return path


def metadata_frame(spark: SparkSession, family: ModelFamily) -> DataFrame:
    row = (family.market, family.segment, json.dumps(family.weights), float(family.r2), json.dumps(family.metadata, default=str))
    return spark.createDataFrame([row], "market string, segment string, weights string, test_r2 double, metadata string")


def load_family(spark: SparkSession, path: str) -> ModelFamily:
    info = spark.read.schema("market string, segment string, weights string, test_r2 double, metadata string").json(
        f"{path}/metadata").first()
    weights = json.loads(info["weights"])
    kinds = {n: GBTRegressionModel if n == "boosted" else RandomForestRegressionModel for n in weights}
    models = {n: kinds[n].load(f"{path}/{n}") for n in weights}
    return ModelFamily(info["market"], info["segment"], Encoder.load(spark, f"{path}/encoding"), models, weights,
                       info["test_r2"], json.loads(info["metadata"]))


def batch_predict(features: DataFrame, family: ModelFamily) -> DataFrame:
    """Add ``predicted_price``: the weighted log prediction on the price scale, not below 0."""
    scored = family.predict_logs(features)
    mean = reduce(lambda a, b: a + b, [F.col(f"log_{n}") * F.lit(w) for n, w in family.weights.items()])
    price = F.greatest(F.expm1(mean), F.lit(0.0))
    return scored.withColumn("predicted_price", price).drop(*[f"log_{n}" for n in family.models])
